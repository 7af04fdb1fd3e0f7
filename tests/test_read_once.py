"""Steps that ask for their rows once, and joins and windows that they do without."""

import datetime as dt

from pyspark.sql import functions as F

from panelframe.operators import train
from panelframe.sources import store


def rows(spark, n=60):
    return spark.createDataFrame([(i % 5, dt.date(2020, 1, 1) + dt.timedelta(i // 5), float(i % 7), float(i * i % 11)) for i in range(n)], "entity long, d date, x double, y double")


def test_trees_read_their_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(v):
        seen.add(1)
        return v

    df = rows(spark).withColumn("y", F.udf(counted, "double").asNondeterministic()("y"))
    train.fit_trees(df, ["x"], "y", rounds=2, depth=1, sample=1.0)
    assert seen.value == 60


def test_a_search_shares_what_its_fits_need_of_the_rows(spark):
    made, got = [], []
    shared = lambda d, f, y: made.append(1) or train.grams(d, f, y, 3, "w")

    def fit(d, f, y, n, sums=None):
        got.append(sums)
        return train.fit_elastic_net(d, f, y, (0.5,), n, least=5, weight="w", sums=sums)

    grid = {"n": (2, 5, 9), "half": (None, 3.0)}
    found = train.grid_search(rows(spark), ["x"], "d", "entity", "y", fit, grid, shared=shared, parallelism=1)
    assert len(made) == 2 and len(found) == len(got) == 6 and None not in got
    assert found == train.grid_search(rows(spark), ["x"], "d", "entity", "y", fit, grid, parallelism=1)


def test_newer_rows_are_not_looked_for_in_the_old_panel(spark):
    df = rows(spark)
    a, b, cut = df.select("entity", "d", "x"), df.select("entity", "d", "y").where("entity > 1"), dt.date(2020, 1, 5)
    old = a.where(F.col("d") <= cut).withColumn("y", F.lit(-1.0))
    out = store.extend_panel(old, [a, b], ["entity", "d"])
    got = {(r.entity, r.d): (r.x, r.y) for r in out.collect()}
    assert len(got) == 60 and all((y == -1.0) if d <= cut else (y is None) == (e < 2) for (e, d), (_, y) in got.items())
    assert "LeftAnti" not in out._jdf.queryExecution().toString()
    empty = store.extend_panel(old.limit(0), [a, b], ["entity", "d"])
    assert empty.count() == 60


def test_places_of_exported_rows(spark, tmp_path):
    df = rows(spark, 500)
    df.repartitionByRange(3, "d", "entity").sortWithinPartitions("d", "entity").write.parquet(f"{tmp_path}/out")
    out = store.numbered(spark, f"{tmp_path}/out")
    got = [(r.d, r.entity) for r in sorted(out.collect(), key=lambda r: r.place)]
    assert [r.place for r in out.orderBy("place").collect()] == list(range(1, 501))
    assert got == sorted(got)
