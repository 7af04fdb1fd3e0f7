"""Invariants of joins, cross-sections and the store, and what edge cases give."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelframe.functions import scalar as C
from panelframe.operators import cohorts, exposure, joins, pit, relational, train, xsection
from panelframe.plans import factors as FX
from panelframe.sources import store


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


def test_asof_never_looks_ahead(spark):
    left = spark.createDataFrame([("a", day(i)) for i in range(10)] + [("b", day(1))], "k string, d date")
    right = spark.createDataFrame([("a", day(3), 1.0), ("a", day(7), 2.0)], "k string, at date, v double")
    got = {(r.k, r.d): r.v for r in joins.asof(left, right, "k", "d", "at", ["v"]).collect()}
    assert got[("a", day(2))] is None and got[("a", day(3))] == 1 and got[("a", day(6))] == 1 and got[("a", day(9))] == 2 and got[("b", day(1))] is None
    strict = {(r.k, r.d): r.v for r in joins.asof(left, right, "k", "d", "at", ["v"], strict=True).collect()}
    assert strict[("a", day(3))] is None and strict[("a", day(4))] == 1


def test_outer_join_suffixes(spark):
    a = spark.createDataFrame([(1, 2, 3)], "k int, v int, w int")
    out = joins.outer_join([a, a.select("k", "v"), a.select("k", (F.col("v") + 1).alias("v"))], ["k"])
    assert out.columns == ["k", "v_x", "w", "v_y", "v"]


def test_neutral_residuals_are_orthogonal(spark):
    rows = [(d, i, "ABC"[i % 3] if i % 7 else None, float(10 + (i * 37) % 91), float((i * 53 + d * 7) % 29)) for d in range(2) for i in range(60)]
    df = spark.createDataFrame(rows, "d int, entity int, ind string, mv double, x double")
    out = xsection.neutralize(df, "d", "ind", "mv", ["x"]).withColumn("g", F.coalesce("ind", F.lit("A")))
    for r in out.groupBy("d", "g").agg(F.sum("x_neutral").alias("s")).collect():
        assert abs(r.s) < 1e-8
    for r in out.groupBy("d").agg(F.covar_pop("x_neutral", F.ln("mv")).alias("c")).collect():
        assert abs(r.c) < 1e-8


def test_empty_inputs(spark):
    e = spark.createDataFrame([], "entity int, d date, close_hfq double, vol double")
    assert FX.add(e, FX.labels()).count() == 0
    assert xsection.winsorize(e, "d", ["vol"]).count() == 0
    assert relational.describe(e, ["d"], "vol").count() == 0


def test_factor_without_column_is_zero(spark):
    df = spark.createDataFrame([(1, day(0), 2.0)], "entity int, d date, close_hfq double")
    assert FX.add(df, FX.quality(), ["current_ratio"]).first().current_ratio == 0


def test_lookback():
    assert FX.lookback(FX.momentum()["long_shadow_freq"]) == 19
    assert FX.lookback(FX.alpha101()["alpha101_3"]) is None


def test_best_version_and_quarters(spark):
    v = spark.createDataFrame([("a", day(0), day(5), 1.0, None), ("a", day(0), day(5), 1.0, 2.0), ("a", day(0), day(4), 9.0, 9.0), (None, day(0), day(9), 1.0, 1.0)], "k string, e date, ann date, x double, y double")
    out = pit.best_version(v, ["k", "e"], "ann", ["x", "y"]).collect()
    assert len(out) == 1 and out[0].y == 2
    q = spark.createDataFrame([("a", dt.date(2024, m, 28), float(m)) for m in (3, 6, 9, 12)], "k string, e date, x double")
    assert [r.x for r in pit.single_quarters(q, "k", "e", ["x"]).orderBy("e").collect()] == [3, 3, 3, 3]


def test_store_round_trip(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(e, day(i), float(e * i)) for e in range(3) for i in range(4)], "entity int, d date, v double")
    store.write_dates(df, path)
    store.write_dates(spark.createDataFrame([(9, day(2), 5.0)], "entity int, d date, v double"), path)
    back = store.read_window(spark, path, day(2), day(1), ["entity", "v"])
    got = {(r.entity, r.d): r.v for r in back.collect()}
    assert got[(9, day(2))] == 5 and got[(2, day(1))] == 2 and len(got) == 4
    assert store.latest_date(store.read_dates(spark, path)) == day(3) and store.dates(store.read_dates(spark, path)).count() == 4


def test_dates(spark):
    df = spark.createDataFrame([("2024-01-05",), ("20240105",), ("2024/01/05",), (None,)], "s string")
    assert [r[0] for r in df.select(C.normal_date(F.col("s"))).collect()] == [day(4)] * 3 + [None]
    with pytest.raises(Exception, match="not a date"):
        spark.createDataFrame([("x",)], "s string").select(C.normal_date(F.col("s"))).collect()
    codes = spark.createDataFrame([("600000.SH",), ("688001.SH",), ("000001.SZ",), ("300001.SZ",), (None,)], "c string")
    assert [r[0] for r in codes.select(C.main_board(F.col("c"))).collect()] == [True, False, True, False, False]


def test_training_dates_keep_the_embargo(spark):
    cal = spark.createDataFrame([(day(i),) for i in range(30)], "d date")
    out = train.training_dates(cal, "d", [day(20)], 12, 6, 2).collect()
    assert sorted(r.age for r in out) == [6, 8, 10]


def test_after_losses(spark):
    df = spark.createDataFrame([(day(i), v) for i, v in enumerate([-1.0, -1.0, -1.0, 2.0, -1.0])], "d date, p double")
    assert [r.ratio for r in exposure.after_losses(df, "d", "p").orderBy("d").collect()] == [0.5, 0.25, 0.125, 1.0, 0.5]


def test_exit_waits_for_a_tradable_day(spark):
    prices = spark.createDataFrame([("a", day(i), 10.0 + i, -10.0 if i == 3 else 0.0) for i in range(6)], "entity string, d date, p double, c double")
    bought = spark.createDataFrame([("a", day(3), 100.0, 9.0)], "entity string, due date, shares double, buy_price double")
    out = cohorts.exits(bought, prices, "entity", "due", "d", "p", "c", slip=0.0).first()
    assert out.sell_date == day(4) and out.sell_price == 14


def test_drawdown(spark):
    nav = spark.createDataFrame([(day(i), v) for i, v in enumerate([1.0, 2.0, 1.0, 3.0])], "d date, v double")
    m = cohorts.nav_metrics(nav, "d", "v").first()
    assert m.total == 2 and m.max_drawdown == -0.5 and m.peak_date == day(1) and m.trough_date == day(2)


def test_elastic_net_meets_its_conditions(spark):
    """Weights from sums alone: subgradient conditions of the objective, and the known weights of a near noiseless model."""
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (400, 5)) * [1, 2, 1, 0.5, 1]
    y = 3 + 2 * x[:, 0] - x[:, 1] + 0.01 * rng.normal(0, 1, 400)
    names = [f"f{i}" for i in range(5)]
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], ", ".join(f"{n} double" for n in names) + ", y double").repartition(5)
    parts, offset = train.grams(df, names, "y", 3)
    m = np.column_stack([np.ones(400), x - offset[:-1], y - offset[-1]])
    assert np.allclose(sum(parts.values()), m.T @ m) and len(parts) == 3
    for l1, p in ((0.5, 0.3), (1.0, 0.1), (0.1, 1.0)):
        w = train.descend(sum(parts.values()), l1, p)
        xc, yc = x - x.mean(0), y - y.mean()
        g = xc.T @ (yc - xc @ w) / 400 - p * (1 - l1) * w
        assert all(abs(g[j] - p * l1 * np.sign(w[j])) < 1e-5 if w[j] else abs(g[j]) <= p * l1 + 1e-5 for j in range(5))
    model = train.fit_elastic_net(df, names, "y")
    assert np.allclose(model.weights, [2, -1, 0, 0, 0], atol=0.02) and abs(model.intercept - 3) < 0.02
    s = {r.entity: r.score for r in train.score(model, df.withColumn("entity", F.monotonically_increasing_id()).withColumn("d", F.lit(1)), names, "d", "entity").collect()}
    assert len(s) == 400 and train.fit_elastic_net(df.limit(10), names, "y") is None


def test_boosted_trees_learn_an_order(spark):
    rows = [(i % 20, i, float(i % 17), float((i * 7) % 11), float(i % 17) ** 2) for i in range(400)]
    df = spark.createDataFrame(rows, "d int, entity int, a double, b double, y double")
    for model in (train.fit_trees(df, ["a", "b"], "y", rounds=5, rate=0.3), train.fit_trees(df.withColumn("y", (F.col("y") > 60).cast("int")), ["a", "b"], "y", classify=True, rounds=5)):
        s = train.score(model, df, ["a", "b"], "d", "entity").join(df, ["d", "entity"])
        assert s.stat.corr("score", "y") > 0.8
        assert train.importances(model, ["a", "b"])[0][1] > 0.9
    found = train.grid_search(df, ["a", "b"], "d", "entity", "y", lambda d, f, y, n: train.fit_elastic_net(d, f, y, (0.5,), n), {"n": (2, 5)})
    assert len(found) == 2 and found[0][1] >= found[1][1] > 0.8


def test_lists_names_and_smoothing(spark):
    from panelframe.operators import history

    df = spark.createDataFrame([(1, 1.0, None, "x", 2.0, 0.5)], "k int, a double, a_standard double, name string, label_1 double, b_neutral double")
    assert train.feature_columns(df, ["a", "c"]) == ["a_standard"] and train.discover(df, ["k"]) == ["a"]
    s = spark.createDataFrame([("f", i, v) for i, v in enumerate([1.0, 0.0, 0.0])], "f string, d int, v double")
    assert [r.smoothed for r in history.ewm_over_refits(s, "v", "f", "d").orderBy("d").collect()] == pytest.approx([1, 0.7, 0.49])
    t = spark.createDataFrame([(1, "a")], "k int, v string")
    assert {r.k: r.v for r in joins.lookup(spark.createDataFrame([(1,), (2,)], "k int"), t, "k", "v", F.lit("none")).collect()} == {1: "a", 2: "none"}
    cal = spark.createDataFrame([(day(i),) for i in (0, 2, 5)], "d date")
    assert cohorts.align(cal, "d", day(1), day(9)) == (day(2), day(5)) and store.since_last(cal, 1) == day(2)
    with pytest.raises(ValueError, match="no trading day"):
        cohorts.align(cal, "d", day(3), day(4))
    full = exposure.exposure_on(cal, cal.where(F.col("d") == day(2)).withColumn("ratio", F.lit(0.5)), "d")
    assert [r.ratio for r in full.orderBy("d").collect()] == [1, 0.5, 1]
    assert cal.select(exposure.combine(F.lit(0.5), F.lit(0.2)).alias("r")).first().r == pytest.approx(0.2)


def test_bootstrap_interval(spark):
    import numpy as np

    x = np.random.default_rng(3).normal(0.02, 0.1, 300)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "k int, r double")
    b = cohorts.bootstrap(df, "r", "k", 1500).first()
    half = 1.96 * x.std() / 300**0.5
    assert b.mean == pytest.approx(x.mean(), abs=0.001) and b.lo == pytest.approx(x.mean() - half, abs=0.003) and b.hi == pytest.approx(x.mean() + half, abs=0.003)
