"""Boosted trees on histograms: held against Spark ML's, whose cost a row and round they had."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from panelframe.operators import boosting, train


def rows(spark, n=3000, seed=4):
    rng = np.random.default_rng(seed)
    a, b, c = rng.integers(0, 31, n), rng.integers(0, 9, n), rng.integers(0, 20, n)
    y = np.sin(a / 4) + 0.3 * b * (c > 7) + rng.normal(0, 0.2, n)
    w = np.where(rng.random(n) < 0.1, 2.0, 1.0)
    return spark.createDataFrame([(1, i, *map(float, r)) for i, r in enumerate(zip(a, b, c, y, w))], "d int, entity int, a double, b double, c double, y double, w double").repartition(3)


@pytest.mark.parametrize("classify", [False, True])
def test_the_trees_are_those_of_spark_ml(spark, classify, monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK", 256)
    monkeypatch.setattr(boosting, "ANEW", 4)
    df, names = rows(spark), ["a", "b", "c"]
    if classify:
        df = df.withColumn("y", (F.col("y") > 0.8).cast("int"))
    model = train.fit_trees(df, names, "y", "w", classify=classify, rounds=9, rate=0.3, sample=1.0)
    got = {r.entity: r.score for r in train.score(model, df, names, "d", "entity").collect()}
    d = VectorAssembler(inputCols=names, outputCol="features").transform(df).withColumn("z", F.col("y").cast("double"))
    own = (GBTClassifier if classify else GBTRegressor)(labelCol="z", weightCol="w", maxIter=9, stepSize=0.3, maxDepth=4, subsamplingRate=1.0).fit(d)
    out = own.transform(d).select("entity", (vector_to_array("probability")[1] if classify else F.col("prediction")).alias("s"))
    want = {r.entity: r.s for r in out.collect()}
    assert len(got) == 3000 and max(abs(got[k] - want[k]) for k in want) < 1e-9
    assert [v for _, v in train.importances(model, names)] == pytest.approx(own.featureImportances.toArray().tolist(), abs=1e-6)


def test_a_fit_keeps_no_row_as_an_object(spark, monkeypatch):
    """A round's state is one element for a block of rows, and a share of the rows is drawn anew each round."""
    sizes = []
    keep = boosting._sums
    monkeypatch.setattr(boosting, "_sums", lambda state, *a: sizes.append(state.count()) or keep(state, *a))
    df = rows(spark)
    some = train.fit_trees(df, ["a", "b", "c"], "y", rounds=3, rate=0.3, sample=0.5)
    assert max(sizes) <= 3 and len(set(some.trees)) == 3
    again = train.fit_trees(df.coalesce(1), ["a"], "y", rounds=2)
    assert again == train.fit_trees(df.coalesce(1), ["a"], "y", rounds=2)


def test_splits_come_from_all_values(spark):
    df = spark.range(0, 20000, 1, 5).select(F.col("id").cast("double").alias("many"), F.when(F.col("id") == 7, 3.0).otherwise(F.lit(1.0)).alias("rare"))
    many, rare = boosting.candidates(df)
    assert rare == (2.0,) and len(many) == 31 and max(abs(v - 20000 * (k + 1) / 32) for k, v in enumerate(many)) < 10
    with pytest.raises(Exception, match="finite"):
        train.fit_trees(df.withColumn("y", F.lit(float("nan"))), ["many"], "y", rounds=1)
