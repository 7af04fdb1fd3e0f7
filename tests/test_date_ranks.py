"""Ranks within dates: all that can be made by then take one pass over dates."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelframe.functions import expr as X
from panelframe.functions import kernels as K
from panelframe.functions.expr import col
from panelframe.queries import QUERIES


def frame(spark, n=600):
    rng = np.random.default_rng(5)
    p = pd.DataFrame({"entity": np.repeat(np.arange(20), n // 20), "d": np.tile(np.arange(n // 20), 20), "a": rng.integers(0, 9, n) / 3, "b": rng.normal(0, 1, n)})
    p.loc[rng.random(n) < 0.1, "a"] = np.nan
    p.loc[p.d == 3, "b"] = np.nan
    rows = [(int(e), int(d), None if a != a else float(a), None if b != b else float(b)) for e, d, a, b in p.itertuples(index=False)]
    return spark.createDataFrame(rows, "entity int, d int, a double, b double")


def test_ranks_of_dates_are_the_windows(spark):
    df = frame(spark).unionByName(spark.createDataFrame([(90, 4, float("nan"), -0.0), (91, 4, float("nan"), 0.0), (92, None, 1.0, 2.0)], "entity int, d int, a double, b double"))
    want = df.select("entity", "d", K.x_rank(K.Spec(), F.col("a")).alias("x"), K.x_rank(K.Spec(), F.col("b")).alias("y"))
    got = K.ranks_of_dates(df, {"x": F.col("a"), "y": F.col("b")}, ["entity", "d"], "d")
    key = lambda r: (r.entity, -1 if r.d is None else r.d)
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)


def test_ranks_between_windows(spark):
    df, s = frame(spark), K.Spec()
    named = {"r": X.x_rank(X.delta(col("b"), 2)) + X.x_rank(col("a")), "c": X.total(X.x_rank(col("a")), 3), "rr": X.x_rank(X.lag(X.x_rank(col("b")), 1)), "a": X.lag(col("a"), 1), "q": X.ts_rank(X.x_rank(col("b")), 3)}
    got = {(r.entity, r.d): r for r in X.apply(df, named).collect()}
    w = df.withColumns({"t": F.col("b") - K.lag(s, F.col("b"), 2), "ra": K.x_rank(s, F.col("a")), "rb": K.x_rank(s, F.col("b"))})
    w = w.withColumns({"r": K.x_rank(s, F.col("t")) + F.col("ra"), "c": K.total(s, F.col("ra"), 3), "l": K.lag(s, F.col("rb"), 1), "a": K.lag(s, F.col("a"), 1), "q": K.ts_rank(s, F.col("rb"), 3)})
    w = w.withColumn("rr", K.x_rank(s, F.col("l")))
    want = w.collect()
    assert len(want) == len(got) == 600
    for r in want:
        g = got[r.entity, r.d]
        for n in named:
            assert (g[n] is None) == (r[n] is None) and (r[n] is None or g[n] == pytest.approx(r[n], abs=1e-6)), n


def test_the_alphas_meet_a_date_once(spark):
    plan = QUERIES["factors_alpha101_cross_section"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1 and plan.count("Exchange hashpartitioning(d") == 1
