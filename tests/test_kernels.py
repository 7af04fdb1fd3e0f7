"""Kernels against pandas on random panels with gaps, ties, constants."""

import math

import numpy as np
import pandas as pd
import pytest

from panelframe.functions import expr as X
from panelframe.operators.history import ewm_columns

N = 60


@pytest.fixture(scope="module")
def panel():
    rng = np.random.default_rng(3)
    rows = []
    for e in range(4):
        x = np.round(rng.normal(10, 3, N), 2) if e < 3 else np.full(N, 5.0)
        y = np.round(rng.normal(0, 1, N), 1)
        x[rng.random(N) < 0.15] = np.nan
        rows.append(pd.DataFrame({"entity": e, "d": range(N), "x": x, "y": y}))
    return pd.concat(rows, ignore_index=True)


def spark_frame(spark, panel):
    data = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in panel.itertuples(index=False, name=None)]
    return spark.createDataFrame([(int(a), int(b), c, d) for a, b, c, d in data], "entity long, d long, x double, y double")


def check(spark, panel, expr, want):
    got = X.apply(spark_frame(spark, panel), {"out": expr}).toPandas().sort_values(["entity", "d"])["out"].astype(float).to_numpy()
    expected = np.concatenate([np.asarray(want(g), float) for _, g in panel.groupby("entity")])
    np.testing.assert_allclose(got, expected, rtol=1e-9, atol=1e-9, equal_nan=True)


x, y = X.col("x"), X.col("y")


def rank_in(a):
    return ((a[:-1] < a[-1]).sum() + ((a == a[-1]).sum() + 1) / 2) / len(a)


CASES = {
    "mean": (X.mean(x, 5), lambda g: g.x.rolling(5).mean()),
    "mean_least": (X.mean(x, 5, 2), lambda g: g.x.rolling(5, min_periods=2).mean()),
    "sum": (X.total(y, 4), lambda g: g.y.rolling(4).sum()),
    "min": (X.low(x, 6, 1), lambda g: g.x.rolling(6, min_periods=1).min()),
    "max": (X.high(x, 6), lambda g: g.x.rolling(6).max()),
    "std": (X.std(y, 7), lambda g: g.y.rolling(7).std()),
    "cov": (X.cov(x, y, 8, 4), lambda g: g.x.rolling(8, min_periods=4).cov(g.y)),
    "quantile": (X.quantile(x, 0.3, 9, 4), lambda g: g.x.rolling(9, min_periods=4).quantile(0.3)),
    "pct_padded": (X.pct(X.ffill(x), 3), lambda g: g.x.ffill().pct_change(3, fill_method=None)),
    "delta": (X.delta(x, 2), lambda g: g.x.diff(2)),
    "mad": (X.mad(y, 5), lambda g: g.y.rolling(5).apply(lambda a: np.abs(a - a.mean()).mean(), raw=True)),
    "ts_rank": (X.ts_rank(y, 6), lambda g: g.y.rolling(6).apply(rank_in, raw=True)),
    "ts_argmax": (X.ts_argmax(y, 6), lambda g: g.y.rolling(6).apply(np.argmax, raw=True)),
    "ts_argmin": (X.ts_argmin(y, 6), lambda g: g.y.rolling(6).apply(np.argmin, raw=True)),
    "prank": (X.prank(x), lambda g: g.x.rank(pct=True)),
    "cum_max": (X.cum_max(y), lambda g: g.y.cummax()),
    "ewm": (X.ewm(x, 0.3), lambda g: g.x.ewm(alpha=0.3, adjust=False).mean()),
    "nested": (X.mean(X.prank(X.std(y, 4)), 3), lambda g: g.y.rolling(4).apply(lambda a: np.std(a, ddof=1), raw=True).round(9).rank(pct=True).rolling(3).mean()),
}


@pytest.mark.parametrize("name", CASES)
def test_against_pandas(spark, panel, name):
    check(spark, panel, *CASES[name])


def test_corr_of_constants_is_null(spark, panel):
    out = X.apply(spark_frame(spark, panel).where("entity = 3"), {"c": X.corr(x, y, 8, 3)}).where("c is not null")
    assert out.count() == 0


def test_streak_ignores_missing(spark):
    values = [1.0, 2.0, None, 1.0, -1.0, -2.0, None, -1.0, 0.0, 3.0]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "entity int, d int, x double")
    out = X.apply(df, {"s": X.streak(x > 0, x <= 0)}).orderBy("d").collect()
    assert [r.s for r in out] == [1, 2, 0, 3, 0, 0, 0, 0, 0, 1]


def test_ewm_gap_rule(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([1.0, None, None, 4.0, 5.0])], "entity int, d int, x double")
    got = [r.e for r in ewm_columns(df, {"e": ("x", 0.5)}).orderBy("d").collect()]
    np.testing.assert_allclose(got, [1, 1, 1, 3.4, 4.2])
