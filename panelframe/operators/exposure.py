"""Exposure tables: date to position ratio, from index series, factor drift and past batches.

A regime of a row is what is known the row before. Series have one row a date and some
thousands of dates; their windows have one partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelframe.functions import kernels as K


def _spec(df: DataFrame, day: str) -> tuple[DataFrame, K.Spec]:
    return df.withColumn("\u0001one", F.lit(1)), K.Spec("\u0001one", day)


def ma_regime(df: DataFrame, day: str, close: str, n: int = 60) -> DataFrame:
    """Full exposure if the last close was above its mean."""
    d, s = _spec(df, day)
    d = d.withColumn("\u0001m", K.mean(s, F.col(close), n))
    return d.select(day, F.when(K.lag(s, F.col(close), 1) > K.lag(s, F.col("\u0001m"), 1), 1.0).otherwise(0.0).alias("ratio"))


def style(df: DataFrame, day: str, a: str, b: str, corr_rows: int = 10, sum_rows: int = 5) -> DataFrame:
    """Two return series: rolling correlation, regime, values, spread, sums."""
    d, s = _spec(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), day)
    c = K.corr(s, F.col(a), F.col(b), corr_rows)
    d = d.withColumns({"corr": c, "nav_a": K.cum_prod(s, 1 + F.col(a)), "nav_b": K.cum_prod(s, 1 + F.col(b)), "spread": K.cum_sum(s, F.col(a) - F.col(b)), "sum_a": K.total(s, F.col(a), sum_rows), "sum_b": K.total(s, F.col(b), sum_rows)})
    regime = F.when(F.col("corr") > 0.6, "converged").when(F.col("corr") < -0.2, "diverged").when(F.col("corr").isNotNull(), "neutral")
    return d.withColumn("regime", regime).drop("\u0001one")


def style_convergence(df: DataFrame, day: str, a: str, b: str, avoid: float = 0.0, corr_rows: int = 5, bound: float = 0.75) -> DataFrame:
    """Avoid when both fall together."""
    st = style(df, day, a, b, corr_rows)
    bad = (F.col("corr") > bound) & (F.col("sum_a") < 0) & (F.col("sum_b") < 0)
    return st.select(day, F.when(bad, F.lit(avoid)).otherwise(F.lit(1.0)).alias("ratio"))


def blind_window(df: DataFrame, day: str, small: str, large: str, close: str, avoid: float = 0.0, n: int = 7, history: int = 80, p_corr: float = 0.2, p_vol: float = 0.33, trend: int = 20) -> DataFrame:
    """Correlation of two returns or volatility of the large one below its own low quantile; known the row before.

    Low volatility alone is no reason while the small index's close stood above its trend the row before; low correlation always is.
    Quantiles and trend run over the rows that have both statistics; the others are fully exposed.
    """
    d, s = _spec(df.where(F.col(small).isNotNull() & F.col(large).isNotNull()), day)
    d = d.withColumns({"\u0001c": K.corr(s, F.col(small), F.col(large), n), "\u0001v": K.std(s, F.col(large), n)})
    d, s = d.withColumn("\u0001ok", F.col("\u0001c").isNotNull() & F.col("\u0001v").isNotNull()), K.Spec("\u0001ok", day)
    d = d.withColumns({"\u0001qc": K.quantile(s, F.col("\u0001c"), p_corr, history, history // 2), "\u0001qv": K.quantile(s, F.col("\u0001v"), p_vol, history, history // 2), "\u0001m": K.mean(s, F.col(close), trend) if trend else F.lit(None).cast("double")})
    calm = F.coalesce(K.lag(s, F.col(close), 1) > K.lag(s, F.col("\u0001m"), 1), F.lit(False))
    apart, quiet = F.coalesce(F.col("\u0001c") < F.col("\u0001qc"), F.lit(False)), F.coalesce(F.col("\u0001v") < F.col("\u0001qv"), F.lit(False))
    d = d.withColumn("\u0001r", F.when(apart | (quiet & ~calm), F.lit(avoid)).otherwise(F.lit(1.0)))
    return d.select(day, F.when(F.col("\u0001ok"), F.coalesce(K.lag(s, F.col("\u0001r"), 1), F.lit(1.0))).otherwise(F.lit(1.0)).alias("ratio"))


def factor_means(panel: DataFrame, day: str, factors: Sequence[str]) -> DataFrame:
    """G05"""
    return panel.groupBy(day).agg(*[F.avg(f).alias(f) for f in factors])


def factor_drift(means: DataFrame, day: str, factors: Sequence[str], window: int = 40, ahead: int = 6, history: int = 40, p: float = 0.75, avoid: float = 0.0) -> DataFrame:
    """Mean distance of recent factor means from those of the training rows, in their deviations (1e-8 at least), against its own quantile."""
    d, s = _spec(means, day)
    train, blind = s.rows.rowsBetween(-window + 1, -ahead), s.rows.rowsBetween(-ahead + 1, 0)
    parts = [F.abs(F.avg(f).over(blind) - F.avg(f).over(train)) / F.when(F.stddev_samp(f).over(train).isNotNull(), F.greatest(F.stddev_samp(f).over(train), F.lit(1e-8))) for f in factors]
    known = sum((F.when(x.isNotNull(), 1).otherwise(0) for x in parts), F.lit(0))
    d = d.withColumn("drift", K.div(sum((F.coalesce(x, F.lit(0.0)) for x in parts), F.lit(0.0)), F.when(known > 0, known)))
    d = d.withColumn("\u0001q", K.quantile(s, F.col("drift"), p, history, max(5, history // 4)))
    d = d.withColumn("\u0001r", F.when(F.col("drift") >= F.col("\u0001q"), F.lit(avoid)).otherwise(F.lit(1.0)))
    return d.select(day, "drift", F.coalesce(K.lag(s, F.col("\u0001r"), 1), F.lit(1.0)).alias("ratio"))


def volatility_regime(df: DataFrame, day: str, ret: str, n: int = 6, history: int = 80) -> DataFrame:
    """0, a half or all by terciles of own volatility; known the row before."""
    d, s = _spec(df, day)
    d = d.withColumn("\u0001v", K.std(s, F.col(ret), n))
    d = d.withColumns({"\u0001lo": K.quantile(s, F.col("\u0001v"), 0.33, history, history // 2), "\u0001hi": K.quantile(s, F.col("\u0001v"), 0.67, history, history // 2)})
    d = d.withColumn("\u0001r", F.when(F.col("\u0001v") < F.col("\u0001lo"), 0.0).when(F.col("\u0001v") < F.col("\u0001hi"), 0.5).otherwise(1.0))
    return d.select(day, F.coalesce(K.lag(s, F.col("\u0001r"), 1), F.lit(1.0)).alias("ratio"))


def hybrid(blind: DataFrame, converged: DataFrame, day: str, partial_blind: float = 0.3, partial_style: float = 0.5) -> DataFrame:
    """Both clear 1; only the blind window against .3, only the styles against .5, both against 0."""
    j = blind.select(day, F.col("ratio").alias("\u0001b")).join(converged.select(day, F.col("ratio").alias("\u0001c")), day)
    b, c = F.col("\u0001b") < 1, F.col("\u0001c") < 1
    return j.select(day, F.when(b & c, 0.0).when(b, partial_blind).when(c, partial_style).otherwise(1.0).alias("ratio"))


def after_losses(batches: DataFrame, day: str, profit: str, half: float = 0.5, floor: float = 0.0) -> DataFrame:
    """Every loss in a row multiplies the next ratio by `half`, down to a floor; a batch without loss resets it to full."""
    d, s = _spec(batches, day)
    d = d.withColumn("\u0001g", K.cum_sum(s, F.when(F.col(profit) >= 0, 1).otherwise(0)))
    d = d.withColumn("\u0001n", F.sum(F.when(F.col(profit) < 0, 1).otherwise(0)).over(Window.partitionBy("\u0001g").orderBy(day).rowsBetween(Window.unboundedPreceding, 0)))
    return d.select(day, F.greatest(F.pow(F.lit(half), F.col("\u0001n")), F.lit(floor)).alias("ratio"))


def exposure_on(dates: DataFrame, table: DataFrame, day: str) -> DataFrame:
    """Dates without an entry are fully exposed."""
    return dates.select(day).join(table, day, "left").withColumn("ratio", F.coalesce("ratio", F.lit(1.0)))


def combine(*ratios: Column) -> Column:
    """The smallest of several rules' ratios."""
    return F.least(*ratios) if len(ratios) > 1 else ratios[0]
