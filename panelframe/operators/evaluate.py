"""Signal evaluation over scored rows (date, entity, score, label)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelframe.functions.kernels import TINY, div


def average_rank(x: str, *by: str) -> Column:
    """Rank with ties averaged, to nine decimals."""
    h = F.round(F.col(x), 9)
    w = Window.partitionBy(*by).orderBy(h)
    return F.rank().over(w) + (F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2.0


def safe_corr(x: str | Column, y: str | Column) -> Column:
    """Pearson as an aggregate; null where a side is constant."""
    s = F.stddev_pop(x) * F.stddev_pop(y)
    return div(F.covar_pop(x, y), F.when(s > TINY, s))


def rank_ic(df: DataFrame, by: Sequence[str], score: str, label: str, least: int = 2) -> DataFrame:
    """Spearman of score and label by group over rows that have both."""
    ok = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    r = ok.withColumns({"\u0001rs": average_rank(score, *by), "\u0001rl": average_rank(label, *by)})
    return r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), safe_corr("\u0001rs", "\u0001rl").alias("ic")).where(F.col("n") >= least)


def quintiles(df: DataFrame, day: str, score: str, label: str) -> DataFrame:
    """Mean label of the five score bins of each date, and the top minus the bottom one."""
    ok = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    p = ok.withColumn("\u0001p", average_rank(score, day) / F.count(F.lit(1)).over(Window.partitionBy(day)))
    bucket = F.when(F.col("\u0001p") <= 0.2, 1).when(F.col("\u0001p") <= 0.4, 2).when(F.col("\u0001p") <= 0.6, 3).when(F.col("\u0001p") <= 0.8, 4).otherwise(5)
    out = p.withColumn("\u0001b", bucket).groupBy(day).agg(*[F.avg(F.when(F.col("\u0001b") == i, F.col(label))).alias(f"q{i}") for i in range(1, 6)])
    return out.withColumn("long_short", F.col("q5") - F.col("q1"))


def top_returns(df: DataFrame, day: str, score: str, label: str, entity: str, tops: Sequence[int] = (10, 50, 100)) -> DataFrame:
    """Mean label of the best names, and over the mean of all."""
    place = F.row_number().over(Window.partitionBy(day).orderBy(F.col(score).desc_nulls_last(), entity))
    r = df.where(F.col(label).isNotNull()).withColumn("\u0001p", place)
    out = r.groupBy(day).agg(F.avg(label).alias("market"), *[F.avg(F.when(F.col("\u0001p") <= n, F.col(label))).alias(f"top{n}") for n in tops])
    return out.withColumns({f"top{n}_excess": F.col(f"top{n}") - F.col("market") for n in tops})


def ic_summary(ics: DataFrame, by: Sequence[str] = (), ic: str = "ic") -> DataFrame:
    """Mean, deviation, ratio and share above 0."""
    s = F.stddev_samp(ic)
    return ics.groupBy(*by).agg(F.count(ic).alias("n"), F.avg(ic).alias("ic_mean"), s.alias("ic_std"), div(F.avg(ic), F.when(s > TINY, s)).alias("ic_ir"), F.avg((F.col(ic) > 0).cast("double")).alias("ic_pos"))


def non_overlapping(spread: DataFrame, day: str, x: str, every: int, year: int = 252) -> DataFrame:
    """Every n-th date of a series: compounded return, mean, deviation and annualised ratio."""
    k = spread.where(F.col(x).isNotNull()).withColumn("\u0001rn", F.row_number().over(Window.orderBy(day)) - 1).where(F.col("\u0001rn") % every == 0)
    s = F.stddev_samp(x)
    return k.agg(F.count(F.lit(1)).alias("n"), (F.product(1 + F.col(x)) - 1).alias("cumulative"), F.avg(x).alias("mean"), s.alias("std"), (div(F.avg(x), F.when(s > TINY, s)) * F.sqrt(F.lit(year / every))).alias("sharpe"))


def ndcg(df: DataFrame, day: str, score: str, label: str, entity: str, k: int = 10) -> DataFrame:
    """Gain is the label's first rank, discount 1/log2(place + 1); equal scores share the mean gain of their places."""
    ok = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).withColumn("\u0001s", F.round(score, 9))
    gain = F.row_number().over(Window.partitionBy(day).orderBy(label, entity))
    g = ok.withColumn("\u0001g", gain)
    g = g.withColumns({"\u0001place": F.row_number().over(Window.partitionBy(day).orderBy(F.desc("\u0001s"), entity)), "\u0001best": F.row_number().over(Window.partitionBy(day).orderBy(F.desc("\u0001g"))), "\u0001mean": F.avg("\u0001g").over(Window.partitionBy(day, "\u0001s"))})
    at = lambda g_, p: F.sum(F.when(F.col(p) <= k, F.col(g_) / F.log2(F.col(p) + 1.0)))
    return g.groupBy(day).agg(div(at("\u0001mean", "\u0001place"), at("\u0001g", "\u0001best")).alias("ndcg"))


def activity(importances: DataFrame, metrics: DataFrame, day: str, factor: str, importance: str, names: Sequence[str], least: int = 10) -> DataFrame:
    """Mean metrics on dates where a factor is used minus dates where it isn't; reliable from `least` unused dates on."""
    j = importances.join(metrics, day)
    on = F.col(importance) > 0
    diffs = [(F.avg(F.when(on, F.col(m))) - F.avg(F.when(~on, F.col(m)))).alias(f"{m}_diff") for m in names]
    return j.groupBy(factor).agg(F.count_if(on).alias("active"), F.count_if(~on).alias("inactive"), *diffs).withColumn("reliable", F.col("inactive") >= least)


def classify(df: DataFrame, ic_diff: str, top_diff: str, bound: float = 0.01) -> DataFrame:
    """By the difference of the rank correlation; a harmful factor whose best names still earn more is a trade-off."""
    a = F.col(ic_diff)
    kind = F.when(~F.col("reliable"), "unreliable").when(a > bound, "positive").when((a < -bound) & (F.col(top_diff) < 0), "harmful").when((a < -bound) & (F.col(top_diff) >= 0), "trade_off").otherwise("neutral")
    return df.withColumn("kind", kind)


def dispersion(df: DataFrame, day: str, score: str, entity: str, n: int) -> DataFrame:
    """(score at place n - mean) / deviation of the date."""
    place = F.row_number().over(Window.partitionBy(day).orderBy(F.col(score).desc_nulls_last(), entity))
    s = F.stddev_samp(score)
    return df.where(F.col(score).isNotNull()).withColumn("\u0001p", place).groupBy(day).agg(div(F.max(F.when(F.col("\u0001p") == n, F.col(score))) - F.avg(score), F.when(s > TINY, s)).alias("alias"))


def report(df: DataFrame, day: str, entity: str, score: str, label: str, tops: Sequence[int] = (10, 50, 100)) -> DataFrame:
    """The daily table of all metrics for any scored rows."""
    return rank_ic(df, [day], score, label).join(quintiles(df, day, score, label), day).join(top_returns(df, day, score, label, entity, tops), day).join(ndcg(df, day, score, label, entity), day, "left")
