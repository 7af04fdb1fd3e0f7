"""Deduplication, sets, state upkeep, aggregates, bins and reshaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelframe.functions.kernels import div


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("\u0001rn", F.row_number().over(w)).where(F.col("\u0001rn") == 1).drop("\u0001rn")


def top_k(df: DataFrame, k: int, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The k first rows of each group."""
    return df.withColumn("\u0001rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("\u0001rn") <= k).drop("\u0001rn")


def every_nth(df: DataFrame, n: int, order: str) -> DataFrame:
    """Rows 0, n, 2n, ... of a date series (one row a date)."""
    return df.withColumn("\u0001rn", F.row_number().over(Window.orderBy(order)) - 1).where(F.col("\u0001rn") % n == 0).drop("\u0001rn")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace old ones of the same keys."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def key_sets(a: DataFrame, b: DataFrame, keys: Sequence[str], part: str = "part") -> DataFrame:
    """The distinct keys of both, with what they are in: 'both', 'first' (not in the second), and once more 'either'."""
    a, b = a.select(*keys).distinct(), b.select(*keys).distinct()
    named = {"both": a.intersect(b), "first": a.exceptAll(b), "either": a.union(b).distinct()}
    out = None
    for name, df in named.items():
        one = df.withColumn(part, F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def append_distinct(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Old rows win over new ones; within a side the first in order."""
    both = old.withColumn("\u0001side", F.lit(0)).unionByName(new.withColumn("\u0001side", F.lit(1)), allowMissingColumns=True)
    return keep_one(both, keys, [F.col("\u0001side"), *order]).drop("\u0001side")


def changes(state: DataFrame, now: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose value differs from the state's, with both."""
    return state.select(key, F.col(value).alias("before")).join(now.select(key, F.col(value).alias("after")), key).where(~F.col("before").eqNullSafe(F.col("after")))


def latest(df: DataFrame, key: str, order: str, values: Sequence[str]) -> DataFrame:
    """The last record of each key."""
    last = df.groupBy(key).agg(F.max(F.struct(order, *values)).alias("\u0001r"))
    return last.select(key, *[F.col(f"\u0001r.{c}").alias(c) for c in (order, *values)])


def carry_flags(flags: DataFrame, state: DataFrame, calendar: DataFrame, key: str, day: str, flag: str) -> DataFrame:
    """Flags with the state's flag for every calendar day after the last one; history stays."""
    last = flags.agg(F.max(day)).first()[0]
    new = calendar.select(day).distinct() if last is None else calendar.where(F.col(day) > last).select(day).distinct()
    return flags.unionByName(state.select(key, flag).crossJoin(F.broadcast(new)).select(*flags.columns))


def describe(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """Count, mean, deviation, quantiles and extremes of a group."""
    q = F.percentile(x, F.array(*map(F.lit, (0.01, 0.25, 0.5, 0.75, 0.99))))
    out = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), q.alias("\u0001q"), F.max(x).alias("max"), F.sum(x).alias("sum"), F.count_if(F.col(x) > 0).alias("n_pos"))
    names = ("p01", "p25", "median", "p75", "p99")
    return out.select(*by, "n", "mean", "std", "min", *[F.col("\u0001q")[i].alias(c) for i, c in enumerate(names)], "max", "sum", "n_pos", t_stat(F.col("mean"), F.col("std"), F.col("n")).alias("t"))


def t_stat(mean: Column, std: Column, n: Column) -> Column:
    """H12"""
    return div(mean, std) * F.sqrt(n)


def correlations(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Pearson and Spearman (average ranks) over pairs, slope and intercept of y on x."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rank = lambda c: F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, c)) - 1) / 2.0
    r = ok.withColumns({"\u0001rx": rank(x), "\u0001ry": rank(y)})
    safe = lambda a, b: div(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), safe(x, y).alias("pearson"), safe("\u0001rx", "\u0001ry").alias("spearman"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def cut(x: Column, edges: Sequence[float], labels: Sequence[str], right: bool = True) -> Column:
    """Label of the bin (edges[i], edges[i+1]], or [edges[i], edges[i+1]) if not right; null outside."""
    out = None
    for lo, hi, name in zip(edges, edges[1:], labels, strict=False):
        hit = (x > lo) & (x <= hi) if right else (x >= lo) & (x < hi)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def qcut(df: DataFrame, by: Sequence[str], x: str, n: int, out: str = "bucket") -> DataFrame:
    """Quantile bins 0..n-1, right-closed, by exact interpolated edges of the group."""
    edges = df.groupBy(*by).agg(F.percentile(x, F.array(*[F.lit(i / n) for i in range(1, n)])).alias("\u0001edges"))
    return df.join(edges, list(by)).withColumn(out, F.when(F.col(x).isNotNull(), F.size(F.filter("\u0001edges", lambda e: e < F.col(x))))).drop("\u0001edges")


def histogram(df: DataFrame, x: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts of equal bins [lo, hi); the last one takes hi too."""
    at = F.least(F.floor((F.col(x) - lo) / ((hi - lo) / bins)), F.lit(bins - 1))
    return df.where(F.col(x).between(lo, hi)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def pivot(df: DataFrame, row: str, column: str, value: str, names: Sequence[str]) -> DataFrame:
    """H15"""
    return df.groupBy(row).pivot(column, list(names)).agg(F.first(value))


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "factor", value: str = "value") -> DataFrame:
    """H16"""
    return df.unpivot(list(ids), list(values), name, value)
