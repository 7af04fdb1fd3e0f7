"""Exact ranks and quantiles of groups of any size: one table of distinct values, range-partitioned.

A group's percentile kept in one task needs all of its values there. Here the distinct values of all groups are counted
(map-side first), dealt out by ranges of (group, value), so that a hot group spreads over tasks, and numbered by running
sums over ranges. A quantile is a lookup of one or two ranks in this table, an average rank a join with it; equal values meet as one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelframe.sources.shared import saved


def value_table(df: DataFrame, by: str, value: str, digits: int | None = None) -> DataFrame:
    """(by, value, count, before, n): how often each value of a group occurs, how many are below it, and how many there are; nulls don't count."""
    x = F.col(value) if digits is None else F.round(value, digits) + F.lit(0.0)
    counts = df.select(F.col(by).alias("g"), x.alias("v")).where(F.col("v").isNotNull()).groupBy("g", "v").agg(F.count(F.lit(1)).alias("count"))
    order = [F.col("g").asc_nulls_first(), F.col("v")]
    ranged = saved(counts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "order-values")
    sums = ranged.groupBy("part", "g").agg(F.sum("count").alias("own"))
    g = Window.partitionBy("g")
    sums = sums.select("part", F.col("g").alias("h"), F.sum("own").over(g).alias("n"), (F.sum("own").over(g.orderBy("part")) - F.col("own")).alias("start"))
    own = Window.partitionBy("part", "g").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("before", F.sum("count").over(own) - F.col("count"))
    joined = placed.join(sums.withColumnRenamed("part", "p"), (F.col("part") == F.col("p")) & F.col("g").eqNullSafe(F.col("h")))
    return joined.select(F.col("g").alias(by), F.col("v").alias(value), "count", (F.col("before") + F.col("start")).alias("before"), "n")


def quantiles(df: DataFrame, by: str, value: str, shares: Sequence[float], out: str = "quantiles") -> DataFrame:
    """(by, out): the interpolated quantiles as an array, in the order of shares; groups without a value are left out."""
    t = value_table(df, by, value)
    parts = []
    for p in shares:
        at = F.lit(float(p)) * (F.col("n") - 1)
        for rank in (F.floor(at), F.ceil(at)):
            parts.append(F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("count")), F.col(value))).alias(f"q{len(parts)}"))
    found = t.groupBy(by).agg(F.first("n").alias("n"), *parts)

    def between(i: int, p: float):
        at = F.lit(float(p)) * (F.col("n") - 1)
        a, b = F.col(f"q{2 * i}"), F.col(f"q{2 * i + 1}")
        return F.when(F.floor(at) == F.ceil(at), a).otherwise((F.ceil(at) - at) * a + (at - F.floor(at)) * b)

    return found.select(by, F.array(*[between(i, p) for i, p in enumerate(shares)]).alias(out))


def average_ranks(df: DataFrame, by: str, value: str, out: str = "rank", share: bool = True, digits: int = 9) -> DataFrame:
    """df with the rank of its value in its group, ties averaged, compared to `digits` decimals; as a share of the group's values unless told otherwise. Null for null."""
    t = value_table(df, by, value, digits)
    rank = F.col("before") + (F.col("count") + 1) / 2.0
    ranked = t.select(F.col(by).alias("\u0001g"), F.col(value).alias("\u0001v"), (rank / F.col("n") if share else rank).alias("\u0001r"))
    held = F.round(value, digits) + F.lit(0.0)
    joined = df.join(ranked, F.col(by).eqNullSafe(F.col("\u0001g")) & (held == F.col("\u0001v")), "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c != out], F.col("\u0001r").alias(out))
