"""Operator 8: mixing sources to target weights by pivotal dependent rounding.

Every source gets a target share of all words. A document's fair number of copies
is its source's target over its source's size; the whole part is given, and the
fractions are rounded dependently: two documents of a source exchange probability
mass, weighted by their sizes, at random until one of them is 0 or 1. The exchange
keeps the source's expected words, so that each block of rows ends with one open
fraction a source; these residuals meet in a tree, `fan` blocks at a time and dealt out by
hash of the source (sources never exchange mass), so that no task holds the residuals of all sources, and only
the last one is rounded alone. So a source misses its target by less than the size
of one document; larger documents are paired first, which leaves a small one last.

Blocks are formed by hash of the row, never by where it happens to lie, and the
draws are hashes too: the result depends on the rows alone. Rows equal in all columns
count as one item and get the same number of copies. A null text has size 0 and a
null source is a source, the last in order. Documents without words get the whole part
and a fraction drawn alone. Ids are integers or cast to them: an id that is another text raises an error. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelframe.llm.shared import partitions, saved

#: A word and the space after it, of which the first character stays; or space before all words.
WORD = r"([^\x20\x09-\x0D])[^\x20\x09-\x0D]*+[\x20\x09-\x0D]*+|[\x20\x09-\x0D]++"


def n_words(text: Column) -> Column:
    """The number of words, each replaced by one character: regexp_count would make a string of every match."""
    return F.length(F.regexp_replace(text, F.lit(WORD), F.lit("$1")))


def source_targets(sizes: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """(source, source_size) to (source, source_size, target): weights repeat over the sources in order of code points, null last.

    What a source would get over cap times its size is shared again by weight among
    the others, until none is above. Each round is an aggregate of two numbers.
    """
    spark = sizes.sparkSession
    part = sizes.repartitionByRange(max(1, min(partitions(spark), 16)), F.col("source").asc_nulls_last())
    part = saved(part.withColumn("part", F.spark_partition_id()), "mix-sources")
    before = part.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    number = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("before")
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(number, F.lit(len(weights))) + 1).cast("int"))
    s = part.join(before.drop("count"), "part").withColumn("w", w)
    s = saved(s.select("source", "source_size", "w"), "mix-weights")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        above = F.col("w") * F.lit(level) > cap * F.col("source_size") if capped >= 0 else F.lit(False)
        row = s.agg(F.count_if(above).alias("n"), F.coalesce(F.sum(F.when(above, cap * F.col("source_size"))), F.lit(0.0)).alias("full"), F.coalesce(F.sum(F.when(~above, F.col("w"))), F.lit(0.0)).alias("w")).first()
        if row["n"] == capped:
            break
        capped = row["n"]
        level = (total - row["full"]) / row["w"] if row["w"] else math.inf
    return s.select("source", "source_size", F.least(F.col("w") * F.lit(level), cap * F.col("source_size")).alias("target"))


def pivot(p: np.ndarray, size: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int]:
    """Rounded fractions (those of one source), and the place of the one that is still open, or -1."""
    p, at = p.copy(), -1
    for i in range(len(p)):
        if not 0 < p[i] < 1:
            continue
        if at < 0:
            at = i
            continue
        ratio = size[at] / size[i]
        up, down = min(1 - p[at], p[i] / ratio), min(p[at], (1 - p[i]) / ratio)
        move = up if draw[i] * (up + down) < down else -down
        p[at] += move
        p[i] -= move * ratio
        for j in (at, i):
            if p[j] < 1e-9 or p[j] > 1 - 1e-9:
                p[j] = round(p[j])
        at = at if 0 < p[at] < 1 else i if 0 < p[i] < 1 else -1
    return p, at


_ITEM = "doc_id long, row_hash long, source string, size long, same long, whole long, p double, open boolean, block long"


def _rounder(last: bool, seed: int):
    return lambda rows: _round_block(rows, last, seed)


def _round_block(rows: pd.DataFrame, last: bool, seed: int) -> pd.DataFrame:
    rows = rows.assign(_none=rows["source"].isna()).sort_values(["_none", "source", "size", "doc_id", "row_hash"], ascending=[True, True, False, True, True], kind="stable").reset_index(drop=True)
    x = rows["row_hash"].to_numpy("int64").view("uint64") ^ np.uint64(seed)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    draw = ((x ^ (x >> np.uint64(32))) >> np.uint64(11)).astype(float) / 2.0**53
    p, size = rows["p"].to_numpy(float).copy(), (rows["size"] * rows["same"]).to_numpy(float)
    alone = size == 0
    p[alone] = draw[alone] < p[alone]
    is_open = np.zeros(len(rows), bool)
    for _, at in rows.groupby(["_none", "source"], sort=False, dropna=False).indices.items():
        at = np.sort(at)
        p[at], left = pivot(p[at], size[at], draw[at])
        if left >= 0:
            is_open[at[left]] = True
    if last:
        p[is_open] = draw[is_open] < p[is_open]
        is_open[:] = False
    return rows.assign(p=p, open=is_open).drop(columns=["_none", "bucket"])


def decide(df: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3, doc_id: str = "doc_id", text: str = "text", source: str = "source", block_rows: int = 4096, fan: int = 64, seed: int = 17) -> DataFrame:
    """One row for each distinct row of df: doc_id, row_hash, source, size, same (how often it occurs), source_size, target, copies."""
    spark = df.sparkSession
    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), row_hash(df).alias("row_hash"), F.col(f"`{source}`").cast("string").alias("source"), F.coalesce(n_words(F.col(f"`{text}`").cast("string")), F.lit(0)).cast("long").alias("size"))
    items = saved(rows.groupBy("doc_id", "row_hash", "source", "size").agg(F.count(F.lit(1)).alias("same")), "mix-items")
    sources = saved(source_targets(items.groupBy("source").agg(F.sum(F.col("size") * F.col("same")).alias("source_size")), weights, cap), "mix-targets")
    n = items.count()
    blocks = max(1, -(-n // block_rows))
    buckets = max(1, -(-sources.count() * fan // block_rows))
    fair = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    t = sources.withColumnRenamed("source", "of")
    level = (
        items.join(t, F.col("source").eqNullSafe(F.col("of")), "left")
        .withColumns({"whole": F.floor(fair), "p": fair - F.floor(fair), "open": F.lit(False), "block": F.pmod(F.xxhash64("row_hash", "doc_id", F.lit(seed)), F.lit(blocks))})
        .select(*[c.split()[0] for c in _ITEM.split(", ")])
    )
    done, depth = None, 0
    while True:
        last = blocks == 1  # every source that is still open has one block
        salt = (seed + 0x9E3779B97F4A7C15 * (depth + 1)) % 2**63
        # a block of the first level has block_rows rows; above it, fan residuals of each source of a bucket
        bucket = F.pmod(F.xxhash64("source"), F.lit(buckets)) if depth else F.lit(0)
        rounded = level.withColumn("bucket", bucket).groupBy("block", "bucket").applyInPandas(_rounder(last, salt), _ITEM)
        rounded = saved(rounded, f"mix-level-{depth}")
        closed = rounded.where(~F.col("open"))
        done = closed if done is None else done.unionByName(closed)
        if last:
            break
        blocks = -(-blocks // fan)
        level = rounded.where("open").withColumn("block", F.floor(F.col("block") / fan))
        depth += 1
    out = done.withColumn("copies", F.col("whole") + F.round("p").cast("long")).drop("whole", "p", "open", "block")
    return out.join(t, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")


def row_hash(df: DataFrame):
    """Of all columns, so that rows that agree in it are equal."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])


def mix(df: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """df with each row as often as the mix takes it, with df's columns."""
    columns = df.columns
    made = decide(df, doc_id=doc_id, **how).select(F.col("doc_id").alias("\u0001id"), F.col("row_hash").alias("\u0001hash"), "copies").where("copies > 0").withColumnRenamed("copies", "\u0001copies")
    own = df.withColumn("\u0001own", row_hash(df))
    out = own.join(made, F.col("\u0001own").eqNullSafe(F.col("\u0001hash")) & F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col("\u0001id")))
    out = out.withColumn("\u0001k", F.explode(F.sequence(F.lit(1), F.col("\u0001copies").cast("int"))))
    return out.select(*[F.col(f"`{c}`") for c in columns])
