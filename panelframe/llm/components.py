"""Connected components as DataFrame jobs: alternating large-star and small-star.

Each half round points nodes at the least neighbour by an aggregate and a join, so
that no neighbourhood is gathered in one place; the rounds grow with the logarithm of
the number of nodes and go on until nothing changes. Every round is cut by a checkpoint in the shared folder.
Edges that are no more than `local` (a checked count) are settled in one task instead, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelframe.llm.shared import cut


def components(edges: DataFrame, local: int = 1 << 18) -> DataFrame:
    """(a, b) pairs of longs to (node, component): component is the least node reachable. Loops and nulls count as nothing."""
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = _state(now)
    if state[0] <= local:
        return now.coalesce(1).mapInArrow(_settled, "node long, component long")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = cut(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        now = cut(small)
        new = _state(now)
        if new == state:
            break
        state = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labels fall to the least across every edge, and along the labels themselves, until none moves."""
    sides = [(b.column("a").to_numpy(zero_copy_only=False), b.column("b").to_numpy(zero_copy_only=False)) for b in batches]
    none = np.zeros(0, np.int64)
    a, b = (np.concatenate([none, *x]) for x in (zip(*sides, strict=True) if sides else (none, none)))
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while len(nodes):
        was, low = label, np.minimum(label[a], label[b])
        label = was.copy()
        for side in (a, b, was[a], was[b]):
            np.minimum.at(label, side, low)
        label = label[label]
        if (label == was).all():
            break
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(nodes[label], pa.int64())], names=["node", "component"])


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]
