"""Operator 13: a Merkle manifest of a dataset, with proofs by Octopus multiproof.

A row's leaf is the digest of its fields. The leaves of a group ascend by their order column
and two consecutive nodes become their parent (the last one alone, where their number is odd)
until one is left, the group's subroot; subroots, in the order of their groups, give the root the same way.
A digest is the lowercase hex SHA-256 of what stands below it, digests as their hex text.

Rows get their places by a range partitioning, in which a group of any size spreads over tasks,
and running counts of (partition, group). A leaf partition is an aligned run of 2**height leaves
(the last of a group may be shorter). Upwards, each gives the node above it, and runs of nodes go on
like that; what lies at `height` or above is kept as a table of coordinates (group, level, place). For
the proofs, each leaf partition computes the least set of coordinates that all its leaves together lack
(`missing`), fetches them once by a join, derives the inner nodes that its leaves share, and
expands the proof of each leaf locally. A node that many partitions ask for is repeated
in the table so often that no copy serves more than 2**height of them.

Null fields are `-`. Rows without an order value come first, rows of one order value stand by their
leaf, and equal rows are equal leaves. A null group is a group, the first. A group of one leaf has it as subroot, and a
dataset of one group has its subroot as root. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelframe.llm.shared import saved


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def depth(n: int) -> int:
    """Levels from a leaf to the top of a tree of n leaves."""
    return max(0, n - 1).bit_length()


def leaf(fields: Sequence[Column]) -> Column:
    """Each field `-` if null, else its bytes' number, `:` and its text."""
    text = [x.cast("string") for x in fields]
    return F.sha2(F.concat(*[F.when(x.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x)) for x in text]), 256)


def climb(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of an aligned run and of the levels above it."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([digest(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return out


def missing(places: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The least set of (level, place) that the given leaves of a tree of n lack for all their proofs."""
    out, places, level = [], np.unique(places), 0
    while n > 1:
        beside = places ^ 1
        out += [(level, int(x)) for x in np.setdiff1d(beside[beside < n], places)]
        places, n, level = np.unique(places >> 1), (n + 1) // 2, level + 1
    return out


def fold(node: str, place: int, siblings: Sequence[str | None]) -> str:
    """The top that follows from a node and its siblings, from below; None where a node stands alone."""
    for s in siblings:
        node = digest(node) if s is None else digest(s, node) if place & 1 else digest(node, s)
        place >>= 1
    return node


def _placed(df: DataFrame, key: str, order: Sequence[str], name: str) -> DataFrame:
    """df with `at`, the row's place among those of its key, and `n`, their number."""
    by = [F.col(c).asc_nulls_first() for c in (key, *order)]
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by)
    ranged = saved(ranged.withColumns({"part": F.spark_partition_id(), "line": F.monotonically_increasing_id()}), name)
    runs = ranged.groupBy("part", key).agg(F.min("line").alias("first"), F.count(F.lit(1)).alias("own"))
    of = Window.partitionBy(key)
    runs = runs.withColumns({"n": F.sum("own").over(of), "before": F.sum("own").over(of.orderBy("part")) - F.col("own")}).drop("own")
    out = ranged.join(runs, ["part", key]).withColumn("at", F.col("line") - F.col("first") + F.col("before"))
    return out.drop("part", "line", "first", "before")


_NODE = "k string, level int, at bigint, hash string, n bigint"


def _grow(nodes: DataFrame, height: int, base: int) -> DataFrame:
    """The nodes up to `height` levels above the given ones of one level, from `base` on, and tops."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        k, level, n = (t.column(c)[0].as_py() for c in ("k", "level", "n"))
        first = t.column("at")[0].as_py()
        made = climb(t.column("hash").to_pylist(), min(height, depth(n) - level))
        rows = [(k, level + i, (first >> i) + j, x, n) for i, nodes in enumerate(made) if (i > 0 or level == 0) and (level + i >= base or level + i == depth(n)) for j, x in enumerate(nodes)]
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64())
        return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["k", "level", "at", "hash", "n"])

    return nodes.select("k", "level", "at", "hash", "n", F.shiftright("at", height).alias("run")).groupBy("k", "run").applyInArrow(run, _NODE)


def _tree(leaves: DataFrame, height: int, base: int, name: str) -> DataFrame:
    """All nodes at `base` and above, and the tops of all groups, of leaves (k, at, hash, n)."""
    most = leaves.agg(F.max("n")).first()[0]
    level, out = 0, None
    now = leaves.withColumn("level", F.lit(0))
    while True:
        made = saved(_grow(now, height, base), f"{name}-{level}")
        out = made if out is None else out.unionByName(made)
        level += height
        if most is None or depth(most) <= level:
            return out
        now = made.where((F.col("level") == level) & (F.col("n") > 1 << level))


def _asked(parts: DataFrame, height: int, base: int) -> DataFrame:
    """The coordinates that leaf partitions (k, part, n) of 2**base leaves lack; `copy` spreads what many ask for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, part, n in zip(*(b.column(c).to_pylist() for c in ("k", "part", "n")), strict=True):
                lacks = missing(np.arange(part << base, min(n, (part + 1) << base)), n)
                rows += [(k, part, level, at, (part >> height) & ((1 << max(0, level - base - height)) - 1)) for level, at in lacks]
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["k", "part", "level", "at", "copy"])

    return parts.mapInArrow(run, "k string, part bigint, level int, at bigint, copy bigint")


def _fetched(parts: DataFrame, nodes: DataFrame, height: int, base: int) -> DataFrame:
    """(k, part, found): what each leaf partition lacks, as a list by level; a row also where nothing is lacking."""
    copies = F.explode(F.expr(f"sequence(0L, shiftleft(1L, greatest(0, level - {base + height})) - 1)"))
    held = nodes.select("k", "level", "at", "hash", copies.alias("copy"))
    got = _asked(parts, height, base).join(held, ["k", "level", "at", "copy"])
    return got.groupBy("k", "part").agg(F.sort_array(F.collect_list(F.struct("level", "hash"))).alias("found"))


def _siblings(found: list[dict] | None, levels: range) -> list[str | None]:
    by = {x["level"]: x["hash"] for x in found or ()}
    return [by.get(i) for i in levels]


def prove(df: DataFrame, group: str, order: str, fields: Sequence[str | Column], tampered: Column | None = None, height: int = 10) -> DataFrame:
    """One row for each of df: its group and order value, leaf, subroot, root, proof (array of siblings from below, left to right) and folded_root.

    folded_root is what follows from the proof and the leaf, or `tampered` (a leaf) where that is not null.
    """
    of = [F.col(f"`{c}`") if isinstance(c, str) else c for c in fields]
    g, o = F.col(f"`{group}`").cast("string"), F.col(f"`{order}`")
    kind = df.select(o.alias("o")).schema["o"].dataType.simpleString()
    own = df.select(F.when(g.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), g)).alias("k"), o.alias("o"), leaf(of).alias("hash"), (F.lit(None).cast("string") if tampered is None else tampered).alias("other"))
    leaves = _placed(own, "k", ["o", "hash"], "merkle-leaves")
    nodes = _tree(leaves.select("k", "at", "hash", "n"), height, height, "merkle-nodes")
    tops = nodes.where(F.expr(f"level = {_DEPTH}"))
    groups = _placed(tops.select(F.lit("").alias("all"), F.col("k").alias("of"), "hash", F.col("n").alias("size")), "all", ["of"], "merkle-groups")
    groups = saved(groups.select(F.lit("").alias("k"), "of", "at", "hash", "n", "size"), "merkle-tops")
    above = _tree(groups.select("k", "at", "hash", "n"), height, 0, "merkle-above")
    path = _fetched(groups.select("k", F.col("at").alias("part"), "n"), above, height, 0).select(F.col("part").alias("at"), F.col("found").alias("above"))
    root = above.where(F.expr(f"level = {_DEPTH}")).select("k", F.col("hash").alias("root"))
    groups = groups.join(path, "at", "left").join(root, "k").select(F.col("of").alias("k"), F.col("at").alias("place"), F.col("n").alias("groups"), F.col("hash").alias("subroot"), "root", "above", "size")
    # a group's own path goes to all its partitions, 2**height of them a copy
    groups = groups.withColumn("copy", F.explode(F.expr(f"sequence(0L, shiftright(size - 1, {2 * height}))")))
    parts = leaves.groupBy("k", F.shiftright("at", height).alias("part")).agg(F.first("n").alias("n"))
    parts = saved(parts, "merkle-parts")
    found = parts.join(_fetched(parts, nodes, height, height), ["k", "part"], "left").withColumn("copy", F.shiftright("part", height)).join(groups, ["k", "copy"])

    def run(mine: pa.Table, lacked: pa.Table) -> pa.Table:
        mine, got = mine.sort_by("at"), lacked.to_pylist()[0]
        n, part, k = got["n"], got["part"], got["k"]
        levels = climb(hashes := mine.column("hash").to_pylist(), min(height, depth(n)))
        outer = _siblings(got["found"], range(height, depth(n)))
        upper = _siblings(got["above"], range(depth(got["groups"])))
        known, said = [s for s in (*outer, *upper) if s is not None], mine.column("other").to_pylist()
        subroot = fold(levels[-1][0], part, outer)
        whole, proofs, folded = fold(subroot, got["place"], upper), [], []
        for i, other in enumerate(said):
            inner = [row[s] if (s := (i >> j) ^ 1) < len(row) else None for j, row in enumerate(levels[:-1])]
            proofs.append([s for s in inner if s is not None] + known)
            folded.append(whole if other is None else fold(fold(other, (part << height) + i, inner + outer), got["place"], upper))
        m = len(hashes)
        cols = [pa.array([k[1:] if k else None] * m, pa.string()), mine.column("o"), mine.column("hash"), pa.array([got["subroot"]] * m), pa.array([got["root"]] * m), pa.array(proofs, pa.list_(pa.string())), pa.array(folded, pa.string())]
        return pa.table(cols, names=["g", "o", "hash", "subroot", "root", "proof", "folded"])

    by = leaves.withColumn("part", F.shiftright("at", height)).groupBy("k", "part")
    out = by.cogroup(found.groupBy("k", "part")).applyInArrow(run, f"g string, o {kind}, hash string, subroot string, root string, proof array<string>, folded string")
    return out.toDF(group, order, "leaf", "subroot", "root", "proof", "folded_root")


#: Levels above the leaves of a tree of n, as SQL.
_DEPTH = "CASE WHEN n > 1 THEN length(bin(n - 1)) ELSE 0 END"
