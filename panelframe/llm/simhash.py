"""Operator 1: SimHash near-duplicates by tiled exact comparison.

Fingerprints come from all word shingles of the whole text. Distinct fingerprints
lie in tiles: rows with equal population counts in each of `bands` bit ranges, at
most about `tile` of them. A pair of tiles is compared only if the population
counts of its bands differ by no more than the radius in sum (the sum never exceeds
the Hamming distance, so nothing is lost); inside a pair every fingerprint meets every
other by exclusive-or and bit counts. A pair of tiles gives the links of a spanning
forest, so that groups of any size cost as many links as members.

The number of bands follows from the number of distinct fingerprints and changes the
cost only. Null and empty texts have fingerprint 0 and are linked like any other. Rows
with a null doc_id get the component of their fingerprint if a document with an id has
it too, else null; they link nothing. Rows with one doc_id are one document. Ids are integers or cast to them: an id that is
another text raises an error. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelframe.llm import words as W
from panelframe.llm.components import components
from panelframe.llm.shared import bounded_batches, narrow, saved


def _fingerprints(column: pa.Array, size: int, seed: int) -> np.ndarray:
    data, offsets = W.utf8(column)
    n = len(offsets) - 1
    starts, ends, rows = W.spans(data, offsets)
    kept = ~W.SEP[data] if len(data) else np.zeros(0, bool)
    gap = ends[(ends < len(data))]
    gap = gap[W.SEP[data[gap]]] if len(gap) else gap
    low = W.LOWER[data]
    low[gap] = 0x20
    kept[gap] = True
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum(kept, out=at[1:])
    text = low[kept].tobytes()
    first = W.bounds(rows, n)
    length = np.diff(first)
    # the shingles of a row start at each of its words but the last size-1; a short row has one
    is_start = np.arange(len(rows)) - first[:-1][rows] <= np.maximum(length - size, 0)[rows]
    begin = np.flatnonzero(is_start)
    close = np.minimum(begin + size - 1, first[1:][rows[begin]] - 1)
    of, s, e = rows[begin], at[starts[begin]], at[ends[close]]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(text[a:b], seed) for a, b in zip(s.tolist(), e.tolist(), strict=True)], np.uint64)
    return majority(hashes, of, n)


def majority(hashes: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows the bits that are set in over half its hashes; `of` is the row of each hash, in order."""
    step, total = 1 << 16, np.diff(np.searchsorted(of, np.arange(n + 1)))
    ones = np.zeros((n, 64), np.int64)
    for lo in range(0, len(hashes), step):
        bits = np.unpackbits(hashes[lo : lo + step].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        part = of[lo : lo + step]
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        ones[part[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > total[:, None], axis=1).view(">u8").reshape(-1).astype(np.uint64) if n else np.zeros(0, np.uint64)


def fingerprint(text: Column | str, size: int = 3, seed: int = 42) -> Column:
    """The 64-bit SimHash of the lower-cased (A-Z) word shingles, as a long."""

    @F.arrow_udf("long")
    def run(column: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([column], names=["text"])
        parts = [_fingerprints(p.column("text"), size, seed) for p in W.slices(batch, "text")]
        return pa.array((np.concatenate(parts) if parts else np.zeros(0, np.uint64)).view(np.int64))

    return run(text)


def _band_count(n: int) -> int:
    return 4 if n <= 4_000_000 else 8 if n <= 4_000_000_000 else 16


def _key(values: Column, bands: int) -> Column:
    """The population counts of the bands as the digits of a number, with room for steps of two."""
    width = 64 // bands
    digits = [F.bit_count(F.shiftrightunsigned(values, width * i).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))).cast("long") + 2 for i in range(bands)]
    out = F.lit(0).cast("long")
    for d in digits:
        out = out * (width + 5) + d
    return out


def _steps(bands: int, radius: int) -> list[int]:
    """Key differences above 0 of counts that differ by at most radius in sum."""
    base = 64 // bands + 5
    if radius > 2:
        raise ValueError("bands leave room for a radius of 2")
    found = set()
    for places in itertools.combinations_with_replacement(range(bands), radius):
        for signs in itertools.product((-1, 0, 1), repeat=radius):
            found.add(sum(s * base**p for s, p in zip(signs, places, strict=True)))
    return sorted(x for x in found if x > 0)


def _links(a_fp: np.ndarray, a_id: np.ndarray, b_fp: np.ndarray, b_id: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of what lies within the radius."""
    found = []
    for lo in range(0, len(a_fp), 256):
        near = np.bitwise_count(a_fp[lo : lo + 256, None] ^ b_fp[None, :]) <= radius
        i, j = np.nonzero(near)
        found.append((i + lo, j))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    la, lb = a_id.copy(), b_id.copy()
    while True:
        was = la.sum(dtype=np.int64), lb.sum(dtype=np.int64)
        np.minimum.at(la, i, lb[j])
        np.minimum.at(lb, j, la[i])
        if (la.sum(dtype=np.int64), lb.sum(dtype=np.int64)) == was:
            break
    node, root = np.concatenate([a_id, b_id]), np.concatenate([la, lb])
    moved = node != root
    return node[moved], root[moved]


def link_fingerprints(reps: DataFrame, radius: int = 2, tile: int = 2048, bands: int | None = None) -> DataFrame:
    """(fp, rep), one row each, to links (a, b) between reps that connect what the radius connects."""
    n = reps.count()
    bands = bands or _band_count(n)
    keyed = reps.withColumn("key", _key(F.col("fp"), bands))
    # at most (64 / bands + 1) ** bands rows, and no more than there are fingerprints
    chunks = keyed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / tile).alias("chunks"))
    dealt = keyed.join(chunks, "key").withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")))
    tiles = saved(dealt.groupBy("key", "chunk").agg(F.collect_list(F.struct("fp", "rep")).alias("rows")), "simhash-tiles")
    left = tiles.select(F.explode(F.array(*[F.col("key") + F.lit(d) for d in (0, *_steps(bands, radius))])).alias("key"), F.col("key").alias("own"), F.col("chunk").alias("own_chunk"), F.col("rows").alias("own_rows"))
    pairs = left.join(tiles, "key").where((F.col("own") < F.col("key")) | (F.col("own_chunk") <= F.col("chunk")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("own_rows", "rows"):
                column = batch.column(name)
                flat = column.flatten()
                at = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
                sides.append((at, flat.field("fp").to_numpy(zero_copy_only=False).view(np.uint64), flat.field("rep").to_numpy(zero_copy_only=False)))
            (xa, xf, xr), (ya, yf, yr) = sides
            a, b = [], []
            for k in range(batch.num_rows):
                x, y = slice(xa[k], xa[k + 1]), slice(ya[k], ya[k + 1])
                p, q = _links(xf[x], xr[x], yf[y], yr[y], radius)
                a.append(p)
                b.append(q)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v) if v else [], pa.int64()) for v in (a, b)], names=["a", "b"])

    return pairs.select("own_rows", "rows").mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, seed: int = 42, radius: int = 2, **how) -> DataFrame:
    """doc_id, fp (long) and component_id, the least doc_id that links of at most radius bits reach: a row for each of df."""
    bounded_batches(df.sparkSession)
    own = narrow(df, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint(F.col("text").cast("string"), size, seed).alias("fp"))
    own = saved(own, "simhash-fingerprints")
    reps = own.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null")
    reps = saved(reps, "simhash-distinct")
    tree = components(link_fingerprints(reps, radius, **how))
    found = reps.join(tree, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("of"), F.coalesce("component", "rep").alias("component_id"))
    return own.join(found, F.col("fp") == F.col("of"), "left").drop("of")


def drop_near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """df without the documents that are not the first of their group, with df's columns. Rows without an id stay."""
    rest = near_duplicates(df, doc_id, text, **how).where("doc_id <> component_id").select(F.col("doc_id").alias("\u0001id")).distinct()
    return df.join(rest, F.col(f"`{doc_id}`").cast("long") == F.col("\u0001id"), "left_anti")
