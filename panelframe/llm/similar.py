"""SimHash near-duplicates at a similarity of word shingles: the near-dedup stage of the corpus pipeline.

Two documents are linked if their sets of lower-cased (A-Z) word shingles have a Jaccard
similarity of at least `share`. Sets of shingle hashes that are equal count as one first.
Fingerprints of such pairs lie about 10 bits apart, where operator 1's tiles of the whole table would spare nothing, so
tiles are formed within candidates: documents that share one of the least hashes of their sets. Of the `keys` least hashes in the
union of two sets each lies in both with the probability of their similarity, so that a pair at
0.8 is missed with a probability of 0.2 ** keys (4e-9 for 12). A set of few shingles gives so many
keys that nothing is missed. Candidates of a key lie in tiles of bounded size and every
tile meets every other, as in operator 1, but as fingerprints and sketches (the `least` least hashes of a set), never as whole sets:
a passage that is quoted everywhere gives a key whose documents grow with the table and are otherwise unlike.
Tile pairs whose population counts differ beyond `radius` are skipped, inside a pair every
fingerprint meets every other by exclusive-or and bit counts, and of what is within the radius and of fitting
sizes the sketches are compared. Fingerprints of sets at 0.8 differ in 9.7 bits in expectation with a deviation of 2.9, so that 26 bits
lose one of about 10 ** 8 such pairs; sets below `few` shingles scatter more and all meet. Of the 32 least hashes of the union
fewer than 10 lie in both sets of such a pair with a probability of 4e-10 (`agreed`); small sets are seen whole.

What is left links documents to groups, in which each document's set is sent once; a group's sets lie in tiles again, and every pair
that is within the radius and of fitting sizes is verified on the whole sets. A pair
of tiles gives the links of a spanning forest, so that a group of any size costs as many links as members.

A text shorter than a shingle is one shingle; null and texts without words have one in common. Rows
with a null doc_id link nothing and stay. Rows with one doc_id are one document. An empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelframe.llm import words as W
from panelframe.llm.components import components
from panelframe.llm.shared import bounded_batches, freeing, freeing_after, narrow, saved, scratch
from panelframe.llm.simhash import majority

_OWN = "whole long, n long, fp long, keys int, least array<long>"
_PAD = np.uint64(2**64 - 1)  # where a sketch ends
_CELLS = 1 << 20  # pairs that a task looks at together


def _shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row in order, and where the rows begin."""
    data, offsets = W.utf8(column)
    n = len(offsets) - 1
    starts, ends, rows = W.spans(data, offsets)
    hashes = W.range_hash(data, starts, ends, W.BYTE_LOWER)
    first = W.bounds(rows, n)
    length = np.diff(first)
    begin = np.flatnonzero(np.arange(len(rows)) - first[:-1][rows] <= np.maximum(length - size, 0)[rows])
    close = np.minimum(begin + size, first[1:][rows[begin]])
    none = np.flatnonzero(length == 0)
    of = np.concatenate([rows[begin], none])
    value = np.concatenate([W.range_hash(hashes, begin, close), np.zeros(len(none), np.uint64)])
    order = np.lexsort((value, of))
    of, value = of[order], value[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (value[1:] != value[:-1])
    return value[new], np.searchsorted(of[new], np.arange(n + 1))


def _lists(values: np.ndarray, edge: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(values.view(np.int64)))


def _parts(column: pa.Array) -> Iterator[pa.Array]:
    for part in W.slices(pa.RecordBatch.from_arrays([column], names=["text"]), "text"):
        yield part.column("text")


def _keys(size: int, share: tuple[int, int], most: int, least: int):
    """The set's hash, size and fingerprint, its least hashes in order, and how many of them are keys."""

    @F.arrow_udf(_OWN)
    @freeing
    def run(column: pa.Array) -> pa.Array:
        out = []
        for part in _parts(column):
            value, edge = _shingles(part, size)
            n = np.diff(edge)
            # two sets of that similarity share one of so many least elements, in any order of all elements
            keys = np.minimum(n - -(-n * share[0] // share[1]) + 1, most)
            take = np.minimum(n, least)
            at = np.concatenate([[0], np.cumsum(take)])
            sketch = value[np.repeat(edge[:-1] - at[:-1], take) + np.arange(at[-1])]
            whole = W.range_hash(value, edge[:-1], edge[1:])
            fp = majority(value, np.repeat(np.arange(len(part)), n), len(part))
            out.append(pa.StructArray.from_arrays([pa.array(whole.view(np.int64)), pa.array(n, pa.int64()), pa.array(fp.view(np.int64)), pa.array(keys, pa.int32()), _lists(sketch, at)], names=["whole", "n", "fp", "keys", "least"]))
        kind = pa.struct([("whole", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("keys", pa.int32()), ("least", pa.list_(pa.int64()))])
        return pa.concat_arrays([x.cast(kind) for x in out]) if out else pa.array([], kind)

    return run


def _sets(size: int):
    """The set of a text and its fingerprint: the bits set in over half the set's hashes, repeats left out."""

    @F.arrow_udf("set array<long>, fp long")
    @freeing
    def run(column: pa.Array) -> pa.Array:
        out, kind = [], pa.struct([("set", pa.list_(pa.int64())), ("fp", pa.int64())])
        for part in _parts(column):
            value, edge = _shingles(part, size)
            fp = majority(value, np.repeat(np.arange(len(part)), np.diff(edge)), len(part))
            out.append(pa.StructArray.from_arrays([_lists(value, edge), pa.array(fp.view(np.int64))], names=["set", "fp"]).cast(kind))
        return pa.concat_arrays(out) if out else pa.array([], kind)

    return run


def overlaps(own: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """How many elements each of own shares with each of other; the elements of one array are distinct."""
    sets = [*own, *other]
    of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, place, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often > 1
    keep = shared[place]
    of, column = of[keep], (np.cumsum(shared) - 1)[place[keep]]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    out, step = np.zeros((len(own), len(other)), np.int64), 2048
    for lo in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(column, (lo, lo + step))
        has = np.zeros((len(sets), step), np.float32)
        has[of[a:b], column[a:b] - lo] = 1
        out += (has[: len(own)] @ has[len(own) :].T).astype(np.int64)
    return out


def _near(a_fp: np.ndarray, a_n: np.ndarray, b_fp: np.ndarray, b_n: np.ndarray, share: tuple[int, int], radius: int, few: int) -> np.ndarray:
    """Which pairs of two tiles have to be verified, as a matrix."""
    fit = (share[1] * a_n[:, None] >= share[0] * b_n[None, :]) & (share[1] * b_n[None, :] >= share[0] * a_n[:, None])
    small = (a_n < few)[:, None] | (b_n < few)[None, :]
    counts = np.bitwise_count(a_fp).astype(np.int64), np.bitwise_count(b_fp).astype(np.int64)
    if counts[0].min() - counts[1].max() > radius or counts[1].min() - counts[0].max() > radius:
        return fit & small
    return fit & (small | (np.bitwise_count(a_fp[:, None] ^ b_fp[None, :]) <= radius))


def _links(a_id: np.ndarray, a: list[np.ndarray], a_fp: np.ndarray, b_id: np.ndarray, b: list[np.ndarray], b_fp: np.ndarray, share: tuple[int, int], radius: int, few: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the pairs that are similar enough."""
    sizes = [np.array([len(x) for x in s], np.int64) for s in (a, b)]
    near = _near(a_fp, sizes[0], b_fp, sizes[1], share, radius, few)
    rows, cols = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = overlaps([a[i] for i in rows], [b[j] for j in cols])
    i, j = np.nonzero(near[np.ix_(rows, cols)] & (share[1] * both >= share[0] * (sizes[0][rows][:, None] + sizes[1][cols][None, :] - both)))
    return _forest(a_id, b_id, rows[i], cols[j])


def _forest(a_id: np.ndarray, b_id: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the pairs a_id[i], b_id[j]."""
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


def met(rows: DataFrame, name: str) -> DataFrame:
    """(key, chunk, chunks, row) to (key, own_rows, rows): every tile of a key with itself and every later one. The only tile of a key stands alone, with null rows, and is not sent again."""
    alone = rows.where("chunks = 1").groupBy("key").agg(F.collect_list("row").alias("own_rows"))
    alone = alone.select("key", "own_rows", F.lit(None).cast(alone.schema["own_rows"].dataType).alias("rows"))
    tiles = saved(rows.where("chunks > 1").groupBy("key", "chunk", "chunks").agg(F.collect_list("row").alias("rows")), name)
    left = tiles.select("key", F.explode(F.sequence("chunk", F.col("chunks") - 1)).alias("chunk"), F.col("rows").alias("own_rows"))
    return alone.union(left.join(tiles.select("key", "chunk", "rows"), ["key", "chunk"]).select("key", "own_rows", "rows"))


def agreed(least: int, share: tuple[int, int], lost: float = 1e-9) -> int:
    """So many of the `least` least hashes of the union of two sets lie in both, if they are similar, but with a probability below `lost`."""
    p, below = share[0] / share[1], 0.0
    for i in range(least + 1):
        below += math.comb(least, i) * p**i * (1 - p) ** (least - i)
        if below >= lost:
            return i
    return least


def in_common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of least hashes in order, padded, to how many of the least of each pair's union are seen and how many of these lie in both."""
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    again = np.zeros(both.shape, bool)
    again[:, 1:] = both[:, 1:] == both[:, :-1]
    seen = (np.cumsum(~again, axis=1) <= a.shape[1]) & (both != _PAD)
    return (seen & ~again).sum(1), (seen & again).sum(1)


def _alike(a: tuple, b: tuple, share: tuple[int, int], radius: int, few: int, agree: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the pairs of two tiles (id, n, fp, sketches) that have to be verified."""
    found, step = [(np.zeros(0, np.int64),) * 2], max(1, _CELLS // len(b[0]))
    for lo in range(0, len(a[0]), step):
        x = [v[lo : lo + step] for v in a]
        i, j = np.nonzero(_near(x[2], x[1], b[2], b[1], share, radius, few) & (x[0][:, None] != b[0][None, :]))
        for at in range(0, len(i), 1 << 14):
            p, q = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
            seen, common = in_common(x[3][p], b[3][q])
            pick = common * a[3].shape[1] >= agree * seen
            found.append((p[pick] + lo, q[pick]))
    return _forest(a[0], b[0], *(np.concatenate(v) for v in zip(*found, strict=True)))


def candidates(reps: DataFrame, share: tuple[int, int], tile: int, radius: int, few: int, least: int) -> DataFrame:
    """(whole, rep, n, fp, keys, least) to links (a, b) between reps that connect all that has to be verified: tiles of fingerprints and sketches."""
    keyed = saved(reps.select("whole", F.explode(F.slice("least", F.lit(1), F.col("keys"))).alias("key")), "similar-keys")
    chunks = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n_")).where("n_ > 1").select("key", F.ceil(F.col("n_") * (least + 3) / tile).alias("chunks"))
    places = saved(keyed.join(chunks, "key").select("key", "chunks", F.col("whole").alias("of")), "similar-places")
    dealt = places.join(reps, F.col("of") == F.col("whole")).select("key", F.pmod(F.xxhash64("rep"), "chunks").alias("chunk"), "chunks", F.struct("rep", "n", "fp", "least").alias("row"))
    agree = agreed(least, share)

    def side(rows: pa.Array) -> tuple:
        ids, n, fp, lists = rows.flatten()
        size = lists.value_lengths().to_numpy(zero_copy_only=False)
        sketch = np.full((len(ids), least), _PAD)
        sketch[np.arange(least) < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        return *(x.to_numpy(zero_copy_only=False) for x in (ids, n)), fp.to_numpy(zero_copy_only=False).view(np.uint64), sketch

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(np.zeros(0, np.int64),) * 2]
            for k in range(batch.num_rows):
                sides = [side(batch.column(c)[k].values) for c in ("own_rows", "rows") if batch.column(c)[k].is_valid]
                found.append(_alike(sides[0], sides[-1], share, radius, few, agree))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in zip(*found, strict=True)], names=["a", "b"])

    return met(dealt, "similar-prints").select("own_rows", "rows").mapInArrow(freeing_after(compare), "a long, b long").distinct()


def links(docs: DataFrame, groups: DataFrame, size: int, share: tuple[int, int], tile: int, most: int, radius: int, few: int) -> DataFrame:
    """(doc_id, text) and (node, component) of candidates to links (a, b) between nodes that connect what the similarity connects."""
    chosen = docs.join(groups, F.col("doc_id") == F.col("node")).select(F.col("component").alias("key"), F.col("node").alias("rep"), _sets(size)("text").alias("s"))
    chosen = saved(chosen.select("key", "rep", "s.set", "s.fp"), "similar-sets")
    chunks = chosen.groupBy("key").agg(F.greatest(F.ceil(F.sum(F.size("set")) / tile), F.ceil(F.count(F.lit(1)) / most)).alias("chunks")).where("chunks > 1")
    # a row for a tile's worth of sets at most; without a shuffle by key, which would bring a group's sets to one task
    rows = chosen.join(F.broadcast(chunks), "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.select("key", F.pmod(F.xxhash64("rep"), "chunks").alias("chunk"), "chunks", F.struct("rep", "set", "fp").alias("row"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for k in range(batch.num_rows):
                sides = []
                for name in ("own_rows", "rows"):
                    if not batch.column(name)[k].is_valid:
                        sides *= 2
                        break
                    ids, sets, fps = batch.column(name)[k].values.flatten()
                    edge = np.concatenate([[0], np.cumsum(sets.value_lengths().to_numpy(zero_copy_only=False))])
                    flat = sets.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                    sides += [ids.to_numpy(zero_copy_only=False), [flat[x:y] for x, y in zip(edge[:-1], edge[1:], strict=True)], fps.to_numpy(zero_copy_only=False).view(np.uint64)]
                p, q = _links(*sides, share, radius, few)
                a.append(p)
                b.append(q)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v) if v else [], pa.int64()) for v in (a, b)], names=["a", "b"])

    return met(rows, "similar-tiles").select("own_rows", "rows").mapInArrow(freeing_after(compare), "a long, b long").distinct()


def drop_similar(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, share: tuple[int, int] = (4, 5), keys: int = 12, tile: int = 1 << 17, most: int = 1024, radius: int = 26, few: int = 32, least: int = 32) -> DataFrame:
    """df without the documents that are not the first of their group, with df's columns; share is a fraction, as (4, 5). Rows without an id stay."""
    spark = df.sparkSession
    bounded_batches(spark)
    docs = narrow(df, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    least = max(least, keys)
    with scratch(spark):
        own = saved(docs.select("doc_id", _keys(size, share, keys, least)("text").alias("s")).select("doc_id", "s.*"), "similar-own")
        reps = saved(own.groupBy("whole").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "fp", "keys", "least")]), "similar-distinct")
        with scratch(spark):
            groups = saved(components(candidates(reps, share, tile, radius, few, least)), "similar-groups", keep=True)
        with scratch(spark):
            tree = saved(components(links(docs, groups, size, share, tile, most, radius, few)), "similar-links", keep=True)
        found = reps.join(tree, F.col("rep") == F.col("node"), "left").select(F.col("whole").alias("of"), F.coalesce("component", "rep").alias("component"))
        rest = saved(own.join(found, F.col("whole") == F.col("of")).where("doc_id <> component").select(F.col("doc_id").alias("\u0001id")).distinct(), "similar-rest", keep=True)
    return df.join(rest, F.col(f"`{doc_id}`").cast("long") == F.col("\u0001id"), "left_anti")
