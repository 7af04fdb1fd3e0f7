"""Operator 11: ranked lexical search by MaxScore with bounds of term pairs.

`build` reads every document once and makes an index of shards, runs of documents with about `shard_bytes` of
text, one row each: postings (documents and term counts) by term. `search` takes a table of queries, in blocks whose terms are
bounded, and for each block

- counts the documents of its terms over all shards, which gives their weights;
- prepares every shard for the block: the impact of each posting, the largest impact of each term, and, for pairs of terms that
  follow each other in a query's order of weights, the list of the documents that hold both with the largest impact of the two together;
- finds a threshold for each query from a few shards (the score of rank k among some documents is never above the true one);
- scores the documents of all shards that the bounds leave, and ranks the best k of all tasks.

Within a shard a query's terms ascend by weight. The bound of the first i terms is the least that single
maxima and pair bounds combine to; a pair's bound is what both terms reach together in its list, or the better one
alone. Documents that hold only terms below the threshold's place can't be among the best k. If the next two
terms can't lift such a document one at a time, only those of the pair's list are looked at. The others are scored, heaviest terms first,
and left as soon as the bound of the terms to come is too low. Bounds skip work and never a result.

Terms are runs of ASCII letters and digits and of characters beyond ASCII; A-Z are lower-cased. They are held as 64-bit hashes. Null texts and
queries have no terms; a query without a document has no rows. Ids of documents are integers or cast to them; rows of one id are
documents of their own, and a null id is last among equal scores. Each row of queries is a query. Empty tables give an empty result.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelframe.llm import words as W
from panelframe.llm.shared import bounded_batches, free_name, freeing_after, saved

#: Bytes that belong to no term.
OTHER = np.ones(256, bool)
OTHER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each term of each text."""
    data, offsets = W.utf8(column)
    starts, ends, rows = W.spans(data, offsets, OTHER)
    return W.range_hash(data, starts, ends, W.BYTE_LOWER), rows


def counted(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, how often), by hash and row; rows must not descend."""
    order = np.argsort(hashes, kind="stable")
    h, r = hashes[order], rows[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])])) if len(h) else np.zeros(0, np.int64)
    return h[first], r[first], np.diff(first, append=len(h))


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0]+1, .. (size[0] of them), begin[1], .."""
    to = np.cumsum(size)
    return np.arange(to[-1] if len(to) else 0) + np.repeat(begin - (to - size), size)


@dataclass(frozen=True)
class Index:
    shards: DataFrame
    documents: int
    terms: int


_SHARD = "shard bigint, ids array<bigint>, holding bigint, total bigint, sizes binary, terms binary, at binary, docs binary, counts binary"


def _index(shard_bytes: int):
    @freeing_after
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids: list[pa.Array] = []
        hashes: list[np.ndarray] = []
        rows: list[np.ndarray] = []
        held = size = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, hashes, rows, held, size, made
            h, r, c = counted(np.concatenate(hashes), np.concatenate(rows))
            sizes = np.bincount(r, c, held).astype("<i8")
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            blobs = (sizes, h[first].astype("<u8"), np.append(first, len(h)).astype("<i8"), r.astype("<i4"), c.astype("<i4"))
            own = pa.ListArray.from_arrays(pa.array([0, held], pa.int32()), pa.concat_arrays(ids))
            cols = [pa.array([(part << 32) + made]), own, pa.array([int((sizes > 0).sum())]), pa.array([int(sizes.sum())]), *[pa.array([x.tobytes()], pa.binary()) for x in blobs]]
            ids, hashes, rows, held, size, made = [], [], [], 0, 0, made + 1
            return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _SHARD.split(", ")])

        for batch in batches:
            for piece in W.slices(batch, "text"):
                h, r = terms(piece.column("text"))
                ids.append(piece.column("id"))
                hashes.append(h)
                rows.append(r + held)
                held += piece.num_rows
                size += piece.column("text").nbytes
                if size >= shard_bytes:
                    yield flush()
        if held:
            yield flush()

    return run


def build(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = 8 << 20) -> Index:
    """An index of all rows of df, in the shared folder."""
    bounded_batches(df.sparkSession)
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    shards = saved(docs.mapInArrow(_index(shard_bytes), _SHARD), "search-shards")
    n = shards.agg(F.sum("holding"), F.sum("total")).first()
    return Index(shards, n[0] or 0, n[1] or 0)


def _blob(row: dict, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(row[name], kind)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """A shard at a time; ids stay an Arrow array."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].values if name == "ids" else batch.column(name)[i].as_py() for name in batch.schema.names}


class Block:
    """Some queries: the distinct terms of all, and of each query its terms by weight with their numbers and pairs."""

    def __init__(self, rows: Sequence[tuple[int, list[int], list[int]]]):
        """rows: (query, terms' hashes as signed numbers, how often each)."""
        self.queries = [r[0] for r in rows]
        hashes = [np.array(r[1], np.int64).view(np.uint64) for r in rows]
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]))
        self.weight = np.zeros(len(self.vocabulary), np.int64)
        self.own = [(np.searchsorted(self.vocabulary, h), np.array(r[2], np.int64)) for h, r in zip(hashes, rows, strict=True)]
        self.pairs, self.a, self.b = [], np.zeros(0, np.int64), np.zeros(0, np.int64)

    def weigh(self, held: dict[int, int], documents: int) -> None:
        """held: in how many documents each number of the vocabulary is."""
        for i, n in held.items():
            self.weight[i] = math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1)))
        number: dict[tuple[int, int], int] = {}
        own, self.pairs = [], []
        for t, c in self.own:
            some = self.weight[t] > 0
            t, c = t[some], c[some]
            order = np.lexsort((t, self.weight[t] * c))
            t, c = t[order], c[order]
            own.append((t, c))
            self.pairs.append(np.array([number.setdefault(p, len(number)) for p in zip(t[:-1].tolist(), t[1:].tolist(), strict=True)], np.int64))
        self.own = own
        self.a, self.b = np.array(list(number), np.int64).reshape(-1, 2).T

    def find(self, shard_terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the vocabulary that a shard has, and their places in it."""
        at = np.minimum(np.searchsorted(shard_terms, self.vocabulary), max(0, len(shard_terms) - 1))
        has = np.flatnonzero(shard_terms[at] == self.vocabulary) if len(shard_terms) else np.zeros(0, np.int64)
        return has, at[has]


def _held(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(block.value.vocabulary), np.int64)
        for row in _rows(batches):
            has, at = block.value.find(_blob(row, "terms", "<u8"))
            total[has] += np.diff(_blob(row, "at", "<i8"))[at]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    return run


_PREPARED = "shard bigint, ids array<bigint>, has binary, at binary, docs binary, impact binary, best binary, pair binary, joint binary, pair_at binary, pair_docs binary"


def impacts(counts: np.ndarray, sizes: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What a term adds to a document's score, but for its weight."""
    m = 75 + (25 * sizes * documents) // max(1, total)
    return (1_000_000_000 * counts) // (1000 * counts + 12 * m)


def _prepare(block, documents: int, total: int):
    @freeing_after
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        for row in _rows(batches):
            has, place = b.find(_blob(row, "terms", "<u8"))
            edge = _blob(row, "at", "<i8")
            size = np.diff(edge)[place]
            pick = spread(edge[place], size)
            docs, counts = _blob(row, "docs", "<i4")[pick], _blob(row, "counts", "<i4")[pick].astype(np.int64)
            impact = impacts(counts, _blob(row, "sizes", "<i8")[docs], documents, total)
            at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
            best = np.maximum.reduceat(impact, at[:-1]) if len(has) else np.zeros(0, np.int64)
            slot = np.full(len(b.vocabulary), -1)
            slot[has] = np.arange(len(has))
            pair, joint, lists = [], [], []
            for p in np.flatnonzero((slot[b.a] >= 0) & (slot[b.b] >= 0)).tolist():
                x, y = sorted((int(b.a[p]), int(b.b[p])), key=lambda t: size[slot[t]])
                few, many = slice(at[slot[x]], at[slot[x] + 1]), slice(at[slot[y]], at[slot[y] + 1])
                where = np.minimum(np.searchsorted(docs[many], docs[few]), size[slot[y]] - 1)
                both = docs[many][where] == docs[few]
                if both.any():
                    pair.append(p)
                    joint.append(int((b.weight[x] * impact[few][both] + b.weight[y] * impact[many][where[both]]).max()))
                    lists.append(docs[few][both])
            pair_at = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
            blobs = (has.astype("<i4"), at, docs, impact.astype("<i4"), best.astype("<i8"), np.array(pair, "<i4"), np.array(joint, "<i8"), pair_at.astype("<i8"), np.concatenate([np.zeros(0, "<i4"), *lists]).astype("<i4"))
            own = pa.ListArray.from_arrays(pa.array([0, len(row["ids"])], pa.int32()), row["ids"])
            yield pa.RecordBatch.from_arrays([pa.array([row["shard"]]), own, *[pa.array([x.tobytes()], pa.binary()) for x in blobs]], names=[x.split()[0] for x in _PREPARED.split(", ")])

    return run


def pair_bounds(u: np.ndarray, c: np.ndarray, joint: np.ndarray) -> np.ndarray:
    """What each two terms that follow each other add at most: u by term for c occurrences in the query, joint for one of both (0: in no document)."""
    a, b, ca, cb = u[:-1], u[1:], c[:-1], c[1:]
    both = np.minimum(ca, cb)
    together = both * joint + (ca - both) * (a // ca) + (cb - both) * (b // cb)
    return np.maximum(np.maximum(a, b), np.where(joint > 0, together, 0))


def prefix_bounds(u: list[int], pairs: list[int]) -> list[int]:
    """The bound of the first i terms, for each i: the least that single bounds and bounds of disjoint pairs combine to."""
    out = [0]
    for i, x in enumerate(u):
        out.append(out[-1] + x if i == 0 else min(out[-1] + x, out[-2] + pairs[i - 1]))
    return out


def candidates(least: int, u: list[int], prefix: list[int]) -> tuple[int, bool]:
    """(s, paired): documents with none of the terms from s on have less than `least`; paired: so have those with only one of the terms s and s+1, and none after."""
    s = bisect.bisect_left(prefix, least) - 1
    return s, s + 1 < len(u) and prefix[s] + max(u[s], u[s + 1]) < least


class _Best:
    """The best k of a query so far in this task."""

    def __init__(self, k: int, least: int):
        self.k, self.least = k, max(1, least)
        self.score, self.id, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        s, i, n = np.concatenate([self.score, score]), np.concatenate([self.id, ids]), np.concatenate([self.null, null])
        order = np.lexsort((i, n, -s))[: self.k]
        self.score, self.id, self.null = s[order], i[order], n[order]
        if len(s) >= self.k:
            self.least = max(self.least, int(self.score[-1]))


def _search(block, k: int, least):
    @freeing_after
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        best = [_Best(k, x) for x in least.value]
        for row in _rows(batches):
            has, at, docs, impact = _blob(row, "has", "<i4"), _blob(row, "at", "<i8").tolist(), _blob(row, "docs", "<i4"), _blob(row, "impact", "<i4").astype(np.int64)
            slot = np.full(len(b.vocabulary), -1)
            slot[has] = np.arange(len(has))
            most = np.zeros(len(b.vocabulary), np.int64)
            most[has] = _blob(row, "best", "<i8") * b.weight[has]
            joint, pair_slot = np.zeros(len(b.a), np.int64), np.full(len(b.a), -1)
            pair = _blob(row, "pair", "<i4")
            joint[pair], pair_slot[pair] = _blob(row, "joint", "<i8"), np.arange(len(pair))
            pair_at, pair_docs = _blob(row, "pair_at", "<i8"), _blob(row, "pair_docs", "<i4")
            null = row["ids"].is_null().to_numpy(zero_copy_only=False)
            ids = row["ids"].fill_null(0).to_numpy(zero_copy_only=False)
            for (t, c), pairs, top in zip(b.own, b.pairs, best, strict=True):
                u = most[t] * c
                us = u.tolist()
                prefix = prefix_bounds(us, pair_bounds(u, c, joint[pairs]).tolist() if len(t) > 1 else [])
                if prefix[-1] < top.least:
                    continue
                s, paired = candidates(top.least, us, prefix)
                score, seen = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
                slots, factor = slot[t].tolist(), (b.weight[t] * c).tolist()
                begin = s + 2 if paired else s
                for j in range(begin, len(us)):
                    if us[j]:
                        x = slice(at[slots[j]], at[slots[j] + 1])
                        score[docs[x]] += factor[j] * impact[x]
                        seen[docs[x]] = True
                if paired and (p := pair_slot[pairs[s]]) >= 0:
                    seen[pair_docs[pair_at[p] : pair_at[p + 1]]] = True
                left = np.flatnonzero(seen)
                found = score[left]
                for j in range(begin - 1, -1, -1):
                    keep = found + prefix[j + 1] >= top.least
                    left, found = left[keep], found[keep]
                    if not len(left):
                        break
                    if us[j]:
                        own = docs[at[slots[j]] : at[slots[j] + 1]]
                        where = np.minimum(np.searchsorted(own, left), len(own) - 1)
                        found = found + np.where(own[where] == left, factor[j] * impact[at[slots[j]] + where], 0)
                keep = found >= top.least
                if keep.any():
                    left = left[keep]
                    top.add(found[keep], ids[left], null[left])
        for q, x in zip(b.queries, best, strict=True):
            if len(x.score):
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(x.score), pa.int64()), pa.array(x.id, mask=x.null), pa.array(x.score)], names=["query", "doc_id", "score"])

    return run


_FOUND = "query bigint, doc_id bigint, score bigint"


def _queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h, r, c = counted(*terms(batch.column("text")))
        order = np.argsort(r, kind="stable")
        at = pa.array(W.bounds(r[order], batch.num_rows).astype(np.int32))
        cols = [pa.ListArray.from_arrays(at, pa.array(x[order].astype("<i8") if x.dtype != np.uint64 else x[order].view(np.int64))) for x in (h, c)]
        yield pa.RecordBatch.from_arrays([batch.column("query"), *cols], names=["query", "terms", "counts"])


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The best k of each query, with their ranks."""
    by = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, text: str = "text", k: int = 20, block_terms: int = 1 << 19) -> DataFrame:
    """queries' columns but the text (of each query, its best k documents' rows), rank, doc_id and score (own columns of these names are replaced)."""
    spark = queries.sparkSession
    bounded_batches(spark)
    row = free_name(queries, "query")
    asked = saved(queries.withColumn(row, F.monotonically_increasing_id()), "search-queries")
    coded = asked.select(F.col(row).alias("query"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(_queries, "query bigint, terms array<bigint>, counts array<bigint>")
    coded = saved(coded, "search-terms")
    blocks = max(1, -(-(coded.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms))
    n = max(1, index.shards.count())
    step = math.isqrt(n - 1) + 1
    out = None
    for i in range(blocks):  # a block's terms are bounded; one with all queries is the usual case
        own = coded.where((F.pmod(F.xxhash64("query"), F.lit(blocks)) == i) & (F.size("terms") > 0)).collect()
        block = Block([(r.query, r.terms, r.counts) for r in own])
        sent = spark.sparkContext.broadcast(block)
        held = index.shards.select("terms", "at").mapInArrow(_held(sent), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
        block.weigh({r.term: r.n for r in held.collect()}, index.documents)
        sent = spark.sparkContext.broadcast(block)
        prepared = saved(index.shards.mapInArrow(_prepare(sent, index.documents, index.terms), _PREPARED), "search-prepared")
        none = spark.sparkContext.broadcast([0] * len(block.queries))
        some = prepared.where(F.pmod(F.xxhash64("shard"), F.lit(step)) == 0).mapInArrow(_search(sent, k, none), _FOUND)
        least = {r.query: r.score for r in ranked(some, k).where(F.col("rank") == k).select("query", "score").collect()}
        least = spark.sparkContext.broadcast([least.get(q, 0) for q in block.queries])
        found = saved(prepared.mapInArrow(_search(sent, k, least), _FOUND), "search-found")
        out = found if out is None else out.unionByName(found)
    made = ("rank", "doc_id", "score")
    best = ranked(out, k).select(F.col("query").alias("\u0001query"), *made)
    keep = [c for c in queries.columns if c != text and c not in made]
    mine = asked.select(*[F.col(f"`{c}`") for c in (*keep, row)])
    return mine.join(best, F.col(row) == F.col("\u0001query")).select(*[F.col(f"`{c}`") for c in keep], *made)
