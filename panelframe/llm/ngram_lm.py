"""Operator 2: n-gram language model as an Elias-Fano trie in memory-mapped levels.

Level 1 holds the hashes of the training words in order, as Elias-Fano sequences, with
their exact counts; a word's id is its rank. Level k holds for every context (a rank of
level k-1) the ids that follow it: an Elias-Fano sequence of context-relative values
(context times vocabulary plus id, which only rises), an Elias-Fano sequence of pointers
to where each context begins, and in 16 bits each the discounted probability of every
successor and the back-off weight of every context; a shard's head holds the step that its least probability asks for. A query
searches the successor within its context's range.

Probabilities interpolate: p_k = discounted_k + weight_k * p_(k-1), with absolute
discounting; p_1 = (c + 1) / (N + V + 1), so that unknown words get a share.

Counts are made in Spark: tasks count what they read and send sorted keys, packed, to
cells, which are narrow ranges of contexts; large pieces are dealt out by hash of the gram as well, so that a
frequent context's partial counts meet in several tasks, and a task folds them as they stream by: it holds distinct grams only.
Neighbouring cells then make shards of about equal numbers of grams; a shard is built by one task and written under the
shared folder, which workers map into memory: it has to be a folder that they
can open (a plain path or file:); a mark that the driver leaves there has to be seen by tasks. What one context has of distinct
successors lies in one shard. The number of shards grows with the tokens, and from 2**38 of them on with their root; where shards
begin is in files that tasks map as well (`directory`): the driver holds three numbers a level.

Null and empty texts have no words and one end. Documents with a null doc_id have no
remainder: they are held out. An empty training set leaves every token unknown. Extra
columns are not looked at.
"""

from __future__ import annotations

import functools
import json
import math
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelframe.llm import words as W
from panelframe.llm.shared import bounded_batches, new_path, partitions, saved

U64 = np.uint64
END = np.uint64(0x5BD1E9955BD1E995)  # the hash that stands for the end of a text
_SELECT = np.array([[([i for i in range(8) if b >> i & 1] + [8] * 8)[k] for k in range(8)] for b in range(256)], np.int64)
_ONES, _TOPS = U64(0x0101010101010101), U64(0x8080808080808080)


def _set_bits(at: np.ndarray, n_words: int) -> np.ndarray:
    out = np.zeros(n_words, U64)
    np.add.at(out, at >> 6, U64(1) << (at & 63).astype(U64))
    return out


def ef_build(values: np.ndarray, universe: int, name: str) -> dict[str, np.ndarray]:
    """Arrays of an Elias-Fano sequence of nondecreasing values below universe."""
    n = len(values)
    low_bits = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
    values = values.astype(U64)
    high = (values >> U64(low_bits)).astype(np.int64)
    size = n + (max(universe - 1, 0) >> low_bits) + 2
    n_words = -(-size // 512) * 8
    bits = _set_bits(high + np.arange(n), n_words)
    ones = np.bitwise_count(bits)
    low = np.zeros(n * low_bits // 64 + 2, U64)
    if low_bits and n:
        part = values & U64((1 << low_bits) - 1)
        at = np.arange(n, dtype=np.int64) * low_bits
        shift = (at & 63).astype(U64)
        np.add.at(low, at >> 6, part << shift)
        np.add.at(low, (at >> 6) + 1, (part >> U64(1)) >> (U64(63) - shift))
    before = np.cumsum(ones, dtype=np.int64) - ones
    if n_words << 6 >= 2**32:
        raise ValueError("a sequence of this length asks for more shards")
    return {f"{name}.low": low, f"{name}.high": bits, f"{name}.ones": before.astype(np.uint32), f"{name}.zeros": (np.arange(n_words) * 64 - before).astype(np.uint32), f"{name}.bits": np.array([low_bits, n])}


def _place(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) one of each word: prefix counts of its bytes, all eight at once."""
    c = words - (words >> U64(1) & U64(0x5555555555555555))
    c = (c & U64(0x3333333333333333)) + (c >> U64(2) & U64(0x3333333333333333))
    c = (c + (c >> U64(4)) & U64(0x0F0F0F0F0F0F0F0F)) * _ONES
    byte = np.minimum(np.bitwise_count((k * _ONES | _TOPS) - c & _TOPS), 7).astype(U64) << U64(3)
    rest = k - (c << U64(8) >> byte & U64(0xFF))
    return byte.astype(np.int64) + _SELECT[(words >> byte & U64(0xFF)).astype(np.int64), np.minimum(rest, U64(7)).astype(np.int64)]


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.low, self.high, self.ones, self.zeros = (arrays[f"{name}.{x}"] for x in ("low", "high", "ones", "zeros"))
        self.bits, self.n = map(int, arrays[f"{name}.bits"])

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the k-th (from 0) one or zero."""
        directory = self.ones if ones else self.zeros
        word = np.searchsorted(directory, k.astype(np.uint32), "right") - 1
        words = self.high[word]
        return word * 64 + _place(words if ones else ~words, (k - directory[word]).astype(U64))

    def _next_zero(self, at: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Place of the zero after the k-th, which is at `at`."""
        rest = ~self.high[at >> 6] >> (at & 63).astype(U64) >> U64(1)
        out = at + 1 + np.bitwise_count((rest & (~rest + U64(1))) - U64(1))
        far = np.flatnonzero(rest == 0)
        if len(far):
            out[far] = self._select(k[far] + 1, False)
        return out

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i * self.bits
        shift = (at & 63).astype(U64)
        x = (self.low[at >> 6] >> shift) | ((self.low[(at >> 6) + 1] << U64(1)) << (U64(63) - shift))
        return x & U64((1 << self.bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at the places i."""
        return ((self._select(i, True) - i).astype(U64) << U64(self.bits)) | self._low(i)

    def find(self, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """Place of each value, -1 where it is absent: the first place at or after lo whose value is no less."""
        if not self.n or not len(x):
            return np.full(len(x), -1, np.int64)
        high = (x >> U64(self.bits)).astype(np.int64)
        zero = self._select(np.maximum(high - 1, 0), False)
        b = np.where(high > 0, zero + 1 - high, 0)
        e = np.where(high > 0, self._next_zero(zero, np.maximum(high - 1, 0)) - high, zero)
        if lo is not None:
            b, e = np.maximum(b, lo), np.minimum(e, hi)
        end, want = e.copy(), x & U64((1 << self.bits) - 1)
        live = np.flatnonzero(b < e)
        while len(live):
            mid = (b[live] + e[live]) >> 1
            less = self._low(mid) < want[live]
            b[live[less]] = mid[less] + 1
            e[live[~less]] = mid[~less]
            live = live[b[live] < e[live]]
        out = np.full(len(x), -1, np.int64)
        ok = np.flatnonzero(b < end)
        ok = ok[self._low(b[ok]) == want[ok]]
        out[ok] = b[ok]
        return out


def write_arrays(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: a head that names the arrays, then the arrays. It appears whole or not at all."""
    head, at = {}, 0
    for k, v in arrays.items():
        head[k] = [v.dtype.str, len(v), at]
        at += -(-v.nbytes // 64) * 64
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(len(text).to_bytes(8, "little") + text)
        for v in arrays.values():
            f.write(v.tobytes() + b"\0" * (-v.nbytes % 64))
    os.replace(part, path)


def map_arrays(path: str) -> dict[str, np.ndarray]:
    body = np.memmap(path, np.uint8, "r")
    n = int.from_bytes(body[:8].tobytes(), "little")
    head = json.loads(body[8 : 8 + n].tobytes())
    return {k: np.frombuffer(body, np.dtype(t), size, 8 + n + at) for k, (t, size, at) in head.items()}


@dataclass(frozen=True)
class Level:
    """The number of shards and of grams. Where each shard's ranks (`starts`) and contexts (`edges`) begin is in files that tasks map."""

    shards: int
    size: int


@dataclass(frozen=True)
class Trie:
    folder: str
    levels: tuple[Level, ...]
    tokens: int

    @property
    def words(self) -> int:
        return self.levels[0].size if self.levels else 0


@functools.lru_cache(64)
def directory(folder: str, level: int, what: str) -> np.ndarray:
    """One place more than shards; 8 bytes each, mapped."""
    return map_arrays(f"{folder}/{level}-{what}")["places"]


@functools.lru_cache(512)  # what falls out is unmapped
def _shard(folder: str, level: int, shard: int) -> dict:
    arrays = map_arrays(f"{folder}/{level}-{shard}")
    return {"arrays": arrays, "keys": EliasFano(arrays, "keys"), "pointers": EliasFano(arrays, "pointers") if "pointers.low" in arrays else None, "scale": float(arrays["scale"][0]) if "scale" in arrays else 1.0}


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    edges = np.flatnonzero(np.diff(shard[order], prepend=-1)).tolist() + [len(order)]
    for lo, hi in zip(edges, edges[1:], strict=False):
        yield int(shard[order[lo]]), order[lo:hi]


def word_ids(trie: Trie, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id (-1: unknown) and training count of each hash."""
    ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
    if not trie.words:
        return ids, counts
    bits, starts = trie.levels[0].shards.bit_length() - 1, directory(trie.folder, 1, "starts")
    shard = (hashes >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
    for s, at in _by_shard(shard):
        if starts[s] == starts[s + 1]:
            continue
        own = _shard(trie.folder, 1, s)
        place = own["keys"].find(hashes[at] & U64((1 << (64 - bits)) - 1))
        ok = place >= 0
        ids[at[ok]] = place[ok] + starts[s]
        counts[at[ok]] = own["arrays"]["counts"][place[ok]]
    return ids, counts


def follow(trie: Trie, level: int, contexts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For contexts of a level and the ids after them: rank in the level (-1: absent), discounted probability, back-off weight."""
    rank, p, weight = np.full(len(ids), -1, np.int64), np.zeros(len(ids)), np.ones(len(ids))
    starts, edges, span = directory(trie.folder, level, "starts"), directory(trie.folder, level, "edges"), trie.words + 1
    known = np.flatnonzero(contexts >= 0)
    each, back = np.unique(contexts[known], return_inverse=True)  # few contexts make many tokens
    shards = np.searchsorted(edges, each, "right") - 1
    first, size = np.zeros(len(each), np.int64), np.zeros(len(each), np.int64)
    back_off = np.ones(len(each))
    for s, at in _by_shard(shards):
        if starts[s] < starts[s + 1]:
            own, c = _shard(trie.folder, level, s), each[at] - edges[s]
            edge = own["pointers"].access(np.concatenate([c, c + 1])).astype(np.int64)
            first[at], size[at] = edge[: len(c)], edge[len(c) :] - edge[: len(c)]
            back_off[at] = np.exp2(own["arrays"]["weights"][c] / -own["scale"])
    weight[known] = back_off[back]
    seen = (ids[known] >= 0) & (size[back] > 0)
    at, context, back = known[seen], contexts[known[seen]], back[seen]
    for s, some in _by_shard(shards[back]):
        own, at_, of = _shard(trie.folder, level, s), at[some], back[some]
        key = (context[some] - edges[s]).astype(U64) * U64(span) + ids[at_].astype(U64)
        place = own["keys"].find(key, first[of], first[of] + size[of])
        ok = place >= 0
        rank[at_[ok]] = place[ok] + starts[s]
        p[at_[ok]] = np.exp2(own["arrays"]["values"][place[ok]] / -own["scale"])
    return rank, p, weight


def _bits(x: np.ndarray) -> np.ndarray:
    return -np.log2(x)


def _quantised(bits: np.ndarray, scale: float) -> np.ndarray:
    return np.rint(bits * scale).astype(np.uint16)


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and the end of each text, one after another; the row of each."""
    data, offsets = W.utf8(column)
    starts, ends, rows = W.spans(data, offsets)
    hashes, n = W.range_hash(data, starts, ends, W.BYTE_LOWER), len(offsets) - 1
    at = np.arange(len(hashes)) + rows
    out, of = np.full(len(hashes) + n, END, U64), np.zeros(len(hashes) + n, np.int64)
    out[at] = hashes
    of[at] = rows
    tail = W.bounds(rows, n)[1:] + np.arange(n)
    of[tail] = np.arange(n)
    return out, of


def _coded(trie: Trie, column: pa.Array) -> tuple[np.ndarray, ...]:
    """Ids, counts and rows of all tokens of the texts."""
    hashes, rows = _tokens(column)
    each, back = np.unique(hashes, return_inverse=True)
    ids, counts = word_ids(trie, each)
    return ids[back], counts[back], rows


def _ranks(trie: Trie, ids: np.ndarray, rows: np.ndarray, level: int) -> np.ndarray:
    """For each token the rank, in the level, of the gram that ends before it; -1 if none. The word before a first word is the end."""
    first = np.concatenate([[True], rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, bool)
    end = int(word_ids(trie, np.array([END]))[0][0])
    before = np.concatenate([[end], ids[:-1]]) if len(ids) else ids
    before = np.where(first, end, before)
    if level == 1:
        return before
    shorter = _ranks(trie, ids, rows, level - 1)
    past = np.concatenate([[-1], shorter[:-1]]) if len(ids) else shorter
    past = np.where(first, -1, past)
    return follow(trie, level, past, before)[0]


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as gaps, and counts, in byte planes: eight each, of which most are zeros."""
    return zstandard.ZstdCompressor(level=1).compress(len(keys).to_bytes(8, "little") + _planes(np.diff(keys, prepend=U64(0))) + _planes(counts))


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(body[:8], "little")
    gaps, counts = (np.ascontiguousarray(np.frombuffer(body, np.uint8, 8 * n, 8 + at).reshape(8, n).T).view("<u8").reshape(-1) for at in (0, 8 * n))
    return np.cumsum(gaps, dtype=U64), counts.astype(np.int64)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate([*keys, np.zeros(0, U64)]), np.concatenate([*counts, np.zeros(0, np.int64)])
    order = np.argsort(k)
    k, c = k[order], c[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[at], np.add.reduceat(c, at) if len(at) else c


_PART = "cell long, bucket int, payload binary"
_LARGE = 1 << 14  # keys of a piece that is dealt out by hash as well


def _pieces(cell: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    if len(keys) < _LARGE:
        yield cell, -1, _pack(keys, counts)
        return
    for bucket, at in _by_shard((W.mix(keys) >> U64(60)).astype(np.int64)):
        yield cell, bucket, _pack(keys[at], counts[at])


def _rows(rows: list, names=("cell", "bucket", "payload"), kinds=(pa.int64(), pa.int32(), pa.binary())) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names=list(names))


def _counted(docs: DataFrame, keys_of, cell_of, most: int = 4_000_000) -> DataFrame:
    """Packed (key, count) pieces by cell: keys_of an Arrow text column, counted in the task before they are sent."""

    def flush(keys: list, counts: list) -> pa.RecordBatch:
        k, c = _merged(keys, counts)
        return _rows([x for cell, at in _by_shard(cell_of(k)) for x in _pieces(cell, k[np.sort(at)], c[np.sort(at)])] if len(k) else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for batch in batches:
            for part in W.slices(batch, "text", 4 << 20):
                k, c = np.unique(keys_of(part.column("text")), return_counts=True)
                keys.append(k)
                counts.append(c)
                held += len(k)
                if held >= most:
                    yield flush(keys, counts)
                    keys, counts, held = [], [], 0
        if held:
            yield flush(keys, counts)

    return docs.mapInArrow(run, _PART)


def _folded(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of packed rows, merged whenever as many have come as are held."""
    keys, counts = np.zeros(0, U64), np.zeros(0, np.int64)
    more, held = ([], []), 0
    for batch in batches:
        for payload in batch.column("payload"):
            k, c = _unpack(payload.as_py())
            more[0].append(k)
            more[1].append(c)
            held += len(k)
            if held > max(len(keys), 1 << 18):
                keys, counts = _merged([keys, *more[0]], [counts, *more[1]])
                more, held = ([], []), 0
    return _merged([keys, *more[0]], [counts, *more[1]])


def _merge(parts: DataFrame, name: str) -> DataFrame:
    """The partial counts of each cell and bucket as one row: cell, n (its distinct keys) and payload; saved."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = _folded(batches)
        yield _rows([(key[0].as_py(), len(keys), _pack(keys, counts))], ("cell", "n", "payload"), (pa.int64(), pa.int64(), pa.binary()))

    return saved(parts.groupBy("cell", "bucket").applyInArrow(run, "cell long, n long, payload binary"), name)


_MADE = "shard long, size long, total long"


def _build(parts: DataFrame, build, folder: str, level: int, shards: int) -> tuple[int, int]:
    """Builds each shard's file from its packed rows and the file of their starts; the grams and the counts of all."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = _folded(batches)
        shard = key[0].as_py()
        yield _rows([(shard, build(shard, keys, counts), int(counts.sum()))], ("shard", "size", "total"), (pa.int64(),) * 3)

    made = saved(parts.groupBy("shard").applyInArrow(run, _MADE), f"ngrams-{level}-made")

    def starts(shard: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.zeros(shards + 1, np.int64)
        out[shard + 1] = size
        return np.cumsum(out)

    _write_directory(made.select("shard", "size"), f"{folder}/{level}-starts", starts)
    row = made.agg(F.sum("size"), F.sum("total")).first()
    return row[0] or 0, row[1] or 0


def _write_directory(table: DataFrame, path: str, places) -> None:
    """Two columns of longs, a row a shard, to a file of places: one task, 16 bytes a shard, and shards grow with the root of the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = [[], []]
        for b in batches:
            for i in (0, 1):
                cols[i].append(b.column(i).to_numpy(zero_copy_only=False))
        none = np.zeros(0, np.int64)
        write_arrays(path, {"places": places(np.concatenate([none, *cols[0]]), np.concatenate([none, *cols[1]]))})
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], names=["done"])

    table.repartition(1).mapInArrow(run, "done long").collect()


_BLOCK = 4096


def _cut(sizes: DataFrame, shards: int) -> DataFrame:
    """(cell, n) to (cell, shard): neighbours together, about equal in grams; a cell above the mean stands alone or ends a shard.

    Running sums in two steps: over blocks of cells, and within each block.
    """
    total = sizes.agg(F.sum("n")).first()[0] or 0
    mean = max(1, -(-total // shards))
    block = sizes.withColumn("block", F.floor(F.col("cell") / _BLOCK))
    sums = block.groupBy("block").agg(F.sum("n").alias("own"))
    before = sums.select("block", (F.sum("own").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("own")).alias("before"))  # a row a block
    inside = F.sum("n").over(Window.partitionBy("block").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return block.withColumn("inside", inside).join(before, "block").select("cell", F.floor((F.col("inside") + F.col("before")) / mean).alias("shard"))


def _folder(spark) -> str:
    """A new folder that tasks can open, in the shared one."""
    folder = new_path(spark, "ngrams")
    local = folder.removeprefix("file://") if folder.startswith("file:///") else folder.removeprefix("file:")
    if "://" in local:
        raise ValueError(f"workers map the levels into memory; {folder} is not a folder that they can open")
    os.makedirs(local, exist_ok=True)
    with open(f"{local}/mark", "w") as f:
        f.write(local)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([os.path.exists(f"{local}/mark")] * batch.num_rows)], names=["seen"])

    if not spark.range(partitions(spark), numPartitions=partitions(spark)).mapInArrow(run, "seen boolean").agg(F.min("seen")).first()[0]:
        raise ValueError(f"{local} is not shared: a task does not see what the driver wrote there")
    return local


def train(docs: DataFrame, order: int = 3, shard_tokens: int = 1 << 21) -> Trie:
    """The trie of the texts (column text) of docs. A shard takes about shard_tokens tokens, or one frequent context; from 2**38 tokens on four times their root."""
    spark = docs.sparkSession
    bounded_batches(spark)
    local = _folder(spark)
    # about one token to six bytes; the size sets the shards alone
    length = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    each = shard_tokens if length // 6 < 1 << 38 else max(shard_tokens, 4 * math.isqrt(length // 6))
    shards = 1 << max(3, (length // 6 // each).bit_length())
    bits = shards.bit_length() - 1

    def first(shard: int, keys: np.ndarray, counts: np.ndarray) -> int:
        keys = keys & U64((1 << (64 - bits)) - 1)
        write_arrays(f"{local}/1-{shard}", ef_build(keys, 1 << (64 - bits), "keys") | {"counts": counts})
        return len(keys)

    parts = _counted(docs, lambda t: _tokens(t)[0], lambda k: (k >> U64(64 - bits)).astype(np.int64))
    words, tokens = _build(parts.select(F.col("cell").alias("shard"), "payload"), first, local, 1, shards)
    trie = Trie(local, (Level(shards, words),), tokens)
    for level in range(2, order + 1):
        if not trie.words:
            break
        contexts, span = trie.levels[-1].size, trie.words + 1
        if contexts * span >= 2**64:
            raise ValueError("grams of this order pass 64 bits")
        cells = min(contexts, 16 * shards)
        width = -(-contexts // cells)

        def keys_of(column: pa.Array, trie=trie, level=level, span=span) -> np.ndarray:
            ids, _, rows = _coded(trie, column)
            past = _ranks(trie, ids, rows, level - 1)
            ok = past >= 0
            return past[ok].astype(U64) * U64(span) + ids[ok].astype(U64)

        merged = _merge(_counted(docs, keys_of, lambda k, span=span, width=width: (k // U64(span)).astype(np.int64) // width), f"ngrams-{level}")
        shard_of = saved(_cut(merged.groupBy("cell").agg(F.sum("n").alias("n")), shards), f"ngrams-{level}-cells")

        def edges(shard: np.ndarray, cell: np.ndarray, contexts=contexts, width=width) -> np.ndarray:
            out = np.full(shards + 1, contexts, np.int64)
            out[shard] = cell * width
            out[0] = 0
            return np.minimum.accumulate(out[::-1])[::-1]  # a shard without cells begins where the next one does

        _write_directory(shard_of.groupBy("shard").agg(F.min("cell").alias("cell")), f"{local}/{level}-edges", edges)

        def build(shard: int, keys: np.ndarray, counts: np.ndarray, level=level, span=span) -> int:
            edges = directory(local, level, "edges")
            context = (keys // U64(span)).astype(np.int64) - edges[shard]
            n = int(edges[shard + 1] - edges[shard])
            once, twice = int((counts == 1).sum()), int((counts == 2).sum())
            discount = min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)
            total, kinds = np.bincount(context, counts, n), np.bincount(context, minlength=n)
            values, weights = _bits((counts - discount) / total[context]), _bits(np.where(kinds > 0, discount * kinds / np.maximum(total, 1), 1.0))
            scale = min(4096.0, 65535 / max(float(values.max(initial=0)), float(weights.max(initial=0)), 1e-9))
            arrays = ef_build(keys - U64(edges[shard]) * U64(span), n * span, "keys")
            arrays |= ef_build(np.concatenate([[0], np.cumsum(kinds)]), len(keys) + 1, "pointers")
            arrays |= {"values": _quantised(values, scale), "weights": _quantised(weights, scale), "scale": np.array([scale])}
            write_arrays(f"{local}/{level}-{shard}", arrays)
            return len(keys)

        grams, _ = _build(merged.join(shard_of, "cell").select("shard", "payload"), build, local, level, shards)
        trie = Trie(local, (*trie.levels, Level(shards, grams)), trie.tokens)
    return trie


def _scores(trie: Trie, column: pa.Array) -> list[pa.Array]:
    n = len(column)
    ids, counts, rows = _coded(trie, column)
    p = (counts + 1) / (trie.tokens + trie.words + 1)
    base = np.bincount(rows, np.log10(p), n)
    past = _ranks(trie, ids, rows, 1)
    first = np.concatenate([[True], rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, bool)
    for level in range(2, len(trie.levels) + 1):
        rank, own, weight = follow(trie, level, past, ids)
        p = own + weight * p
        past = np.where(first, -1, np.concatenate([[-1], rank[:-1]])) if len(rank) else rank
    score = np.bincount(rows, np.log10(p), n)
    return [pa.array(np.bincount(rows, minlength=n), pa.int64()), pa.array(np.bincount(rows, counts > 0, n).astype(np.int64)), pa.array(base), pa.array(score)]


def score(trie: Trie, text: Column | str) -> Column:
    """Struct of n_tokens, n_known, base_score and score (log10 probability) of each text."""
    names = ["n_tokens", "n_known", "base_score", "score"]

    def run(column: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([column], names=["text"])
        parts = [_scores(trie, p.column("text")) for p in W.slices(batch, "text", 4 << 20)]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.StructArray.from_arrays([pa.concat_arrays([p[i] for p in parts]) if parts else pa.array([], kinds[i]) for i in range(4)], names=names)

    return F.arrow_udf(run, "n_tokens long, n_known long, base_score double, score double")(text)


def held_out(doc_id: Column | str, modulus: int = 7, remainder: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % modulus == remainder, F.lit(True))
