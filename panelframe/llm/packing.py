"""Operator 12: packing documents into sequences of tokens by best-fit decreasing.

A document is its token ids and an end id. One that is longer than a sequence is cut into
pieces of the full length, of which the first may be shorter; no other is cut. Pieces are placed
from the longest to the shortest, each into the open sequence with the least room that holds it, which a
segment tree over remaining capacities finds in time logarithmic in the capacity.

Only a piece's length matters to where it goes, so that the pieces of one length are placed as a run:
`plan` gets their number for each length (at most `capacity` numbers, whatever the size of the data), finds
the tightest room for the first piece of a run, and fills all sequences of that room at once, as placing piece after piece would.
Its runs say which pieces of a length go where, by their rank among all pieces of that length. Tasks
number their own pieces while they encode, and running sums over tasks make ranks of these numbers:
no piece is moved or gathered to be packed, and the sequences are those of one machine with all pieces.

Ids are those of the tokenizers library for a byte-level BPE file without special tokens added (the string of a special token
that stands in a text is that token, as there). They come from tiktoken with the file's merges, which is
faster; a text with white space too long for its pattern is split by the regex library.

Null and empty texts are the end id alone. Rows may repeat and ids be null: each row is a document. An empty table gives an
empty result. df's other columns don't matter.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelframe.llm.shared import bounded_batches, freeing_after, saved

#: Fixed value: the pattern of pre-tokens that byte-level BPE files without one of their own use.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_tokenizer(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _byte_of() -> dict[str, int]:
    """The characters that stand for bytes in such files: printable ones for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


@functools.lru_cache(2)
def coders(raw: bytes) -> tuple[tiktoken.Encoding, tiktoken.Encoding, dict[str, int]]:
    """The encodings of whole texts and of one pre-token, and the special tokens."""
    said, byte = json.loads(raw), _byte_of()
    pre, model = said["pre_tokenizer"], said["model"]
    special = {x["content"]: x["id"] for x in said["added_tokens"]}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [model["vocab"]["".join(m)] for m in pairs]
    if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or said["normalizer"] or made != sorted(made):
        raise ValueError("not a byte-level BPE file whose ids follow its merges")
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    return tiktoken.Encoding("texts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special), tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}), special


def encode(raw: bytes, text: str) -> np.ndarray:
    texts, words, special = coders(raw)
    try:
        return texts.encode_to_numpy(text, allowed_special="all")
    except ValueError:  # the pattern's stack ends on very long white space
        split = regex.split("(" + "|".join(map(regex.escape, special)) + ")", text) if special else [text]
        parts = [np.array([special[x]]) if x in special else words.encode_to_numpy(w) for x in split for w in ([x] if x in special else regex.findall(PATTERN, x))]
        return np.concatenate([np.zeros(0, np.uint32), *parts]).astype(np.uint32)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


class Rooms:
    """Open sequences by remaining capacity: runs of consecutive ones at the leaves of a segment tree that says where any are."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, first: int, n: int) -> None:
        if n and room:
            self.runs[room].append((first, n))
            at = room + self.size
            while at and not self.any[at]:
                self.any[at], at = 1, at >> 1

    def take(self, least: int) -> tuple[int, int, int] | None:
        """(room, first, n) of a run with the least room that is `least` or more."""
        at = least + self.size
        while not self.any[at]:
            while at & 1:  # on to the next subtree on the right
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.size:
            at = 2 * at + (not self.any[2 * at])
        room = at - self.size
        first, n = self.runs[room].pop()
        while at and not (self.runs[room] if at >= self.size else self.any[2 * at] or self.any[2 * at + 1]):
            self.any[at], at = 0, at >> 1
        return room, first, n


def plan(counts: Sequence[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, rank, n, sequence, offset) runs: pieces rank..rank+n-1 of a length go to n sequences from `sequence` on, at offset.

    counts[length] pieces are to be placed. The runs of a length ascend by rank.
    """
    rooms, out, opened = Rooms(capacity), [], 0
    for length in range(capacity, 0, -1):
        left = counts[length] if length < len(counts) else 0
        rank = 0
        while left:
            room, first, n = rooms.take(length) or (capacity, opened, left)
            each = room // length  # pieces of this length that such a sequence takes
            full = min(n, left // each)
            rest = left - full * each if full < n else 0
            for from_, many, pieces in ((first, full, each), (first + full, 1, rest)):
                if many and pieces:
                    for j in range(pieces):
                        out.append((length, rank, many, from_, capacity - room + j * length))
                        rank += many
                    rooms.put(room - pieces * length, from_, many)
            used = full + (rest > 0)
            if first == opened:
                opened += used
            else:
                rooms.put(room, first + used, n - used)
            left -= full * each + rest
    return out


_PIECE = "piece int, start bigint, length bigint, crc bigint"


def _cut(raw, capacity: int, end: int, with_ids: bool):
    """Rows of documents to rows of pieces, each with its number among its task's pieces of that length."""

    @freeing_after
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, part = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            rows, cols, ids = [], [], []
            for row, text in enumerate(batch.column("text")):
                coded = np.append(encode(raw.value, text.as_py() or ""), end).astype("<u4")
                for piece, (start, length) in enumerate(cuts(len(coded), capacity)):
                    own = coded[start : start + length]
                    rows.append(row)
                    cols.append((piece, start, length, zlib.crc32(own.tobytes()), part, int(seen[length])))
                    seen[length] += 1
                    if with_ids:
                        ids.append(own)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            out = [batch.column("doc_id").take(pa.array(rows, pa.int64())), *[pa.array([c[i] for c in cols], kind) for i, kind in enumerate(kinds)]]
            if with_ids:
                at = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, "<u4"), *ids]).astype(np.int32))))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "piece", "start", "length", "crc", "part", "own", *["ids"] * with_ids])

    return run


def pack(df: DataFrame, tokenizer: bytes, doc_id: str = "doc_id", text: str = "text", capacity: int = 1024, end: int = 2, with_ids: bool = False) -> DataFrame:
    """One row for each piece of df's texts: doc_id, piece, start, length, crc (of its ids), sequence, offset, and its ids if asked for."""
    spark = df.sparkSession
    bounded_batches(spark)
    raw = spark.sparkContext.broadcast(tokenizer)
    docs = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = docs.mapInArrow(_cut(raw, capacity, end, with_ids), f"doc_id {kind}, {_PIECE}, part int, own bigint" + ", ids array<int>" * with_ids)
    pieces = saved(cut, "packing-pieces")
    # numbers of the capacity's size at most: for each length, for each task and length
    runs = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("length")
    runs = saved(runs.select("part", "length", F.sum("n").over(by).alias("all"), (F.sum("n").over(by.orderBy("part")) - F.col("n")).alias("before")), "packing-runs")
    counts = [0] * (capacity + 1)
    for row in runs.groupBy("length").agg(F.first("all").alias("n")).collect():
        counts[row["length"]] = row["n"]
    made = np.array(plan(counts, capacity), np.int64).reshape(-1, 5)
    made = made[np.lexsort((made[:, 1], made[:, 0]))]
    edges = np.searchsorted(made[:, 0], np.arange(capacity + 2))
    held = spark.sparkContext.broadcast((made, edges))

    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        (runs, edges), n, r = held.value, length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        at = np.zeros(len(n), np.int64)
        for x in np.unique(n):
            own = n == x
            at[own] = edges[x] + np.searchsorted(runs[edges[x] : edges[x + 1], 1], r[own], "right") - 1
        return pa.StructArray.from_arrays([pa.array(runs[at, 3] + r - runs[at, 1], pa.int64()), pa.array(runs[at, 4], pa.int64())], names=["sequence", "offset"])

    ranked = pieces.join(runs.select("part", "length", "before"), ["part", "length"])
    placed = ranked.withColumn("at", F.arrow_udf(place, "sequence bigint, offset bigint")("length", F.col("own") + F.col("before")))
    return placed.select("doc_id", "piece", "start", "length", "crc", "at.sequence", "at.offset", *["ids"] * with_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence, ids) of what pack gave with ids: at most capacity ids each."""
    each = packed.groupBy("sequence").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return each.select("sequence", F.flatten("p.ids").alias("ids"))
