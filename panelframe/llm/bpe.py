"""Operator 7: byte-level BPE encoding and decoding over a global distinct-word shuffle.

Texts are split into pre-tokens in blocks of about `block_bytes`. A block gives its
distinct words, each with its number, and the stream of these numbers by position; words go to
the part that their hash names, where each distinct word is encoded once, and return
with their ids to their block, which puts the ids in order of position. Words of a
block that go to one part travel as one packed row, so that a frequent word costs one
entry a block and never gathers its positions in one place. Streams go to their block
at once; for that the texts are split twice, once for the words and once for the
streams, which costs less than to carry the streams through the word shuffle. So the input has to read the same
twice: `encode` saves it first, unless the caller says that it is stable (a table as it lies in files). A block's two
halves carry the digest of its words, and encoding fails if they differ.

The numbers of parts and of shuffle partitions follow from the bytes of text; the rows of a part are encoded as they
stream by, and a task remembers a bounded number of words.

Decoding looks every id up in the token-byte table, an array of at most the vocabulary's
size, which every task holds.

Null and empty texts encode to no ids and decode to no bytes; an id outside the
vocabulary makes the decoded bytes null. Ids of documents may repeat or be null: a row
comes out for each that goes in. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType

from panelframe.llm import words as W
from panelframe.llm.shared import bounded_batches, freeing, freeing_after, narrow, partitions, saved

_PACKED = "kind int, part long, block long, payload binary"
_KNOWN = 1 << 16  # words that a task remembers with their ids
_tables: dict[bytes, tuple] = {}


def read_vocabulary(path: str) -> bytes:
    """The file of ranks; it is read on the driver and sent to the tasks (a bounded table)."""
    with open(path, "rb") as f:
        return f.read()


def _tokens(raw: bytes) -> tuple[tiktoken.Encoding, np.ndarray, np.ndarray]:
    """Encoder, bytes of all tokens in order of id, and where each begins."""
    key = hashlib.sha256(raw).digest()
    if key not in _tables:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        size = max(ranks.values(), default=-1) + 1
        by_id = [b""] * size
        for token, i in ranks.items():
            by_id[i] = token
        at = np.concatenate([[0], np.cumsum([len(x) for x in by_id])]).astype(np.int64)
        coder = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        _tables[key] = coder, np.frombuffer(b"".join(by_id), np.uint8), at
    return _tables[key]


def _pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays as byte planes (numbers) or plain bytes, compressed together."""
    body = []
    for x in arrays:
        if not isinstance(x, bytes):
            x = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
        body.append(len(x).to_bytes(8, "little") + x)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(body))


def _unpack(blob: bytes, numbers: int) -> list:
    """The first `numbers` arrays as numbers, then bytes."""
    body, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(body):
        n = int.from_bytes(body[at : at + 8], "little")
        x = body[at + 8 : at + 8 + n]
        at += 8 + n
        if len(out) < numbers:
            x = np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)
        out.append(x)
    return out


def _pretokens(docs: DataFrame, pattern: str, parts: int, block_bytes: int, streams: bool) -> DataFrame:
    """Rows of the blocks' words by part, or (streams) one row a block with its lengths, stream and ids of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        for batch in batches:
            for piece in W.slices(batch, "text", block_bytes):
                data, offsets = W.utf8(piece.column("text"))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, piece.select(["doc_id"]).schema) as writer:
                    writer.write_batch(piece.select(["doc_id"]))
                header = sink.getvalue().to_pybytes()
                block = (xxhash.xxh64_intdigest(data) ^ xxhash.xxh64_intdigest(header + np.diff(offsets).tobytes(), 1)) >> 1
                lengths, flat = [], []
                for x in piece.column("text").to_pylist():
                    found = find(x) if x else []
                    lengths.append(len(found))
                    flat.append(pa.array(found, pa.large_string()))
                coded = pa.concat_arrays([*flat, pa.array([], pa.large_string())]).dictionary_encode()
                del flat
                indices = coded.indices.to_numpy(zero_copy_only=False)
                counts = np.bincount(indices, minlength=len(coded.dictionary))
                order = np.argsort(-counts, kind="stable")
                words = [x.encode() for x in coded.dictionary.take(pa.array(order)).to_pylist()]
                digest = xxhash.xxh64_intdigest(b"\0".join(words)) >> 1
                if streams:
                    rank = np.empty(len(order), np.int64)
                    rank[order] = np.arange(len(order))
                    to, payload = [digest], [_pack(np.array(lengths), rank[indices], header)]
                else:
                    part = np.array([xxhash.xxh32_intdigest(x) % parts for x in words], np.int64)
                    by_part = np.argsort(part, kind="stable")
                    edges = np.flatnonzero(np.diff(part[by_part], prepend=-1)).tolist() + [len(words)]
                    to, payload = [], []
                    for lo, hi in zip(edges, edges[1:], strict=False):
                        at = by_part[lo:hi]
                        own = [words[i] for i in at.tolist()]
                        to.append(int(part[at[0]]))
                        payload.append(_pack(np.array([digest >> 32, digest & 0xFFFFFFFF]), at, np.array([len(x) for x in own]), b"".join(own)))
                yield pa.RecordBatch.from_arrays([pa.array([int(streams)] * len(to), pa.int32()), pa.array(to, pa.int64()), pa.array([block] * len(to), pa.int64()), pa.array(payload, pa.binary())], names=["kind", "part", "block", "payload"])

    return docs.mapInArrow(freeing_after(run), _PACKED)


def _encode_part(vocabulary):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, known = _tokens(vocabulary.value)[0]._core_bpe.encode_single_piece, {}
        for batch in rows:
            out = []
            for payload in batch.column("payload"):
                digest, at, lengths, body = _unpack(payload.as_py(), 3)
                found, lo = [], 0
                for hi in np.cumsum(lengths).tolist():
                    word = body[lo:hi]
                    lo = hi
                    ids = known.get(word)
                    if ids is None:
                        if len(known) >= _KNOWN:
                            known.clear()
                        ids = known[word] = coder(word)
                    found.append(ids)
                out.append(_pack(digest, at, np.array([len(x) for x in found]), np.array([i for x in found for i in x])))
            yield batch.set_column(batch.schema.get_field_index("payload"), "payload", pa.array(out, pa.binary()))

    return run


def _assemble(id_type: pa.DataType):
    def run(rows: pa.Table) -> pa.Table:
        ats, sizes, ids, digests, blocks = [], [], [], set(), []
        for kind, part, payload in zip(*(rows.column(c).to_pylist() for c in ("kind", "part", "payload")), strict=True):
            if kind:
                blocks.append(_unpack(payload, 2))
                digests.add(part)
            else:
                digest, *got = _unpack(payload, 4)
                digests.add(int(digest[0]) << 32 | int(digest[1]))
                for to, x in zip((ats, sizes, ids), got, strict=True):
                    to.append(x)
        at, size = (np.concatenate([*x, np.zeros(0, np.uint32)]).astype(np.int64) for x in (ats, sizes))
        pool = np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32)
        words = int(at.max()) + 1 if len(at) else 0
        by_word, n, there = np.zeros(words, np.int64), np.zeros(words, np.int64), np.zeros(words, bool)
        by_word[at], n[at], there[at] = np.cumsum(size) - size, size, True
        if len(digests) != 1 or not blocks or not there.all():
            raise RuntimeError("the texts of a block differ between two reads of the input")
        out = []
        for lengths, stream, header in blocks:  # more than one: blocks equal in all ids and texts
            keys = pa.ipc.open_stream(header).read_all().column("doc_id").combine_chunks()
            found, counts = gather(pool, by_word[stream], n[stream])
            edges = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)]
            out.append(pa.table([keys.cast(id_type), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(found))], names=["doc_id", "ids"]))
        return pa.concat_tables(out)

    return run


def gather(pool: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """pool[b:b+n] for each pair, one after another, and the sizes."""
    end = np.cumsum(size)
    shift = np.repeat(begin - (end - size), size)
    return pool[np.arange(len(shift)) + shift], size


def _tasks(spark, size: int) -> int:
    """Shuffle partitions for so many bytes of text: of 16 MB each up to 10,000 of them, then larger, of 1 GB at most."""
    return max(partitions(spark), min(size >> 24, 10_000), size >> 30)


def encode(df: DataFrame, vocabulary: bytes, pattern: str, doc_id: str = "doc_id", text: str = "text", block_bytes: int = 4 << 20, stable: bool = False) -> DataFrame:
    """doc_id and ids (array of int), a row for each of df. stable: df gives the same rows in the same order whenever it is read."""
    spark = df.sparkSession
    bounded_batches(spark)
    docs = narrow(df, doc_id=doc_id, text=text).withColumn("text", F.col("text").cast("string"))
    docs = docs if stable else saved(docs, "bpe-input")
    tasks = _tasks(spark, docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    raw = spark.sparkContext.broadcast(vocabulary)
    words, streams = (_pretokens(docs, pattern, 4 * tasks, block_bytes, x) for x in (False, True))
    coded = words.repartition(tasks, "part").groupBy("part").applyInArrow(freeing_after(_encode_part(raw)), _PACKED).unionByName(streams)
    kind = docs.schema["doc_id"].dataType
    schema = docs.select("doc_id").schema.add("ids", ArrayType(IntegerType()))
    return coded.repartition(tasks, "block").groupBy("block").applyInArrow(freeing(_assemble(to_arrow_type(kind))), schema)


def decode(spark, ids: Column | str, vocabulary: bytes) -> Column:
    """The bytes of a column of ids."""
    raw = spark.sparkContext.broadcast(vocabulary)

    def some(column: pa.Array) -> pa.Array:
        _, pool, at = _tokens(raw.value)
        flat = column.flatten()
        bad = np.asarray(flat.is_null()) if flat.null_count else np.zeros(len(flat), bool)
        x = flat.fill_null(0).to_numpy(zero_copy_only=False).copy()
        bad |= (x < 0) | (x >= len(at) - 1)
        x[bad] = 0
        size = np.where(bad, 0, at[x + 1] - at[x])
        body, _ = gather(pool, at[x], size)
        edge = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        total, wrong = (np.concatenate([[0], np.cumsum(v)])[edge] for v in (size, bad))
        out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(total.astype(np.int64).tobytes()), pa.py_buffer(body.tobytes())])
        return pc.if_else(pa.array(np.diff(wrong) > 0), pa.scalar(None, pa.large_binary()), out).cast(pa.binary())

    def run(column: pa.Array) -> pa.Array:
        column = column.fill_null([]) if column.null_count else column
        edge = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
        out, lo = [], 0
        while lo < len(column):
            hi = max(lo + 1, int(np.searchsorted(edge, (edge[lo - 1] if lo else 0) + (1 << 19), "right")))
            out.append(some(column.slice(lo, hi - lo)))
            lo = hi
        return pa.concat_arrays([*out, pa.array([], pa.binary())])

    return F.arrow_udf(freeing(run), "binary")(ids)


def _digest(column: pa.Array) -> pa.Array:
    edge = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).tolist()
    body = memoryview(column.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes())
    return pa.array([hashlib.sha256(body[4 * a : 4 * b]).hexdigest() for a, b in zip(edge, edge[1:], strict=False)], pa.string())


def ids_sha256(ids: Column | str) -> Column:
    """Of the ids as little-endian unsigned 32-bit integers, in hexadecimal."""
    return F.arrow_udf(_digest, "string")(ids)
