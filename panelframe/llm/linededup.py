"""Operator 10: near-duplicate lines by a deletion-neighbourhood join.

A line (\\n-split) is its sequence of lower-cased (A-Z) words. Lines with at least
min_words words are compared (1: all that have a word): two are duplicates if they are equal, or within one word edit (one word
changed, put in or left out) that leaves more than half of the longer line's words, so that it
has three or more: by the edit alone all lines of one word would be one. All variants of a line with one word deleted are
emitted as hashed keys; lines that agree in a variant are joined, the edit distance of
the pair is verified on the words, and of two duplicates the earlier by (doc_id, row, line
number) stays. A line goes if any earlier line in the table duplicates it.

Equal lines are counted as one first. Two near lines share the half of their words that
the edit leaves alone, so only lines whose half occurs in another line emit their variants
(nothing is lost by it). Within one variant with the same deleted place all lines lie within
one edit of each other, and so do a line and the lines that become it by a deletion: each
compares with the earliest one there, and a hot variant costs as many pairs as lines.

Lines below min_words and lines of documents without an id stay. A text that loses all its words goes as
a document in `dedup_lines`; texts that had none stay as they are, null included. The id is an integer (else it
must cast to one). Where ids repeat, `row` tells different texts of one id apart (the hash of the text; 0 where no id repeats):
each loses its own lines only, and rows equal in id and text lose the same. An empty table gives an empty result. Columns of df
may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelframe.llm import words as W
from panelframe.llm.shared import bounded_batches, freeing_after, narrow, saved

_LINE = "doc_id long, row long, line int, whole long, halves array<long>"
_LONG = "doc_id long, row long, line int, words string, variants array<long>"


def _long_lines(column: pa.Array, least: int) -> tuple:
    """Row, number, word range and bytes of each line with at least `least` words; word hashes."""
    data, offsets = W.utf8(column)
    starts, ends, _ = W.spans(data, offsets)
    hashes = W.range_hash(data, starts, ends, W.BYTE_LOWER)
    first, last, rows, number = W.line_spans(data, offsets)
    a, b = np.searchsorted(starts, first), np.searchsorted(starts, last)
    pick = b - a >= least
    return data, hashes, rows[pick], number[pick], a[pick], b[pick], first[pick], last[pick], starts, ends


def _half_keys(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each line four keys: the halves that a line as long, or one word longer, or one shorter may share.

    Not all of them mean something: see _half_counts.
    """
    n, out = b - a, []
    for shorter in (0, 1):
        m = n - shorter  # words of the shorter line of a pair
        half = m // 2
        tag = W.mix(m.astype(np.uint64) * np.uint64(2))
        out.append(W.range_hash(hashes, a, a + half) ^ tag)
        s = b - (m - half)
        out.append(W.range_hash(hashes, s, b) ^ W.mix(tag))
    return np.stack(out, axis=1)


def _half_counts(n: np.ndarray) -> np.ndarray:
    """How many of the four keys to take: the shorter line of a near pair has two words at least."""
    return np.select([n < 2, n == 2], [0, 2], 4)


def lines_of(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, row, text) to the lines that are compared: hash of the words and keys of their halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                _, hashes, rows, number, a, b, *_ = _long_lines(part.column("text"), least)
                whole, keys, take = W.range_hash(hashes, a, b), _half_keys(hashes, a, b), _half_counts(b - a)
                keys = keys[np.arange(4) < take[:, None]]
                edge = np.concatenate([[0], np.cumsum(take)])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(rows)),
                        part.column("row").take(pa.array(rows)),
                        pa.array(number, pa.int32()),
                        pa.array(whole.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(keys.view(np.int64))),
                    ],
                    names=["doc_id", "row", "line", "whole", "halves"],
                )

    return docs.where("doc_id is not null").mapInArrow(freeing_after(run), _LINE)


def _variants_of(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, row, text, lines wanted) to those lines' words and the hash of each one-word deletion."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                data, hashes, rows, number, a, b, first, last, *_ = _long_lines(part.column("text"), least)
                wanted = part.column("wanted")
                of = np.repeat(np.arange(part.num_rows), wanted.value_lengths().to_numpy(zero_copy_only=False))
                asked = of.astype(np.int64) << 32 | wanted.flatten().to_numpy(zero_copy_only=False)
                pick = np.isin(rows.astype(np.int64) << 32 | number, asked)
                rows, number, a, b, first, last = (x[pick] for x in (rows, number, a, b, first, last))
                lists, low = [], W.LOWER[data].tobytes()
                for lo, hi in zip(a.tolist(), b.tolist(), strict=True):
                    if hi - lo < 3:  # met as the shorter line only
                        lists.append(np.zeros(0, np.uint64))
                        continue
                    up, down = W.powers(hi - lo)
                    term = hashes[lo:hi] * up[: hi - lo]
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)])
                    lists.append(W.mix(sums[:-1] + (sums[-1] - sums[1:]) * down[1]))
                texts = [low[s:e] for s, e in zip(first.tolist(), last.tolist(), strict=True)]
                at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(rows)),
                        part.column("row").take(pa.array(rows)),
                        pa.array(number, pa.int32()),
                        pa.array(texts, pa.binary()).cast(pa.string()),
                        pa.ListArray.from_arrays(pa.array(at), pa.array((np.concatenate(lists) if lists else np.zeros(0, np.uint64)).view(np.int64))),
                    ],
                    names=["doc_id", "row", "line", "words", "variants"],
                )

    return docs.mapInArrow(freeing_after(run), _LONG)


def within_one(x: list, y: list) -> bool:
    """Whether at most one element is changed, put in or left out."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1:
        return False
    i = 0
    while i < len(x) and x[i] == y[i]:
        i += 1
    return x[i + (len(x) == len(y)) :] == y[i + 1 :]


def _verified(x: pa.Array, y: pa.Array) -> pa.Array:
    pattern = r"[\x20\x09-\x0D]+"
    clean = [pc.ascii_trim(pc.replace_substring_regex(c, pattern, " "), " ") for c in (x, y)]
    return pa.array([within_one(a.split(" "), b.split(" ")) for a, b in zip(*(c.to_pylist() for c in clean), strict=True)], pa.bool_())


def _row(df: DataFrame, doc_id: str, text: str) -> Column:
    """What tells the texts of a repeated id apart: 0 if no id occurs twice."""
    twice = narrow(df, doc_id=doc_id).where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    return F.lit(0).cast("long") if twice.isEmpty() else F.xxhash64(F.col(f"`{text}`").cast("string"))


def repeated_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 1, row: Column | None = None) -> DataFrame:
    """(doc_id, row, line) of every line, counted from 0, that an earlier line duplicates within one word edit."""
    bounded_batches(df.sparkSession)
    row = _row(df, doc_id, text) if row is None else row
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), row.alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    lines = saved(lines_of(docs, min_words), "lines")
    place = F.struct("doc_id", "row", "line")
    one = lines.groupBy("whole").agg(F.min(place).alias("first"), F.first("halves").alias("halves"))
    one = saved(one, "lines-distinct")

    halves = one.select("whole", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("whole").alias("lo"), F.max("whole").alias("hi")).where("lo <> hi").select("half")
    some = halves.join(shared, "half", "left_semi").select("whole").distinct()
    some = one.select("whole", "first").join(some, "whole", "left_semi").select("first.doc_id", "first.row", "first.line")
    asked = some.groupBy("doc_id", "row").agg(F.collect_set("line").alias("wanted"))
    near = saved(_variants_of(docs.join(asked, ["doc_id", "row"]), min_words).dropDuplicates(["doc_id", "row", "line"]), "lines-variants")

    rows = near.select("doc_id", "row", "line", F.posexplode("variants").alias("at", "key"))
    longer = near.select("doc_id", "row", "line", F.lit(-1).alias("at"), F.arrow_udf(_sequence_hash, "long")("words").alias("key"))
    rows = rows.unionByName(longer)
    same = rows.groupBy("key", "at").agg(F.min(place).alias("earlier"), F.count(F.lit(1)).alias("n"))
    is_line = F.col("at") == -1
    cross = same.groupBy("key").agg(F.min(F.when(is_line, F.col("earlier"))).alias("as_line"), F.min(F.when(~is_line, F.col("earlier"))).alias("as_variant")).where("as_line is not null and as_variant is not null")
    found = rows.join(same.where("n > 1"), ["key", "at"]).select(place.alias("own"), "earlier")
    crossed = rows.join(cross, "key").select(place.alias("own"), F.when(is_line, F.col("as_variant")).otherwise(F.col("as_line")).alias("earlier"))
    found = found.unionByName(crossed).where("earlier < own").distinct()
    words = near.select(place.alias("p"), "words")
    pairs = found.join(words.select(F.col("p").alias("own"), F.col("words").alias("x")), "own").join(words.select(F.col("p").alias("earlier"), F.col("words").alias("y")), "earlier")
    close = pairs.where(F.arrow_udf(_verified, "boolean")("x", "y")).select("own.doc_id", "own.row", "own.line").distinct()

    copies = lines.select("doc_id", "row", "line", "whole").join(one.select("whole", "first"), "whole").where(place != F.col("first")).select("doc_id", "row", "line")
    return copies.unionByName(close).distinct()


def _sequence_hash(column: pa.Array) -> pa.Array:
    """The hash of all words of a line, as its deletion from a longer line gives it."""
    data, offsets = W.utf8(column)
    starts, ends, rows = W.spans(data, offsets)
    edge = W.bounds(rows, len(offsets) - 1)
    return pa.array(W.range_hash(W.range_hash(data, starts, ends, W.BYTE_LOWER), edge[:-1], edge[1:]).view(np.int64))


def with_removed(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 1, out: str = "removed") -> DataFrame:
    """df and an array `out` of the sorted numbers of the lines that go, empty where none does."""
    row = _row(df, doc_id, text)
    gone = repeated_lines(df, doc_id, text, min_words, row).groupBy(F.col("doc_id").alias("\u0001id"), F.col("row").alias("\u0001row")).agg(F.array_sort(F.collect_list("line")).alias("\u0001gone"))
    found = df.withColumn("\u0001own", row).join(gone, (F.col(f"`{doc_id}`").cast("long") == F.col("\u0001id")) & (F.col("\u0001own") == F.col("\u0001row")), "left")
    return found.select(*[F.col(f"`{c}`") for c in df.columns if c != out], F.coalesce("\u0001gone", F.array().cast("array<int>")).alias(out))


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 1) -> DataFrame:
    """df without repeated lines and without documents that lose all their words by it, with df's columns."""
    found = with_removed(df, doc_id, text, min_words, "\u0001gone")
    t, g = F.col(f"`{text}`").cast("string"), F.col("\u0001gone")
    split, none = F.split(t, "\n", -1), F.size(g) == 0
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), g), lambda i: F.element_at(split, i + 1))
    out = found.withColumn("\u0001text", F.when(none, t).otherwise(F.array_join(left, "\n")))
    out = out.where(none | F.col("\u0001text").rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*[F.col("\u0001text").alias(c) if c == text else F.col(f"`{c}`") for c in df.columns])
