"""Counts over whole texts, by vectorised passes over Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from panelframe.llm import words as W
from panelframe.llm.shared import freeing

#: The symbols that count as markup or noise.
SYMBOLS = b"#*$%&|<>"
#: Column and what it counts, all over the whole text (null: as the empty text).
COUNTS = (
    "n_chars_",  # code points
    "n_words",  # [^\x20\x09-\x0D]+
    "word_chars",  # code points in words
    "n_symbols",
    "n_lines",  # \n-split lines with a word
    "n_dup_lines",  # of these, equal to an earlier line
    "n_repeat_words",  # words in 5-word windows found twice or more
    "n_distinct",  # distinct words
    "n_adjacent",  # words equal to the word before them
    "n_upper",
    "n_lower",
    "n_digits",
    "n_marks",  # exclamation and question marks
    "n_stops",  # full stops and commas
)
WINDOW = 5


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _DIGIT, _MARK, _STOP = _table(SYMBOLS), _table(b"0123456789"), _table(b"!?"), _table(b".,")
_UPPER, _LOWER = _table(bytes(range(65, 91))), _table(bytes(range(97, 123)))


def _twice(keys: np.ndarray) -> np.ndarray:
    """For each key whether it occurs twice or more."""
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    hit = np.zeros(len(keys), bool)
    hit[1:] |= same
    hit[:-1] |= same
    out = np.empty(len(keys), bool)
    out[order] = hit
    return out


def _later(keys: np.ndarray) -> np.ndarray:
    """For each key whether an equal key stands before it."""
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), bool)
    out[order[1:]] = keys[order][1:] == keys[order][:-1]
    return out


def counts(column: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text of an Arrow string column."""
    data, offsets = W.utf8(column)
    n = len(offsets) - 1

    def per_row(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]

    begins = (data & 0xC0) != 0x80
    after_c3 = np.zeros(len(data), bool)
    after_c3[1:] = data[:-1] == 0xC3
    starts, ends, rows = W.spans(data, offsets)
    salt = W.mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
    hashes = W.range_hash(data, starts, ends, W.BYTE)

    def tally(of_rows: np.ndarray) -> np.ndarray:
        return np.bincount(of_rows, minlength=n)[:n] if n else np.zeros(0, np.int64)

    at = np.flatnonzero(rows[: len(rows) - WINDOW + 1] == rows[WINDOW - 1 :]) if len(rows) >= WINDOW else np.zeros(0, np.int64)
    again = at[_twice(W.range_hash(hashes, at, at + WINDOW) ^ salt[rows[at]])]
    cover = np.zeros(len(rows) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + WINDOW, -1)

    first, last, of, _ = W.line_spans(data, offsets)
    filled = np.searchsorted(starts, last) > np.searchsorted(starts, first)
    first, last, of = first[filled], last[filled], of[filled]
    lines = W.range_hash(data, first, last, W.BYTE) ^ salt[of]
    return {
        "n_chars_": per_row(begins),
        "n_words": tally(rows),
        "word_chars": per_row(begins & ~W.SEP[data]),
        "n_symbols": per_row(_SYMBOL[data]),
        "n_lines": tally(of),
        "n_dup_lines": tally(of[_later(lines)]),
        "n_repeat_words": tally(rows[np.cumsum(cover)[:-1] > 0]),
        "n_distinct": tally(rows[~_later(hashes ^ salt[rows])]),
        "n_adjacent": tally(rows[1:][(hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])]),
        "n_upper": per_row(_UPPER[data] | (after_c3 & (data < 0x9F))),
        "n_lower": per_row(_LOWER[data] | (after_c3 & (data >= 0x9F))),
        "n_digits": per_row(_DIGIT[data]),
        "n_marks": per_row(_MARK[data]),
        "n_stops": per_row(_STOP[data]),
    }


def _struct(column: pa.Array) -> pa.Array:
    batch = pa.RecordBatch.from_arrays([column], names=["text"])
    parts = [counts(part.column("text")) for part in W.slices(batch, "text")]
    return pa.StructArray.from_arrays([pa.array(np.concatenate([p[c] for p in parts]) if parts else [], pa.int64()) for c in COUNTS], names=list(COUNTS))


def counts_of(text: Column | str) -> Column:
    """COUNTS as a struct column; a null text counts as the empty one."""
    return F.arrow_udf(freeing(_struct), ", ".join(f"{c} long" for c in COUNTS))(text)
