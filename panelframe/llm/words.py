"""Vectorised words and hashes of UTF-8 texts in Arrow batches.

A word is a run of bytes other than space and 0x09-0x0D. Hashes are polynomials
modulo 2**64 over random 64-bit values, so that the hash of any range follows from
prefix sums; two different ranges agree with probability about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEP = np.zeros(256, bool)
SEP[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RNG = np.random.default_rng(20240607)
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_LOWER = BYTE[LOWER]
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
STEP = 1 << 18
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n."""
    if not _powers or len(_powers["up"]) <= n:
        size = max(n + 1, STEP + 1)
        for name, base in (("up", BASE), ("down", INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """Hash of values[s:e] for each pair of nondecreasing starts and ends; table maps the values first."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + STEP, "right")))
        hi = max(lo, int(ends[j - 1]))
        up, down = powers(hi - lo)
        part = values[lo:hi] if table is None else table[values[lo:hi]]
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(part * up[: hi - lo], out=sums[1:])
        s = starts[i:j] - lo
        out[i:j] = (sums[ends[i:j] - lo] - sums[s]) * down[s]
        i = j
    return mix(out)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts together and their offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `most` bytes of text, at least a row each."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        done = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, done + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; between: which bytes belong to none."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    sep = between[data]
    before = np.ones(len(data), bool)
    before[1:] = sep[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    after = np.ones(len(data), bool)
    after[:-1] = sep[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(before & ~sep), np.flatnonzero(after & ~sep) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Where the words of each of n rows begin, and the end."""
    return np.searchsorted(rows, np.arange(n + 1))


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and number in its row of each \\n-split line; an empty text has one empty line."""
    breaks = np.flatnonzero(data == 10)
    rows = np.searchsorted(offsets, breaks, "right") - 1
    n = len(offsets) - 1
    starts = np.concatenate([offsets[:-1], breaks + 1])
    row = np.concatenate([np.arange(n), rows])
    order = np.lexsort((starts, row))
    starts, row = starts[order], row[order]
    ends = np.empty(len(starts), np.int64)
    last = np.ones(len(starts), bool)
    last[:-1] = row[1:] != row[:-1]
    ends[last] = offsets[1:][row[last]]
    ends[~last] = starts[1:][~last[:-1]] - 1 if len(starts) > 1 else 0
    first = np.searchsorted(row, np.arange(n))
    return starts, ends, row, np.arange(len(row)) - first[row]
