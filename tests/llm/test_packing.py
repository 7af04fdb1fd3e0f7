import bisect
import collections
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from panelframe.llm import packing
from panelframe.llm.queries import op12_best_fit_packing

RAW = packing.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
COLUMNS = "doc_id long, text string, sequence string"


def one_by_one(lengths, capacity):
    """Best-fit decreasing, piece after piece: how full each sequence gets."""
    bins, rooms = [], []  # rooms: sorted (room, bin)
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, (x, -1))
        room, b = rooms.pop(i) if i < len(rooms) else (capacity, len(bins))
        if b == len(bins):
            bins.append([])
        bins[b].append(x)
        bisect.insort(rooms, (room - x, b))
    return sorted(map(sum, bins))  # which of two sequences with equal room is taken doesn't matter to the sums


@settings(deadline=None)
@given(st.integers(1, 40), st.data())
def test_runs_are_best_fit_decreasing(capacity, data):
    lengths = data.draw(st.lists(st.integers(1, capacity), max_size=120))
    counts = np.bincount(lengths, minlength=capacity + 1).tolist()
    bins, seen = collections.defaultdict(list), collections.Counter()
    for length, rank, n, first, offset in packing.plan(counts, capacity):
        assert rank == seen[length]
        seen[length] += n
        for i in range(n):
            bins[first + i].append((offset, length))
    assert seen == collections.Counter(lengths) and sorted(bins) == list(range(len(bins)))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == np.cumsum([0, *[x for _, x in b]])[:-1].tolist() and sum(x for _, x in b) <= capacity
    assert sorted(sum(x for _, x in b) for b in bins.values()) == one_by_one(lengths, capacity)


def texts():
    rng = np.random.default_rng(3)
    words = ["token", "ize", "ä", "日本", "🙂", "12345", "\n\n", "  ", "don't", "<|endoftext|>", "x" * 30]
    out = [" ".join(rng.choice(words, int(rng.zipf(1.3)) % 3000)) for _ in range(150)]
    return [*out, None, "", "same", "same", "a" * 50_000, " " * 120_000 + "x", "word " * 40_000]


def test_query_columns_against_the_library(spark, tmp_path):
    data = [(None if i == 7 else i % 140, x, "own column") for i, x in enumerate(texts())]
    spark.createDataFrame(data, COLUMNS).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_str(RAW.decode())
    want = []
    for i, text, _ in data:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        for k, start in enumerate([0, *range(first, len(ids), 1024)]):
            own = ids[start : start + (1024 if k else first)]
            want.append((i, k, start, len(own), zlib.crc32(own.tobytes())))
    got = op12_best_fit_packing(spark, str(tmp_path)).collect()
    assert sorted((tuple(r[:5]) for r in got), key=str) == sorted(want, key=str)
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for b in by.values():
        b.sort()
        assert [o for o, _ in b] == np.cumsum([0, *[x for _, x in b]])[:-1].tolist() and sum(x for _, x in b) <= 1024
    assert len(by) == len(one_by_one([w[3] for w in want], 1024))


def test_sequences_and_other_capacities(spark):
    df = spark.createDataFrame([(i, x, "") for i, x in enumerate(["one two three", None, "four " * 30, "one two three"])], COLUMNS)
    packed = packing.pack(df, RAW, capacity=8, end=50256, with_ids=True)
    ids = {r.sequence: r.ids for r in packing.sequences(packed).collect()}
    rows = packed.collect()
    assert sum(map(len, ids.values())) == sum(r.length for r in rows) and max(map(len, ids.values())) <= 8
    for r in rows:
        assert ids[r.sequence][r.offset : r.offset + r.length] == r.ids
    whole = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == len(whole[r.doc_id])
        whole[r.doc_id] += r.ids
    assert whole[1] == [50256] and whole[0] == whole[3] and whole[2][-1] == 50256


def test_empty_table(spark):
    df = spark.createDataFrame([], COLUMNS)
    assert packing.pack(df, RAW).count() == 0
