import collections
import re

import numpy as np
from pyspark.sql import functions as F

from panelframe.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, total = {}, sum(sizes.values())
    while True:
        rest = total - sum(full.values())
        free = {s: w[s] for s in w if s not in full}
        level = rest / sum(free.values()) if free else 0
        new = {s for s in free if free[s] * level > cap * sizes[s]}
        if not new:
            return {s: full.get(s, w[s] * level) for s in w}
        full |= {s: cap * sizes[s] for s in new}


def rows():
    rng = np.random.default_rng(8)
    out = [(i, " ".join(["w"] * int(rng.integers(0, 60))), f"s{int(rng.zipf(1.4)) % 7}") for i in range(900)]
    return out + [(900, None, "s1"), (901, "a b c", None), (902, "x", "Ä"), (5, out[5][1], out[5][2])]


def test_targets_and_takes(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    made = mixing.decide(df, block_rows=64, fan=4).collect()
    sizes = collections.Counter()
    for _, t, s in data:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    taken, largest = collections.Counter(), collections.Counter()
    for r in made:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size * r.same
        largest[r.source] = max(largest[r.source], r.size * r.same)
    for s in want:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6
    again = mixing.decide(df.repartition(7), block_rows=64, fan=4).collect()
    assert sorted(map(str, again)) == sorted(map(str, made))


def test_mix_copies_rows(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string").withColumn("copies", F.lit(7))
    out = mixing.mix(df)
    assert out.columns == df.columns
    copies = {(r.doc_id, r.source, r.size): r.copies * r.same for r in mixing.decide(df).collect()}
    got = collections.Counter((r.doc_id, r.source, len((r.text or "").split())) for r in out.collect())
    assert got == {k: v for k, v in copies.items() if v}


def test_pivot_keeps_the_weighted_mass():
    rng = np.random.default_rng(1)
    for _ in range(50):
        p, size = rng.random(30), rng.integers(1, 50, 30).astype(float)
        q, at = mixing.pivot(p, size, rng.random(30))
        assert abs((p * size).sum() - (q * size).sum()) < 1e-6
        assert all(q[i] in (0, 1) for i in range(30) if i != at)


def test_expected_copies_are_the_fractions():
    rng = np.random.default_rng(2)
    p, size = np.array([0.3, 0.6, 0.5, 0.9]), np.array([3.0, 1.0, 2.0, 5.0])
    out = []
    for _ in range(4000):
        q, at = mixing.pivot(p, size, rng.random(4))
        if at >= 0:
            q[at] = rng.random() < q[at]
        out.append(q)
    assert np.abs(np.mean(out, axis=0) - p).max() < 0.04


def test_empty_and_wordless(spark):
    e = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.decide(e).count() == 0 and mixing.mix(e).count() == 0
    w = spark.createDataFrame([(1, None, "a"), (2, " ", "b")], "doc_id long, text string, source string")
    assert [r.copies for r in mixing.decide(w).collect()] == [0, 0]


def test_many_sources(spark):
    """As many open fractions as sources: they meet in buckets of sources."""
    data = [(i, " ".join(["w"] * (1 + i * 7 % 11)), f"s{i % 500}") for i in range(3000)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    taken, target, largest = collections.Counter(), {}, collections.Counter()
    for r in mixing.decide(df, block_rows=128, fan=4).collect():
        taken[r.source] += r.copies * r.size
        target[r.source], largest[r.source] = r.target, max(largest[r.source], r.size)
    assert len(target) == 500 and all(abs(taken[s] - target[s]) <= largest[s] + 1e-6 for s in target)


def test_words_are_counted_like_a_scan(spark):
    texts = [None, "", " ", "\n\t", "a", " a", "a ", "a\x0bb\x0cc", "é 😀😀 x\u00a0y", "  two  words  ", "w" * 100_000, "$1 \\ $"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.n for r in df.select("i", mixing.n_words(F.col("t")).alias("n")).collect()}
    assert got == {i: None if t is None else len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in enumerate(texts)}
