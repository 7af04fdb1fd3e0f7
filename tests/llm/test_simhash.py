import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from panelframe.llm import simhash
from panelframe.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(v >> b & 1 for v in h) > len(h)) << b for b in range(64))


def brute_groups(prints, radius=2):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def documents():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 400))) for _ in range(40)]
    out = base + base[:5] + [None, "", " \n ", "One", "one", "É two\tthree"]
    for t in base[:15]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    return {i * 3: t for i, t in enumerate(out)}


def test_against_brute_force(spark):
    docs = documents()
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumn("fp", F.lit("taken"))
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    prints = {i: brute_fingerprint(t) for i, t in docs.items()}
    assert {i: r.fp & (2**64 - 1) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == brute_groups(prints)


def test_dense_groups_and_all_band_counts(spark):
    rng = np.random.default_rng(2)
    centre = int(rng.integers(0, 2**62))
    prints = {centre ^ (1 << int(i)) ^ (1 << int(j)) for i in range(64) for j in range(0, 64, 7) if i != j} | {int(v) for v in rng.integers(0, 2**62, 300)}
    reps = {n: p for n, p in enumerate(sorted(prints))}
    want = brute_groups(reps)
    df = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p, n) for n, p in reps.items()], "fp long, rep long")
    for bands in (4, 8, 16):
        links = simhash.link_fingerprints(df, 2, tile=50, bands=bands)
        got = {r.node: r.component for r in components(links).collect()}
        assert {n: got.get(n, n) for n in reps} == want


def test_one_of_each_group_stays(spark):
    rows = [(5, "a b c d"), (2, "a b c d"), (9, "x y z"), (None, "a b c d"), (None, None), (7, "A b  c\td")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit(1))
    out = simhash.drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted(out.select("doc_id").collect(), key=str) == sorted([(2,), (9,), (None,), (None,)], key=str)
    assert simhash.drop_near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    for local in (0, 1 << 18):  # by rounds, and in one task
        got = {r.node: r.component for r in components(edges, local).collect()}
        assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_rounds_and_the_local_pass_agree(spark):
    rng = np.random.default_rng(8)
    for n, m in ((1, 0), (60, 25), (60, 60), (300, 280)):
        pairs = [(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2))] + [(n + 1, n + 1)]
        edges = spark.createDataFrame(pairs, "a long, b long")
        by_rounds, at_once = (sorted(components(edges, local).collect()) for local in (0, 1 << 18))
        assert by_rounds == at_once
