import os
import random
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from panelframe.llm import similar

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def first_of_groups(docs):
    ids, sets = sorted(docs), {i: shingles(t) for i, t in docs.items()}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in ids if find(i) == i}


def documents():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    out = [" ".join(rng.choices(words, k=rng.choice([3, 12, 60, 200, 400]))) for _ in range(60)]
    for t in out[:50]:
        for edits in (1, 2, 4, 9):
            w = t.split()
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(words)
            out.append(rng.choice([" ", "\n", "\t "]).join(w).capitalize())
    return {i * 3: t for i, t in enumerate([*out, *out[:5], None, "", " \n "])}


def test_stage_against_brute_force(spark):
    docs = documents()
    want = first_of_groups(docs)
    assert 60 < len(want) < len(docs) - 60  # both near pairs and pairs that miss the bound
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumn("n", F.lit(1))
    out = corpus_pipeline.simhash_near_dedup(spark, df, "")
    assert out.columns == df.columns
    assert {r.doc_id for r in out.collect()} == want
    small = similar.drop_similar(df, tile=300, most=3)
    assert {r.doc_id for r in small.collect()} == want


def test_group_that_one_key_holds(spark):
    base = [f"p{i}" for i in range(100)]
    rows = [(i, " ".join([*base[: i % 100], f"q{i}", *base[i % 100 + 1 :]])) for i in range(300)] + [(None, " ".join(base)), (None, None), (1000, "other words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for how in ({}, {"tile": 2000, "most": 16}):
        assert sorted(str(r.doc_id) for r in similar.drop_similar(df, **how).collect()) == ["0", "1000", "None", "None"]
    assert similar.drop_similar(df.limit(0)).count() == 0


def test_repeats_do_not_move_fingerprints(spark):
    base = " ".join(f"v{i}" for i in range(200))
    df = spark.createDataFrame([(1, base), (2, base + " " + "again and again and so " * 400), (3, base + " own end")], "doc_id long, text string")
    assert {r.doc_id for r in similar.drop_similar(df).collect()} == {1}


def test_radius_loses_nothing_at_the_bound():
    """Pairs of sets at just 0.8: all far within 26 bits from 32 shingles on."""
    rng, most = np.random.default_rng(9), 0
    for n in [32, 40, 64, 128, 500] * 60:
        shared, own = -(-8 * n // 10), n - -(-8 * n // 10)
        h = rng.integers(0, 2**63, shared + own, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, shared + own, dtype=np.uint64)
        a, b = (similar.majority(x, np.zeros(len(x), np.int64), 1) for x in (h[: shared + own // 2], np.concatenate([h[:shared], h[shared + own // 2 :]])))
        most = max(most, int(np.bitwise_count(a ^ b)[0]))
    assert most <= 24


def test_overlaps():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 9000, int(n)).astype(np.uint64)) for n in rng.integers(1, 6000, 12)]
    got = similar.overlaps(sets[:5], sets[5:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:5]]


def test_quoted_passage_sends_no_sets(spark, monkeypatch):
    """Documents that share a passage and are unlike otherwise grow with the table: their whole sets must not meet."""
    rng, rows, save = random.Random(5), {}, similar.saved

    def counted(df, name, **how):
        out = save(df, name, **how)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(similar, "saved", counted)
    passage = " ".join(f"p{i}" for i in range(40))
    docs = [(i, " ".join([*(f"a{rng.randrange(10**9)}" for _ in range(80)), passage, *(f"b{rng.randrange(10**9)}" for _ in range(80))])) for i in range(240)]
    docs += [(1000, docs[7][1] + " end"), (1001, docs[8][1].replace("p3 ", "other "))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for how in ({}, {"tile": 700}):
        assert {r.doc_id for r in similar.drop_similar(df, **how).collect()} == set(range(240))
        assert rows["similar-sets"] == 4


def test_sketches():
    rng, agree = np.random.default_rng(13), similar.agreed(32, (4, 5))
    assert agree == 10
    least, want, most = np.full((400, 2, 32), 2**64 - 1, np.uint64), [], []
    for k in range(400):
        shared, own = (4 * (n := int(rng.integers(1, 60)))), n  # at just 0.8
        h = rng.choice(10**6, shared + own, replace=False).astype(np.uint64)
        cut = shared + int(rng.integers(0, own + 1))
        sets = [{int(x) for x in h[:cut]}, {int(x) for x in [*h[:shared], *h[cut:]]}]
        for side, s in enumerate(sets):
            x = sorted(s)[:32]
            least[k, side, : len(x)] = x
        union = sorted(sets[0] | sets[1])[:32]
        want.append((len(union), len({*union} & sets[0] & sets[1])))
    seen, common = similar.in_common(least[:, 0], least[:, 1])
    assert [*zip(seen.tolist(), common.tolist(), strict=True)] == want
    assert (32 * common >= agree * seen).all()


def test_nothing_is_left_but_the_ids_that_go(spark):
    """Neither tables in the shared folder nor shuffle files of what was saved there."""
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = {*os.listdir(shared)}
    df = spark.createDataFrame(list(documents().items()), "doc_id long, text string")
    out = similar.drop_similar(df)
    left = {x.rsplit("-", 1)[0] for x in {*os.listdir(shared)} - before if x.startswith("similar-")}
    assert left == {"similar-rest"}
    assert out.count() == out.count() > 60


def test_sets_of_a_large_group_lie_in_several_tasks(spark, monkeypatch):
    plans, save = {}, similar.saved

    def seen(df, name, **how):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return save(df, name, **how)

    monkeypatch.setattr(similar, "saved", seen)
    base = [f"p{i}" for i in range(100)]
    df = spark.createDataFrame([(i, " ".join([*base[:i], f"q{i}", *base[i + 1 :]])) for i in range(60)], "doc_id long, text string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert [r.doc_id for r in similar.drop_similar(df, tile=2000, most=16).collect()] == [0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert set(re.findall(r"hashpartitioning\((.*?), \d+\)", re.sub(r"#\d+L?", "", plans["similar-tiles"]))) == {"key", "key, chunk, chunks"}
    assert plans["similar-tiles"].count("BroadcastHashJoin") == 1
