"""The stages one by one against plain Python on a small table with odd rows, and the whole run."""

import base64
import collections
import hashlib
import os
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, removed string, text_ int"


def rejected(text):
    w, t = WORD.findall(text or ""), text or ""
    windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeat = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    upper, lower = sum(c.isupper() for c in t), sum(c.islower() for c in t)
    stutter = sum(a == b for a, b in zip(w, w[1:], strict=False))
    return (
        len(w) < 10 or 100 * len(repeat) > 20 * len(w) or 50 * len(re.findall(r"[#*$%&|<>]", t)) > len(t) or upper > lower
        or 10 * stutter > 3 * len(w) or 2 * (len(lines) - len(set(lines))) > len(lines) or not any(c.isalpha() for c in t)
    )


def low(x):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in x)


def within_one(x, y):
    if len(x) > len(y):
        x, y = y, x
    return len(y) - len(x) <= 1 and (sum(a != b for a, b in zip(x, y, strict=True)) <= 1 if len(x) == len(y) else any(y[:i] + y[i + 1 :] == x for i in range(len(y))))


def line_dedup(rows):
    """Rows (id, text) of distinct ids, in order of id."""
    seen, out = [], {}
    for i, t in sorted((x for x in rows if x[0] is not None), key=lambda x: x[0]):
        keep = []
        for line in (t or "").split("\n"):
            w = WORD.findall(low(line))
            near = any(w == v or max(len(v), len(w)) >= 3 and within_one(v, w) for v in seen) if w else False
            if w:
                seen.append(w)
            if not near:
                keep.append(line)
        left = "\n".join(keep)
        if t is None or left == t or WORD.search(left):
            out[i] = t if t is None else left
    return out


def near_dedup(docs):
    sets = {}
    for i, t in docs.items():
        w = WORD.findall(low(t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in ids if find(i) == i}


def documents():
    rng = random.Random(21)
    words = [f"Word{i}" if i % 9 == 0 else f"w{i}" for i in range(500)]
    text = lambda n: "\n".join(" ".join(rng.choices(words, k=rng.randint(2, 14))) for _ in range(n))
    texts = [text(rng.randint(1, 12)) for _ in range(60)]
    near = []
    for t in texts[:30]:  # one word of every second line: near copies, of lines and of texts
        lines = [x.split(" ") for x in t.split("\n")]
        for x in lines[::2]:
            x[rng.randrange(len(x))] = rng.choice(words)
        near.append("\n".join(" ".join(x) for x in lines))
    odd = [None, "", " \n ", "few words", "$$$ ## " * 30, ("SHOUT " * 3 + "now ") * 10, "no no yes yes " * 9, "12 " * 20, "one line of it\n" * 12, "é" * 50_000 + " " + text(3)]
    all_ = texts + near + texts[:10] + odd
    return [(i * 2, t, "en", [None, "a", "b", "c"][i % 4], len(t or ""), "mine", i) for i, t in enumerate(all_)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("sf"))
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{sf}/documents.parquet")
    out = {"input": spark.read.parquet(f"{sf}/documents.parquet")}
    now = out["input"]
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, now, sf)
        made.write.parquet(f"{sf}/{name}")
        out[name] = now = spark.read.parquet(f"{sf}/{name}")
    return sf, out


def rows_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_quality_rules(stages):
    _, s = stages
    assert rows_of(s["quality_rules"]) == {i: t for i, t in rows_of(s["input"]).items() if not rejected(t)}
    assert all(s[x].columns == s["input"].columns for x in ("quality_rules", "line_dedup", "simhash_near_dedup", "mix_sources"))


def test_line_dedup(stages):
    _, s = stages
    got = s["line_dedup"].collect()
    assert {r.doc_id: r.text for r in got} == line_dedup(rows_of(s["quality_rules"]).items())
    assert all(r.n_chars == len(r.text) and r.removed == "mine" for r in got)


def test_near_dedup(stages):
    _, s = stages
    docs = rows_of(s["line_dedup"])
    assert set(rows_of(s["simhash_near_dedup"])) == near_dedup(docs)


def test_mixing(stages):
    _, s = stages
    before = {r.doc_id: r for r in s["simhash_near_dedup"].collect()}
    copies = collections.Counter(r.doc_id for r in s["mix_sources"].collect())
    size, taken, largest = collections.Counter(), collections.Counter(), collections.Counter()
    for i, r in before.items():
        n = len(WORD.findall(r.text))
        size[r.source] += n
        taken[r.source] += n * copies[i]
        largest[r.source] = max(largest[r.source], n)
    order = sorted((x for x in size if x is not None)) + [None] * (None in size)
    weights = {x: (5, 2, 1)[i % 3] for i, x in enumerate(order)}
    full = {}
    while True:
        free = [x for x in order if x not in full]
        level = (sum(size.values()) - sum(full.values())) / max(sum(weights[x] for x in free), 1)
        above = {x: 3 * size[x] for x in free if weights[x] * level > 3 * size[x]}
        if not above:
            break
        full |= above
    assert set(copies) <= set(before) and all(c <= 3 for c in copies.values())
    for x in order:
        assert abs(taken[x] - full.get(x, weights[x] * level)) <= largest[x] + 1e-6


def test_round_trip(stages):
    _, s = stages
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts, copies = rows_of(s["mix_sources"]), collections.Counter(r.doc_id for r in s["mix_sources"].collect())
    got = s["bpe_round_trip"].collect()
    assert collections.Counter(r.doc_id for r in got) == copies
    for r in got:
        ids = coder.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids) == (len(ids), ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_whole_run_agrees_with_the_stages_and_empty_tables_stay_empty(spark, stages):
    sf, s = stages
    key = lambda df: sorted((r.doc_id, r.ids_sha256) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf)) == key(s["bpe_round_trip"])
    empty = s["input"].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_whole_run_leaves_its_result_only(spark, stages):
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = {*os.listdir(shared)}
    n = corpus_pipeline.run(spark, stages[0]).count()
    left = [x for x in {*os.listdir(shared)} - before if len(x) > 36]  # without Spark's own checkpoints
    assert [x.rsplit("-", 1)[0] for x in left] == ["pipeline-bpe_round_trip"] and n > 0


def test_odd_ids_pass_all_stages(spark):
    """Null and repeated ids, repeated rows, no n_chars."""
    base = " ".join(f"word{i} thing{i * 7}" for i in range(40))
    rows = [(None, base, "a"), (1, base, "a"), (1, base, "a"), (1, base.replace("word3 ", "other "), None), (2, base + "\n" + base.replace("word", "own"), "b")]
    now = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seen = []
    for _, stage in corpus_pipeline.STAGES:
        now = spark.createDataFrame(stage(spark, now, "").collect(), stage(spark, now, "").schema)
        seen.append(sorted(str(r.doc_id) for r in now.collect()))
    assert seen[0] == ["1", "1", "1", "2", "None"] and seen[1] == ["1", "1", "2", "None"]
    assert set(seen[-1]) <= {"1", "2", "None"} and now.agg(F.min("n_tokens")).first()[0] > 0
