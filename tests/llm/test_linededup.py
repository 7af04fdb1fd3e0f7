import random
import re

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from panelframe.llm import linededup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row = row, [i]
        for j, b in enumerate(y, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (a != b)))
    return row[-1]


@given(st.lists(st.integers(0, 2), max_size=6), st.lists(st.integers(0, 2), max_size=6))
def test_within_one(x, y):
    assert linededup.within_one(x, y) == (distance(x, y) <= 1)


def documents():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(50)]
    lines = [[rng.choice(words) for _ in range(rng.randint(8, 16))] for _ in range(40)]
    docs = {}
    for i in range(60):
        own = []
        for _ in range(rng.randint(1, 5)):
            w = list(rng.choice(lines))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                k, at = rng.randrange(3), rng.randrange(len(w))
                w[at : at + (k != 1)] = [] if k == 0 else [rng.choice(words)]
            own.append(rng.choice([" ", "  ", "\t"]).join(w).capitalize())
        docs[i] = "\n".join(own)
    return docs | {100: None, 101: "", 102: "\n\n", 103: " \n short line\nshort line"}


def test_against_brute_force(spark):
    docs = documents()
    lines = [(i, n, WORD.findall(x.lower())) for i, t in sorted(docs.items()) for n, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if len(x[2]) >= 10]
    want = {(i, n) for k, (i, n, w) in enumerate(lines) if any(distance(v, w) <= 1 for _, _, v in lines[:k])}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumn("line", F.lit(1))
    assert {(r.doc_id, r.line) for r in linededup.repeated_lines(df, min_words=10).collect()} == want and want
    out = linededup.dedup_lines(df, min_words=10)
    assert out.columns == df.columns
    got = {r.doc_id: r.text for r in out.collect()}
    for i, t in docs.items():
        left = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in want)
        if t != left and not WORD.search(left):
            assert i not in got
        else:
            assert got[i] == left


def test_hot_line_and_passages(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    hot = [(i, f"own words of document {i} come here and differ by number {i * 7} from all {i * 11} the {i * 13} rest\n{passage}") for i in range(300)]
    near = [(1000 + i, passage.replace("p30", f"q{i}")) for i in range(50)]
    df = spark.createDataFrame(hot + near, "doc_id long, text string")
    gone = {(r.doc_id, r.line) for r in linededup.repeated_lines(df).collect()}
    assert gone == {(i, 1) for i in range(1, 300)} | {(1000 + i, 0) for i in range(50)}


def test_empty_null_and_repeated(spark):
    e = spark.createDataFrame([], "doc_id long, text string")
    assert linededup.repeated_lines(e).count() == 0 and linededup.dedup_lines(e).count() == 0
    long = " ".join(f"w{i}" for i in range(12))
    df = spark.createDataFrame([(1, long), (1, long), (None, long), (2, long)], "doc_id long, text string")
    assert [(r.doc_id, r.line) for r in linededup.repeated_lines(df).collect()] == [(2, 0)]
    assert sorted(str(r.doc_id) for r in linededup.dedup_lines(df).collect()) == ["1", "1", "None"]


def test_lines_of_every_length_against_brute_force(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(12)]
    docs = {i: "\n".join(" ".join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 3, 4, 5, 6, 9, 10]))) for _ in range(rng.randint(1, 4))) for i in range(120)}
    docs |= {200 + i: " ".join(rng.choices(words[:2], k=i % 12 + 1)) for i in range(36)}
    lines = [(i, n, WORD.findall(x)) for i, t in docs.items() for n, x in enumerate(t.split("\n")) if x]
    near = lambda v, w: v == w or max(len(v), len(w)) >= 3 and distance(v, w) <= 1
    want = {(i, n) for k, (i, n, w) in enumerate(lines) if any(near(v, w) for _, _, v in lines[:k])}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {(r.doc_id, r.line) for r in linededup.repeated_lines(df).collect()} == want
    assert {len(w) for i, n, w in lines if (i, n) in want} >= {1, 2, 3, 4}


def test_stage_leaves_no_remnant_of_a_copy(spark):
    text = "Title\nA short line\none two three four five six seven eight nine ten eleven\n\nThe end"
    df = spark.createDataFrame([(1, text, 9), (2, text, 9), (3, text.replace("A short line", "Something else"), 9), (4, text + "\nown", 9)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, df, "").collect()}
    assert got == {1: text, 3: "Something else\n", 4: "\nown"}


def test_one_id_with_different_texts(spark):
    """Each text of a repeated id loses its own lines only; rows equal in both lose the same."""
    rows = [(1, "Read more here"), (2, "Read more here"), (2, "Read more here"), (2, "Quite another text stands here\nand goes on"), (3, "and goes on\nown words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(5), "removed": F.lit("mine")})
    got = sorted((r.doc_id, r.text, r.row, r.removed) for r in linededup.dedup_lines(df).collect())
    assert got == [(1, "Read more here", 5, "mine"), (2, "Quite another text stands here\nand goes on", 5, "mine"), (3, "own words", 5, "mine")]
    assert sorted((r.doc_id, r.removed) for r in linededup.with_removed(df, out="gone").withColumnRenamed("removed", "x").withColumnRenamed("gone", "removed").collect()) == [(1, []), (2, []), (2, [0]), (2, [0]), (3, [0])]
