import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelframe.llm import merkle
from panelframe.llm.queries import op13_merkle_manifest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, hash string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(levels, i):
    """(sibling or None, own side is right) for each level below the top."""
    out = []
    for row in levels[:-1]:
        out.append((row[i ^ 1] if i ^ 1 < len(row) else None, i & 1))
        i >>= 1
    return out


def brute(rows):
    """Sorted results of the query over (doc_id, text, lang, source, n_chars)."""
    def leaf(r, more=0):
        return H(*map(field, (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1])))

    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in langs:
        by[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = levels_of([leaf(r) for r in by[g]])
    top = levels_of([trees[g][-1][0] for g in langs])
    out = []
    for j, g in enumerate(langs):
        for i, r in enumerate(by[g]):
            steps = path(trees[g], i) + path(top, j)
            node = leaf(r, 1) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else leaf(r)
            for s, right in steps:
                node = H(node) if s is None else H(s, node) if right else H(node, s)
            root = top[-1][0]
            out.append((r[0], leaf(r), trees[g][-1][0], root, H(*[s for s, _ in steps if s is not None]), node, node == root))
    return sorted(out, key=str)


def rows(n, langs=("de", "en", "en", "en", None, "ä", "")):
    rng = np.random.default_rng(n)
    out = [(i, "wört " * int(rng.integers(0, 9)) if rng.random() > 0.1 else None, langs[int(rng.integers(len(langs)))], None if rng.random() < 0.2 else f"s{i % 3}", None if rng.random() < 0.2 else i) for i in range(n)]
    return out + [(None, "x", "en", None, 3), (None, None, None, None, None), (7, "again", "en", "s", 1), (7, "again", "en", "s", 1)]


@pytest.mark.parametrize(("n", "height"), [(0, 1), (40, 1), (300, 3), (2500, 10)])
def test_query_columns_against_one_machine(spark, tmp_path, n, height, monkeypatch):
    data = rows(n)
    df = spark.createDataFrame([(*r, "own column") for r in data], COLUMNS).repartition(5)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(merkle.prove, "__defaults__", (None, height))
    got = sorted(map(tuple, op13_merkle_manifest(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(data)


@pytest.mark.parametrize("data", [[], [(1, None, None, None, None)], [(1, "a" * 3_000_000, "en", "s", 1), (2, "", "en", "s", 1)], [(0, "same", "en", "s", 4)] * 9])
def test_few_rows(spark, tmp_path, data):
    spark.createDataFrame([(*r, None) for r in data], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, op13_merkle_manifest(spark, str(tmp_path)).collect()), key=str) == brute(data)


def test_proofs_fold_to_the_root(spark):
    df = spark.createDataFrame([(*r, None) for r in rows(40)], COLUMNS)
    out = merkle.prove(df, "lang", "doc_id", ["doc_id", F.upper("text")], height=2)
    assert out.columns == ["lang", "doc_id", "leaf", "subroot", "root", "proof", "folded_root"]
    assert out.where("folded_root <> root").count() == 0 and out.select("root").distinct().count() == 1


@given(st.integers(1, 200), st.data())
def test_missing_is_enough_and_no_more(n, data):
    some = data.draw(st.lists(st.integers(0, n - 1), min_size=1, max_size=12))
    lacks = merkle.missing(np.array(some), n)
    levels = merkle.climb([H(str(i)) for i in range(n)], merkle.depth(n))

    def top(got):
        known = {(0, i): levels[0][i] for i in some} | {c: levels[c[0]][c[1]] for c in got}
        for level in range(merkle.depth(n)):
            for k, at in [x for x in known if x[0] == level]:
                pair = [known.get((level, at & ~1)), known.get((level, at | 1)) if at | 1 < len(levels[level]) else ""]
                if None not in pair:
                    known[level + 1, at >> 1] = H(*pair)
        return known.get((merkle.depth(n), 0))

    assert top(lacks) == levels[-1][0]
    assert all(top([x for x in lacks if x != c]) is None for c in lacks)
