import collections
import math
import os
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from panelframe.llm import search
from panelframe.llm.queries import ORACLE_SQL, op11_pair_bound_search

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def found(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=20):
    """Sorted (item_id, rank, doc_id, score) of all (doc_id, text) for each of (item_id, text)."""
    bags = [(i, collections.Counter(found(t))) for i, t in docs]
    n_docs, total = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, b in bags:
            m = 75 + 25 * sum(b.values()) * n_docs // max(total, 1)
            s = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * b[t] // (1000 * b[t] + 12 * m)) for t, c in collections.Counter(found(text)).items() if b[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def tables(spark, folder, docs, items):
    spark.createDataFrame([(i, t, "x", 1.5) for i, t in docs], "doc_id long, text string, score string, query double").repartition(6).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def some(seed, n):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "日本", "A1", "Über", "a"]
    p = 1 / np.arange(1, len(words) + 1)
    texts = ["; ".join(rng.choice(words, int(rng.integers(0, 40)), p=p / p.sum())) for _ in range(n)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (3, texts[5]), (4, texts[4]), (n, None), (n + 1, "!?"), (n + 2, "w1 " * 20_000)]
    items = [(i, " ".join(rng.choice(words, int(rng.integers(1, 25))))) for i in range(30)] + [(99, None), (98, "unheard"), (None, "w3 w4"), (5, "w1 W1 w1 w7"), (5, "w1 W1 w1 w7")]
    return docs, items


@pytest.mark.parametrize("shard_bytes", [300, 8 << 20])
def test_query_against_scoring_everything(spark, tmp_path, shard_bytes, monkeypatch):
    docs, items = some(1, 400)
    tables(spark, tmp_path, docs, items)
    monkeypatch.setattr(search.build, "__defaults__", ("doc_id", "text", shard_bytes))
    got = op11_pair_bound_search(spark, str(tmp_path))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_blocks_of_queries_and_other_k(spark):
    docs, items = some(2, 150)
    df = spark.createDataFrame(docs, "id long, body string").repartition(3)
    asked = spark.createDataFrame([(t, i, 0) for i, t in items], "said string, item_id long, rank int")
    out = search.search(search.build(df, "id", "body", 500), asked, "said", k=3, block_terms=40)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, out.collect()), key=str) == brute(docs, items, 3)


@pytest.mark.parametrize(("docs", "items"), [([], []), ([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")]), ([(1, "a")] * 25, [(1, "a")])])
def test_few_rows(spark, tmp_path, docs, items):
    tables(spark, tmp_path, docs, items)
    assert sorted(map(tuple, op11_pair_bound_search(spark, str(tmp_path)).collect()), key=str) == brute(docs, items)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    want = con.execute(ORACLE_SQL["op11_pair_bound_search"]).fetchall()
    assert len(want) > 100 and sorted(map(tuple, op11_pair_bound_search(spark, SF).collect())) == sorted(want)


@given(st.data())
def test_bounds_hold_and_pairs_tighten_them(data):
    n = data.draw(st.integers(1, 6))
    impact = np.array(data.draw(st.lists(st.lists(st.integers(0, 50), min_size=n, max_size=n), min_size=1, max_size=8)), np.int64)
    c = np.array(data.draw(st.lists(st.integers(1, 3), min_size=n, max_size=n)), np.int64)
    u = impact.max(0) * c
    both = (impact[:, :-1] > 0) & (impact[:, 1:] > 0)
    joint = np.where(both, impact[:, :-1] + impact[:, 1:], 0).max(0) if n > 1 else np.zeros(0, np.int64)
    prefix = search.prefix_bounds(u.tolist(), search.pair_bounds(u, c, joint).tolist() if n > 1 else [])
    true = np.cumsum(impact * c, 1)
    assert all(true[:, i].max() <= prefix[i + 1] <= u[: i + 1].sum() for i in range(n))
    least = data.draw(st.integers(1, max(1, prefix[-1])))
    if prefix[-1] >= least:
        s, paired = search.candidates(least, u.tolist(), prefix)
        for row in impact:
            if (row * c).sum() >= least:
                assert row[s:].any()
                if paired and not row[s + 2 :].any():
                    assert row[s] and row[s + 1]


def test_pair_bounds_skip_what_single_bounds_do_not():
    u, c = np.array([10, 12, 20]), np.array([1, 1, 1])
    prefix = search.prefix_bounds(u.tolist(), search.pair_bounds(u, c, np.array([0, 21])).tolist())
    assert prefix == [0, 10, 12, 31]  # singly 0, 10, 22, 42
    assert search.candidates(32, u.tolist(), prefix)[0] == 3 and search.candidates(25, u.tolist(), prefix) == (2, False)
    assert search.candidates(12, [5, 6, 20], [0, 5, 11, 31]) == (2, False) and search.candidates(11, [5, 6, 20], [0, 5, 11, 31]) == (1, False)
    assert search.candidates(8, [6, 7, 20], [0, 6, 13, 31]) == (1, False) and search.candidates(8, [3, 6, 7, 20], [0, 3, 8, 12, 31]) == (1, False)
    assert search.candidates(10, [1, 7, 8, 40], [0, 1, 8, 12, 50]) == (2, False) and search.candidates(10, [1, 7, 8, 40], [0, 1, 12, 14, 50]) == (1, True)
