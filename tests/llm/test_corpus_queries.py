"""The opN_ queries themselves: SQL where there is some, else brute force on the smallest given tables."""

import collections
import os
import re
import zlib

import duckdb
import pytest
from test_linededup import distance
from test_mixing import brute_targets
from test_simhash import brute_fingerprint, brute_groups

from panelframe.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


@pytest.fixture(scope="module")
def documents(con):
    return con.execute("select doc_id, text, source from documents").fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    r = con.execute(queries.ORACLE_SQL[name])
    at = [d[0] for d in r.description]
    assert sorted(at) == sorted(df.columns)
    got = collections.Counter(tuple(map(str, x)) for x in df.select(*at).collect())
    assert got == collections.Counter(tuple(map(str, x)) for x in r.fetchall())


def test_op1(spark, documents):
    prints = {i: brute_fingerprint(t) for i, t, _ in documents}
    want = brute_groups(prints)
    rows = queries.op1_simhash_near_dedup(spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def test_op5(spark, con):
    quality = dict(con.execute("select doc_id, quality from labels").fetchall())
    rows = queries.op5_rule_ensemble(spark, SF).collect()
    assert len(rows) == con.execute("select count(*) from documents").fetchone()[0]
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(r.score, quality[r.doc_id]) for r in rows if r.held_out and quality.get(r.doc_id) is not None]
    pos, neg = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    assert pos and neg and sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg) > 0.9


def test_op8(spark, documents):
    size = {i: len(WORD.findall(t or "")) for i, t, _ in documents}
    sizes = collections.Counter()
    for i, _, s in documents:
        sizes[s] += size[i]
    want, taken, largest = brute_targets(sizes), collections.Counter(), collections.Counter()
    rows = queries.op8_source_mixing(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(size)
    for r in rows:
        assert (r.size, r.source_size) == (size[r.doc_id], sizes[r.source]) and abs(r.target - want[r.source]) < 1e-6
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - want[s]) <= largest[s] + 1e-6 for s in want)


def test_op10(spark, documents):
    """A line goes if an earlier one is within one word and they share more than half of the longer one's words (equal lines: always)."""
    lines = [(i, n, tuple(WORD.findall(x.lower()))) for i, t, _ in sorted(documents) for n, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    by, gone = collections.defaultdict(list), collections.defaultdict(list)
    for i, n, w in lines:
        if any(v == w or 2 * (max(len(v), len(w)) - 1) > max(len(v), len(w)) and distance(v, w) <= 1 for v in candidates(by, w)):
            gone[i].append(n)
        for key in variants(w):
            by[key].append(w)
    rows = queries.op10_line_dedup(spark, SF).collect()
    assert {r.doc_id: sorted(r.removed) for r in rows if r.removed} == dict(gone)
    assert {r.doc_id: (r.n_lines, r.n_removed) for r in rows} == {i: (len((t or "").split("\n")), len(gone.get(i, ()))) for i, t, _ in documents}


def variants(w):
    return {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}


def candidates(by, w):
    return {v for key in variants(w) for v in by[key]}
