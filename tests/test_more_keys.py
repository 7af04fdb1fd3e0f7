"""Queries over tables with more keys than the given ones have: copies of the smallest tables with shifted keys."""

import os

import duckdb
import pytest

from tests.test_queries import SF, norm

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def copied(tmp_path, shifts, where="true"):
    """The smallest tables, with suppliers and their lines once for each shift of the supplier's key."""
    of = ", ".join(f"({k})" for k in shifts)
    for f in os.listdir(SF):
        s, n = f"'{SF}/{f}'", f[:-8]
        key = {"lineitem": "l_suppkey", "supplier": "s_suppkey"}.get(n)
        body = f"SELECT * FROM {s}" if key is None else f"SELECT * REPLACE ({key} + k AS {key}) FROM {s}, (VALUES {of}) x(k) WHERE {where}"
        duckdb.execute(f"COPY ({body}) TO '{tmp_path}/{f}' (FORMAT parquet)")
    return str(tmp_path)


def same(spark, at, name):
    import __spark_entry__ as e

    con = duckdb.connect()
    for f in os.listdir(at):
        con.execute(f"create view {f[:-8]} as select * from '{at}/{f}'")
    df = e.queries()[name](spark, at)
    cols = sorted(df.columns)
    r = con.execute(e.oracle_sql()[name])
    names = [d[0] for d in r.description]
    want = sorted(tuple(norm(x[names.index(c)]) for c in cols) for x in r.fetchall())
    assert want and sorted(tuple(map(norm, x)) for x in df.select(*cols).collect()) == want


def test_board_view_with_more_names_than_a_board_has_numbers(spark, tmp_path):
    same(spark, copied(tmp_path, (0, 1000, 88000, 112000)), "filter_board_view")
