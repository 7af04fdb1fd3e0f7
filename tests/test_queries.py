"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def _names():
    import __spark_entry__ as e

    llm = ("op", "pipeline")
    return [n for n in e.oracle_sql() if not n.startswith(llm)]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if type(v).__name__ in ("Timestamp", "datetime", "date"):
        return str(v)[:10]
    return repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", _names())
def test_query(spark, con, name):
    import __spark_entry__ as e

    df = e.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(map(norm, r)) for r in df.select(*cols).collect())
    r = con.execute(e.oracle_sql()[name])
    at = [d[0] for d in r.description]
    assert sorted(at) == cols
    want = sorted(tuple(norm(x[at.index(c)]) for c in cols) for x in r.fetchall())
    assert got == want
