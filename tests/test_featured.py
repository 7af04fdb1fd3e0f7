"""The models' rows: bars are built once, and the values are those of scores joined with features."""

import os

import pytest

from panelframe import training_queries as TQ
from panelframe.functions import expr as X
from panelframe.operators import train as T
from panelframe.operator_queries import _scores
from panelframe.plans import panels as P

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_featured_rows_come_from_one_pass_over_the_bars(spark):
    got = TQ._featured(spark, SF)
    assert got._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1
    m = P.with_values(P.bars(spark, SF, "month"))
    want = T.standardized(_scores(spark, SF).join(X.apply(m, TQ._MADE).select("entity", "d", *TQ._MADE), ["entity", "d"]), "d", TQ._FEATURES)
    assert got.columns == want.columns
    a, b = (sorted(map(tuple, d.collect())) for d in (got, want))
    assert len(a) == len(b) > 100 and all(x[:2] == y[:2] and x[2:] == pytest.approx(y[2:], rel=1e-9, abs=1e-9) for x, y in zip(a, b, strict=True))
