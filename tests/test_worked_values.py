"""Rules with expected values worked by hand or by pandas, apart from the SQL that the queries are compared with."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelframe.functions import expr as X
from panelframe.operators import cohorts, evaluate, exposure, pit
from panelframe.plans import factors as FX


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


def ratios(df):
    return [r.ratio for r in df.orderBy("d").collect()]


def test_hybrid_matrix(spark):
    b = spark.createDataFrame([(day(i), v) for i, v in enumerate((1.0, 0.0, 1.0, 0.0))], "d date, ratio double")
    c = spark.createDataFrame([(day(i), v) for i, v in enumerate((1.0, 1.0, 0.0, 0.0))], "d date, ratio double")
    assert ratios(exposure.hybrid(b, c, "d")) == [1.0, 0.3, 0.5, 0.0]


def test_a_batch_without_loss_resets(spark):
    df = spark.createDataFrame([(day(i), v) for i, v in enumerate((-0.1, 0.0, -0.1, -0.1, -0.1, 0.2))], "d date, p double")
    assert ratios(exposure.after_losses(df, "d", "p")) == [0.5, 1.0, 0.5, 0.25, 0.125, 1.0]
    assert ratios(exposure.after_losses(df, "d", "p", floor=0.2)) == [0.5, 1.0, 0.5, 0.25, 0.2, 1.0]


def test_blind_window(spark):
    """Two rows a statistic: a correlation is the sign of the two steps, a deviation the large step's size over the root of 2 (below in units of that).

    Row 3: steps of opposite sign, -1 below the quantile -0.2 of (1, 1, -1). Row 4: size 0.5 below 0.995, and 9 is under its mean 10. Row 7: size 0.1
    below 0.496, but the close of the row before, 12, stands over its mean 11. A verdict holds for the next row.
    """
    small, large = (0, 1, 2, 3, 4, 5, 4, 5, 6), (0, 1, 3, 2, 2.5, 6.5, 6, 6.1, 7)
    close = (0, 10, 11, 9, 10, 10, 12, 10, 10)
    df = spark.createDataFrame([(day(i), float(s), float(g), float(c)) for i, (s, g, c) in enumerate(zip(small, large, close, strict=True))], "d date, s double, g double, close double")
    how = {"n": 2, "history": 4, "p_corr": 0.2, "p_vol": 0.33}
    assert ratios(exposure.blind_window(df, "d", "s", "g", "close", trend=2, **how)) == [1, 1, 1, 1, 0, 0, 1, 1, 1]
    assert ratios(exposure.blind_window(df, "d", "s", "g", "close", trend=0, **how)) == [1, 1, 1, 1, 0, 0, 1, 1, 0]
    assert ratios(exposure.blind_window(df, "d", "s", "g", "close", trend=2, avoid=0.4, **how))[4] == 0.4


def test_factor_drift(spark):
    """Two training rows, then two recent ones. Row 3: 0, 2 against 3, 3 is 2 over the root of 2. Rows 5, 7 and 8 train on constants: distances 2, 0.5 and 2 over 1e-8.

    From five values on the quantile at 0.75 decides: 5e7 on row 7 (met), 1.625e8 on row 8 (passed), 1.25e8 on row 9 (not reached). A verdict holds for the next row.
    """
    values = (0, 2, 3, 3, 1, 1, 1, 2, 4, 4, 4)
    df = spark.createDataFrame([(day(i), float(v), None) for i, v in enumerate(values)], "d date, a double, none double")
    got = exposure.factor_drift(df, "d", ["a", "none"], window=4, ahead=2, history=8).orderBy("d").collect()
    root = 2**0.5
    assert [r.drift for r in got[:3]] == [None] * 3
    assert [r.drift for r in got[3:10]] == pytest.approx([2 / root, 0.5 * root, 2e8, 1 / root, 5e7, 2e8, 2.5 * root])
    assert [r.ratio for r in got] == [1] * 8 + [0, 0, 1]


def test_factor_kinds(spark):
    rows = [("a", 0.02, -0.1, True), ("b", -0.02, -0.1, True), ("c", -0.02, 0.0, True), ("d", 0.005, -9.0, True), ("e", 0.5, 0.5, False), ("f", -0.01, -1.0, True)]
    df = spark.createDataFrame(rows, "f string, i double, t double, reliable boolean")
    assert [r.kind for r in evaluate.classify(df, "i", "t").orderBy("f").collect()] == ["positive", "harmful", "trade_off", "neutral", "unreliable", "neutral"]


def test_statement_factors(spark):
    """Two quarters and the year before: accruals ((100-20)-(60-5)) = 25 and ((140-30)-(70-10)) = 50 over mean assets 120."""
    names = "total_revenue n_income n_income_attr_p total_assets oper_cost total_liab money_cap st_borr total_hldr_eqy_exc_min_int"
    rows = [("x", dt.date(2022, 12, 31), 40.0, 4.0, 3.0, 100.0, 30.0, 60.0, 20.0, 5.0, 40.0), ("x", dt.date(2023, 3, 31), 50.0, -5.0, 9.0, 140.0, 20.0, 70.0, 30.0, 10.0, 60.0), ("x", dt.date(2023, 12, 31), 60.0, 6.0, 6.0, 150.0, 30.0, 75.0, 30.0, None, 0.0)]
    df = spark.createDataFrame(rows, "e string, end date, " + ", ".join(f"{n} double" for n in names.split()))
    a, b, c = pit.statement_factors(df, "e", "end").orderBy("end").collect()
    assert (a.gross_margin, a.debt_ratio, a.roe_ttm, a.accruals, a.revenue_growth_yoy) == (0.25, 0.6, 3 / 40, 0.0, 0.0)
    assert (b.gross_margin, b.debt_ratio, b.accruals) == (0.6, 0.5, pytest.approx(25 / 120)) and b.roe_ttm == pytest.approx(12 / 50)
    assert (c.revenue_growth_yoy, c.profit_growth_yoy, c.asset_growth_yoy, c.accruals) == (0.5, 0.5, 0.5, 0.0) and c.roe_ttm == pytest.approx(18 / (100 / 3))
    bare = pit.statement_factors(df.select("e", "end", "total_revenue", "n_income", "total_assets"), "e", "end").collect()
    assert all((r.gross_margin, r.roe_ttm, r.accruals) == (0, 0, 0) for r in bare)


def test_force_index_is_unsmoothed(spark):
    p = pd.DataFrame({"entity": 1, "d": [day(i) for i in range(5)], "close_hfq": [10.0, 11.0, 10.5, None, 12.0], "vol": [1.0, 2.0, 3.0, 4.0, 5.0]})
    df = spark.createDataFrame(p).withColumn("close_hfq", F.when(~F.isnan("close_hfq"), F.col("close_hfq")))
    raw = p.vol * p.close_hfq.diff()
    want = raw.ewm(span=1, adjust=False).mean().fillna(0).tolist()
    assert [r.force_index for r in X.apply(df, FX.force_index()).orderBy("d").collect()] == pytest.approx(want)
    assert want == [0.0, 2.0, -1.5, -1.5, -1.5]


def test_size_tiers(spark):
    df = spark.createDataFrame([(day(0), v) for v in (0.0, 19.9, 20.0, 99.0, 100.0, 299.0, 300.0, 999.0, 1000.0, 5000.0)], "d date, mv double")
    r = cohorts.size_tiers(df, "d", "mv").first()
    assert (r.micro, r.small, r.mid, r.large, r.giant, r.mega) == (2, 1, 1, 2, 2, 2)


def test_virtual_cohorts_stop(spark):
    """Signal on row 10: virtual picks of rows 5, 6, 7 end on rows 11, 12, 13; two losses stop it on the day of the second."""
    cal = spark.createDataFrame([(day(i),) for i in range(30)], "d date")
    prices = spark.createDataFrame([("a", day(i), 100.0 - 3 * i if i < 20 else 40.0) for i in range(30)] + [("b", day(i), 10.0) for i in range(30)], "entity string, d date, p double")
    signals = cal.where(F.col("d") == day(10))
    both = lambda rows: cohorts.virtual_returns(spark.createDataFrame([(e, day(i)) for e, i in rows], "entity string, d date"), prices, cal, "d", "entity", "p")
    stop = lambda rows, **how: cohorts.virtual_stop(signals, both(rows), cal, "d", **how).first().stop_day
    assert stop([("a", 5), ("a", 6), ("a", 7)]) == day(12)
    assert stop([("b", 5), ("a", 6), ("a", 7)]) == day(13)
    assert stop([("b", 5), ("b", 6), ("a", 7)]) is None
    assert stop([("a", 5), ("b", 5), ("a", 6), ("b", 6)], bound=-0.2) is None  # half the loss of 17 and 18 per cent
    assert stop([("a", 6), ("a", 7)], holding=2) is None  # over before the second loss
    r = both([("a", 5)]).first()
    assert (r.idx, r.ret) == (6, pytest.approx((100 - 33) / (100 - 18) - 1))


def test_pairs_by_the_first_sell(spark):
    buys = spark.createDataFrame([("a", day(1), 10.0), ("a", day(5), 20.0), ("a", day(9), 5.0), ("b", day(0), 1.0)], "e string, d date, p double")
    sells = spark.createDataFrame([("a", day(1), 11.0), ("a", day(5), 22.0), ("a", day(5), 21.0), ("a", day(7), 30.0)], "e string, d date, p double")
    got = [(r.e, r.d, r.sell_date, r.sell_price, r.days) for r in cohorts.pair_trades(buys, sells, "e", "d", "p").orderBy("e", "d").collect()]
    assert got == [("a", day(1), day(1), 11.0, 0), ("a", day(5), day(5), 21.0, 0), ("a", day(9), None, None, None), ("b", day(0), None, None, None)]
