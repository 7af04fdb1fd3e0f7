"""The registered queries of the panel operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelframe import factor_sql, oracle
from panelframe.functions import expr as X
from panelframe.functions.expr import Ex, col
from panelframe.plans import factors as FX
from panelframe.plans import panels as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- panels in SQL -------------------------------------------------------------------------

_AT = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


def bars_sql(unit: str = "week", name: str = "base", more: str = "") -> str:
    desc = ", ".join(f"{x} DESC" for x in _AT.split(", "))
    return f"""raw AS (SELECT l_suppkey AS entity, CAST(date_trunc('{unit}', l_shipdate) AS DATE) AS d,
        first(l_extendedprice / l_quantity ORDER BY {_AT}) AS open, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
        first(l_extendedprice / l_quantity ORDER BY {desc}) AS close_x, sum(l_quantity) AS vol, round(sum(l_extendedprice), 2) AS amount_x,
        round(1 + avg(l_tax), 6) AS adj_factor FROM lineitem GROUP BY ALL),
      adj AS (SELECT *, vol / 100 AS turnover_rate_x, open * adj_factor AS open_hfq, high * adj_factor AS high_hfq,
        low * adj_factor AS low_hfq, close_x * adj_factor AS close_hfq FROM raw),
      {name} AS (SELECT *, {_MV} AS circ_mv, {_MV} AS total_mv{more} FROM adj)"""


_MV = "round(sum(amount_x) OVER (PARTITION BY entity ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2)"
_EXTRA = {"pb": "close_x / 1000", "rzye": "vol * adj_factor", "net_amount": "amount_x * (adj_factor - 1)", "roe_ttm": "adj_factor - 1", "asset_growth_yoy": "adj_factor - 0.5"}
_EXTRA_SQL = "".join(f", {e} AS {n}" for n, e in _EXTRA.items())


def dense_sql(unit: str = "week") -> str:
    return bars_sql(unit, "filled") + ", base AS (SELECT e.entity, c.d, filled.* EXCLUDE (entity, d) FROM (SELECT DISTINCT entity FROM filled) e CROSS JOIN (SELECT DISTINCT d FROM filled) c LEFT JOIN filled ON filled.entity = e.entity AND filled.d = c.d)"


def bars(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    df = P.with_values(P.bars(spark, sf_dir, unit))
    return df.withColumns({n: F.expr(e) for n, e in _EXTRA.items()})


def dense(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    return P.densify(P.with_values(P.bars(spark, sf_dir, unit)))


# ---- factors: one query a family -----------------------------------------------------------

_DIGITS = {"": 6} | dict.fromkeys(
    "dif dea macd kdj_k kdj_d kdj_j raw_force_index force_index_smoothed force_index vwap positive_flow negative_flow ma_20d amount_ma_20d alpha101_9 alpha101_12 alpha101_23 alpha101_41 alpha101_52 alpha101_53 alpha101_57 smb_squared smb_squared_mom price_dist turnover_amplitude_ratio mad cum_vol kdj_k_chg_5d kdj_d_chg_5d kdj_j_chg_5d macd_chg_5d kdj_k_chg_10d kdj_d_chg_10d kdj_j_chg_10d macd_chg_10d mean_10 sum_10 std_10 quantile_20 mad_10 corr_10 cov_10 slope_18".split(), 3
) | {"amount_ma_20d": 4} | dict.fromkeys("lag_2 lead_3 delta_5 min_10_1 max_10 alpha101_9 alpha101_12 alpha101_23 alpha101_41 vwap positive_flow negative_flow raw_force_index force_index force_index_smoothed price_dist mtm_margin_balance_change alpha101_11 alpha101_20 alpha101_11_x alpha101_20_x".split())  # exact: not rounded


_DIGITS |= {f"{k}_raw": v for k, v in _DIGITS.items() if k}


def _family(name: str, named: dict[str, Ex], panel: Callable, sql: str, by_hand: tuple[list, list] | None = None) -> None:
    """by_hand: the family's steps and names in SQL that was written from the definitions; else the SQL is printed from the formulas."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        read = sorted(set().union(*map(FX.columns_of, named.values())))  # a pass over histories gets no other column
        return X.apply(panel(spark, sf_dir).select("entity", "d", *read), named, digits=_DIGITS, keep=("entity", "d")).select("entity", "d", *named)

    run.__name__ = name
    query(factor_sql.chain(sql, by_hand[0], list(named), _DIGITS) if by_hand else oracle.select(f"WITH {sql}", ["entity", "d"], named, _DIGITS))(run)


_BARS, _DENSE = bars_sql(more=_EXTRA_SQL), dense_sql()
_TECH = FX.technical()
_family("factors_labels", FX.labels(), dense, _DENSE, factor_sql.labels())
_family("factors_technical", _TECH, bars, _BARS, factor_sql.technical())
_family("factors_size_value", FX.size_value(), bars, _BARS, factor_sql.size_value())
_family("factors_margin_lists", FX.margin_and_lists(), bars, _BARS, factor_sql.margin_lists())
_family("factors_momentum_shape", FX.momentum(), bars, _BARS, factor_sql.momentum())
_family("factors_momentum_gaps", FX.momentum(), dense, _DENSE, factor_sql.momentum())
_family("factors_poly_shape", FX.poly_shape(), bars, _BARS, factor_sql.poly_shape())
_family("factors_time_changes", FX.time_changes({**_TECH, "momentum_12_1": FX.size_value()["momentum_12_1"], "turnover_rate_x": col("turnover_rate_x"), "rzye": col("rzye")}), bars, _BARS, factor_sql.time_changes())
_family("factors_alpha101", FX.alpha101(), bars, _BARS, factor_sql.alpha101())
_family("factors_alpha101_cross_section", {f"{k}_x": v for k, v in FX.alpha101(X.x_rank).items() if k in ("alpha101_3", "alpha101_11", "alpha101_20", "alpha101_33")}, bars, _BARS)
_family("factors_risk", FX.risk(long=104, rsrs_rows=60), dense, _DENSE, factor_sql.risk(104, 60))
_family("factors_risk_long", {k: v for k, v in FX.risk().items() if "750" in k or k == "rsrs"}, dense, _DENSE, factor_sql.risk(750, 200))
_family("factors_liquidity", FX.liquidity(52, 104), dense, _DENSE, factor_sql.liquidity(52, 104))
_family("factors_liquidity_long", {k: v for k, v in FX.liquidity().items() if "504" in k or "252d" in k}, dense, _DENSE, factor_sql.liquidity(252, 504))
_family("factors_price_distance", {"price_dist_5": FX.price_distance(window=5)}, bars, _BARS, ([[f"CASE WHEN close_hfq < 10 THEN ceil(close_hfq) - close_hfq WHEN close_hfq < 100 THEN ceil(close_hfq / 10) * 10 - close_hfq ELSE ceil(close_hfq / 100) * 100 - close_hfq END AS dist"], [f"{factor_sql.roll('avg', 'dist', 5)} AS price_dist_5"]], []))
_family("factors_legacy_raw", {f"{k}_raw": v for k, v in FX.legacy().items()}, bars, _BARS, factor_sql.legacy())

# ---- kernels -------------------------------------------------------------------------------

_C, _V = col("close_hfq"), col("vol")
_PX = X.ffill(_C)
_RET = X.pct(_PX, 1)
_up = X.where(_RET > 0, 1.0, 0.0)
_family("kernels_shift", {"lag_2": X.lag(_C, 2), "lead_3": X.lead(_C, 3), "delta_5": X.delta(_C, 5), "pct_padded_5": X.pct(_PX, 5), "pct_plain_5": X.pct(_C, 5)}, dense, _DENSE)
_family(
    "kernels_rolling",
    {"mean_10": X.mean(_C, 10), "sum_10": X.total(_V, 10), "min_10_1": X.low(_C, 10, 1), "max_10": X.high(_C, 10), "std_10": X.std(_C, 10), "corr_10": X.corr(_C, _V, 10, 5), "cov_10": X.cov(_C, _V, 10, 5), "quantile_20": X.quantile(_C, 0.2, 20, 10), "compound_8": X.compound(_RET, 8), "mad_10": X.mad(_PX, 10), "slope_18": X.slope(_C, _V, 18)},
    dense,
    _DENSE,
)
_family("kernels_rank", {"ts_rank_9": X.ts_rank(_PX, 9), "ts_argmax_9": X.ts_argmax(_PX, 9), "ts_argmin_9": X.ts_argmin(_PX, 9), "prank": X.prank(_C), "x_rank": X.x_rank(_C), "signed_power": X.signed_power(_RET, 2)}, dense, _DENSE)
_family(
    "kernels_cumulative",
    {"nav": X.cum_prod(1 + _RET), "drawdown": _PX / X.cum_max(_PX) - 1, "cum_vol": X.cum_sum(_V), "up_streak": X.streak(_RET > 0, _RET <= 0), "before_up": X.lag(X.ffill(X.where(_RET > 0, _RET)), 1), "trough": FX.flag((X.lag(_PX, 1) < X.lag(_PX, 2)) & (X.lag(_PX, 1) < _PX)), "z_60": (_RET - X.mean(_RET, 60, 20)) / X.std(_RET, 60, 20), "clipped": X.least(X.greatest(_RET, -0.03), 0.03)},
    dense,
    _DENSE,
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Momentum over 21 weeks of padded prices, standardised by date; the ten best names of every date with the later return."""
    named = {"momentum": X.pct(_PX, 21), "label": FX.label(1)}
    z = (named["momentum"] - X.x_mean(named["momentum"])) / X.x_std(named["momentum"])
    df = X.apply(dense(spark, sf_dir), {"score": z, "label": named["label"]}, digits={"": 6}).where("score is not null")
    place = F.row_number().over(Window.partitionBy("d").orderBy(F.desc("score"), "entity"))
    return df.withColumn("place", place).where("place <= 10").select("d", "place", "entity", "score", "label")


_m = X.pct(_PX, 21)
query(
    "WITH q AS ("
    + oracle.select(f"WITH {_DENSE}", ["entity", "d"], {"score": (_m - X.x_mean(_m)) / X.x_std(_m), "label": FX.label(1)}, {"": 6})
    + ") SELECT d, place, entity, score, label FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, entity) AS place FROM q WHERE score IS NOT NULL) WHERE place <= 10"
)(flagship)
