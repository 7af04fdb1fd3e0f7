"""Queries of joins, statements, cross-sections, evaluation, exposure and cohorts, with their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelframe.functions import expr as X
from panelframe.operators import cohorts as B
from panelframe.operators import evaluate as E
from panelframe.operators import exposure as G
from panelframe.operators import joins as N
from panelframe.operators import order as OR
from panelframe.operators import pit
from panelframe.operators import relational as H
from panelframe.operators import xsection as XS
from panelframe.plans import factors as FX
from panelframe.plans import panels as P
from panelframe.queries import ORACLE_SQL, bars_sql, query
from panelframe.sources.shared import shared_folder
from panelframe.sources.versions import Versions


def _round(df: DataFrame, n: int = 6, **other: int | None) -> DataFrame:
    """Doubles rounded, without negative zero; None: left as they are."""
    return df.select(*[(F.round(c, other.get(c, n)) + F.lit(0.0)).alias(c) if t == "double" and other.get(c, n) is not None else F.col(c) for c, t in df.dtypes])


def _r(names: str, n: int = 6) -> str:
    return ", ".join(f"round({x}, {n}) + 0.0 AS {x}" for x in names.split())


_DIM = "dim AS (SELECT s_suppkey AS entity, s_name AS name, r_name AS industry, s_nationkey AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
_M = bars_sql("month", "m")
_W = bars_sql("week", "w")
_FIL = """fq AS (SELECT c_nationkey AS nation, date_trunc('quarter', o_orderdate) AS q, round(sum(o_totalprice), 2) AS total_revenue,
   round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0), 2) AS n_income, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F' AND o_orderpriority[1] <> '1'), 0), 2) AS n_income_attr_p,
   round(coalesce(sum(o_totalprice) FILTER (o_orderstatus <> 'O'), 0), 2) AS oper_cost, round(coalesce(sum(o_totalprice) FILTER (o_orderpriority[1] = '1'), 0), 2) AS cash,
   round(coalesce(sum(o_totalprice) FILTER (o_orderpriority[1] = '2'), 0), 2) AS debt FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
   fr AS (SELECT *, round(sum(total_revenue) OVER r, 2) AS total_assets, round(sum(debt) OVER r, 2) AS total_liab, round(sum(cash) OVER r, 2) AS money_cap FROM fq WINDOW r AS (PARTITION BY nation ORDER BY q)),
   fil AS (SELECT nation, CAST(q + INTERVAL 3 MONTH AS DATE) - 1 AS end_date, CAST(q + INTERVAL 3 MONTH AS DATE) - 1 + CAST(30 + nation % 15 AS INTEGER) AS f_ann_date, total_revenue, n_income, total_assets,
   n_income_attr_p, oper_cost, total_liab, money_cap, CASE WHEN nation % 7 <> 3 THEN debt END AS st_borr, round(total_assets - total_liab, 2) AS equity FROM fr)"""


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month bars with industry."""
    return P.with_values(P.bars(spark, sf_dir, "month")).join(P.dimension(spark, sf_dir).select("entity", "industry"), "entity")


_MI = f"{_M}, {_DIM}, mi AS (SELECT m.*, industry FROM m JOIN dim USING (entity))"

# ---- joins -----------------------------------------------------------------------------------


@query(
    f"""WITH {_W} SELECT coalesce(a.entity, b.entity) AS entity, coalesce(a.d, b.d) AS d, a.vol AS vol_x, a.close_x AS close_a, b.vol AS vol_y, b.turnover_rate_x AS turn_b
    FROM (SELECT * FROM w WHERE vol > 60) a FULL JOIN (SELECT * FROM w WHERE vol < 90) b ON a.entity = b.entity AND a.d = b.d"""
)
def join_outer_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = P.bars(spark, sf_dir)
    a = w.where("vol > 60").select("entity", "d", "vol", F.col("close_x").alias("close_a"))
    b = w.where("vol < 90").select("entity", "d", "vol", F.col("turnover_rate_x").alias("turn_b"))
    return N.outer_join([a, b], ["entity", "d"])


@query(
    f"""WITH {_W}, {_DIM}, {_FIL} SELECT w.entity, w.d, coalesce(f.total_revenue, 0) AS total_revenue, coalesce(f.n_income, 0) AS n_income
    FROM (SELECT w.*, nation FROM w JOIN dim USING (entity)) w ASOF LEFT JOIN fil f ON w.nation = f.nation AND w.d >= f.f_ann_date"""
)
def join_asof_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = P.bars(spark, sf_dir).select("entity", "d").join(P.dimension(spark, sf_dir).select("entity", "nation"), "entity")
    fil = P.filings(spark, sf_dir)
    return pit.known_at(w, fil, "nation", "d", "f_ann_date", ["total_revenue", "n_income"]).drop("nation")


_DAYS = "days AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)"
_SPELLS = "spells AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS start, CASE WHEN event_id % 50 = 0 THEN NULL ELSE CAST(ts AS DATE) + 7 END AS stop FROM events WHERE event_type = 'error')"


def _spells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = P.table(spark, sf_dir, "events")
    day = F.to_date("ts")
    stop = F.when(F.col("event_id") % 50 != 0, F.date_add(day, 7))
    return e.where("event_type = 'error'").select("user_id", day.alias("start"), stop.alias("stop")).distinct(), e.select(day.alias("day")).distinct()


@query(
    f"""WITH {_DAYS}, {_SPELLS} SELECT u.user_id, day, CAST(coalesce(max(1) FILTER (s.user_id IS NOT NULL), 0) AS INTEGER) AS flag
    FROM (SELECT DISTINCT user_id FROM spells) u CROSS JOIN days LEFT JOIN spells s ON s.user_id = u.user_id AND day BETWEEN s.start AND coalesce(s.stop, DATE '9999-01-01') GROUP BY ALL"""
)
def join_interval_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    spells, days = _spells(spark, sf_dir)
    return N.expand_intervals(spells, days, "user_id", "start", "stop", "day")


@query(
    f"""WITH {_M}, i AS (SELECT d, row_number() OVER (ORDER BY d) AS idx FROM (SELECT DISTINCT d FROM m))
    SELECT a.entity, a.d, a.vol, b.vol AS vol_after FROM m a JOIN i USING (d) LEFT JOIN (SELECT entity, idx, vol FROM m JOIN i USING (d)) b ON b.entity = a.entity AND b.idx = i.idx + 3"""
)
def join_calendar_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.bars(spark, sf_dir, "month").select("entity", "d", "vol")
    return N.offset_join(m, m, "entity", "d", 3, ["vol"], "_after")


@query(
    f"""WITH {_W}, b AS (SELECT DISTINCT d FROM w WHERE extract('day' FROM d) <= 7), s AS (SELECT d, round(sum(amount_x), 2) AS amount FROM w GROUP BY d)
    SELECT s.d, s.amount, (SELECT max(b.d) FROM b WHERE b.d < s.d) AS batch FROM s"""
)
def join_between_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = P.bars(spark, sf_dir)
    s = w.groupBy("d").agg(F.round(F.sum("amount_x"), 2).alias("amount"))
    return N.between_batches(s, w.where(F.dayofmonth("d") <= 7).select("d").distinct(), "d", "d").select("d", "amount", "batch")


@query(f"""WITH {_M} SELECT entity, d, vol, CAST(1 AS INTEGER) AS side FROM m WHERE d >= DATE '1998-01-01' UNION ALL
    SELECT entity, d, vol + 1, 0 FROM m WHERE entity % 2 = 0 AND d < DATE '1998-01-01'""")
def join_keep_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.bars(spark, sf_dir, "month").select("entity", "d", "vol")
    old = m.where("entity % 2 = 0").select("entity", "d", (F.col("vol") + 1).alias("vol"), F.lit(0).alias("side"))
    new = m.where("d >= '1998-01-01'").withColumn("side", F.lit(1))
    return N.keep_old(old, new, ["entity", "d"])


@query(f"WITH {_DIM}, {_M} SELECT m.entity, d, name, CASE WHEN vol > 500 THEN coalesce(industry, '') ELSE industry END AS industry, coalesce(x.big, 0) AS big FROM m JOIN dim USING (entity) LEFT JOIN (SELECT entity, d, CAST(1 AS INTEGER) AS big FROM m WHERE vol > 500) x USING (entity, d)")
def join_dimension_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.bars(spark, sf_dir, "month").select("entity", "d", "vol")
    named = m.join(P.dimension(spark, sf_dir).select("entity", "name", "industry"), "entity")
    big = m.where("vol > 500").select("entity", "d", F.lit(1).alias("big"))
    return N.left_with_default(named, big, ["entity", "d"], {"big": 0}).drop("vol")


# ---- statements --------------------------------------------------------------------------------


@query(
    f"""WITH {_FIL}, f AS (SELECT a.*, b.total_revenue AS rev_ya, b.n_income AS inc_ya, b.total_assets AS ass_ya FROM fil a LEFT JOIN fil b ON a.nation = b.nation AND b.end_date = last_day(CAST(a.end_date - INTERVAL 12 MONTH AS DATE)))
    SELECT nation, end_date, {_r("roe_ttm revenue_growth_yoy profit_growth_yoy asset_growth_yoy accruals gross_margin debt_ratio")} FROM (SELECT nation, end_date,
      coalesce(sum(n_income_attr_p) OVER w4 / nullif(avg(equity) OVER w4, 0), 0) AS roe_ttm,
      coalesce((total_revenue - rev_ya) / CASE WHEN rev_ya <> 0 THEN abs(rev_ya) END, 0) AS revenue_growth_yoy,
      coalesce((n_income - inc_ya) / CASE WHEN inc_ya <> 0 THEN abs(inc_ya) END, 0) AS profit_growth_yoy,
      coalesce((total_assets - ass_ya) / CASE WHEN ass_ya <> 0 THEN abs(ass_ya) END, 0) AS asset_growth_yoy,
      coalesce((((total_assets - money_cap) - (total_liab - st_borr)) - lag((total_assets - money_cap) - (total_liab - st_borr)) OVER w) / ((total_assets + lag(total_assets) OVER w) / 2), 0) AS accruals,
      coalesce((total_revenue - oper_cost) / nullif(total_revenue, 0), 0) AS gross_margin, coalesce(total_liab / nullif(total_assets, 0), 0) AS debt_ratio
      FROM f WINDOW w AS (PARTITION BY nation ORDER BY end_date), w4 AS (PARTITION BY nation ORDER BY end_date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))"""
)
def statement_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pit.statement_factors(P.filings(spark, sf_dir), "nation", "end_date")
    return _round(out.select("nation", "end_date", "roe_ttm", "revenue_growth_yoy", "profit_growth_yoy", "asset_growth_yoy", "accruals", "gross_margin", "debt_ratio"))


@query(
    f"""WITH {_FIL}, c AS (SELECT nation, end_date, sum(total_revenue) OVER (PARTITION BY nation, year(end_date) ORDER BY end_date) AS ytd FROM fil)
    SELECT nation, end_date, round(CASE WHEN quarter(end_date) > 1 AND year(end_date) = year(lag(end_date) OVER w) THEN ytd - lag(ytd) OVER w ELSE ytd END, 2) + 0.0 AS ytd FROM c WINDOW w AS (PARTITION BY nation ORDER BY end_date)"""
)
def statement_single_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("nation", F.year("end_date")).orderBy("end_date").rowsBetween(Window.unboundedPreceding, 0)
    c = P.filings(spark, sf_dir).select("nation", "end_date", F.sum("total_revenue").over(w).alias("ytd"))
    return _round(pit.single_quarters(c, "nation", "end_date", ["ytd"]), 2)


@query(
    f"""WITH {_FIL}, v AS (SELECT nation, end_date, f_ann_date, total_revenue, CASE WHEN nation % 2 = 0 THEN n_income END AS n_income FROM fil UNION ALL SELECT nation, end_date, f_ann_date, total_revenue + 1, n_income FROM fil WHERE nation % 3 = 0)
    SELECT nation, end_date, f_ann_date, total_revenue, n_income FROM v QUALIFY row_number() OVER (PARTITION BY nation, end_date ORDER BY f_ann_date DESC, (total_revenue IS NOT NULL)::INT + (n_income IS NOT NULL)::INT DESC, total_revenue DESC, n_income DESC) = 1"""
)
def statement_best_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = P.filings(spark, sf_dir).select("nation", "end_date", "f_ann_date", "total_revenue", "n_income")
    v = f.withColumn("n_income", F.when(F.col("nation") % 2 == 0, F.col("n_income"))).unionByName(f.where("nation % 3 = 0").withColumn("total_revenue", F.col("total_revenue") + 1))
    return pit.best_version(v, ["nation", "end_date"], "f_ann_date", ["total_revenue", "n_income"])


@query(
    f"""WITH {_FIL}, b AS (SELECT nation, end_date, f_ann_date, total_assets AS v FROM fil), i AS (SELECT nation, end_date, f_ann_date, n_income AS v FROM fil WHERE nation % 2 = 0), c AS (SELECT nation, end_date, f_ann_date, total_revenue AS cash FROM fil WHERE nation % 3 = 0)
    SELECT b.nation, b.end_date, b.f_ann_date, b.v AS v_x, i.v AS v_y, c.cash FROM b LEFT JOIN i USING (nation, end_date, f_ann_date) LEFT JOIN c USING (nation, end_date, f_ann_date)"""
)
def statement_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, k = P.filings(spark, sf_dir), ["nation", "end_date", "f_ann_date"]
    return pit.join_statements(f.select(*k, F.col("total_assets").alias("v")), f.where("nation % 2 = 0").select(*k, F.col("n_income").alias("v")), f.where("nation % 3 = 0").select(*k, F.col("total_revenue").alias("cash")), k)


@query(f"WITH {_FIL} SELECT nation, f_ann_date, max(end_date) AS end_date FROM fil GROUP BY ALL")
def statement_by_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = pit.latest_restatement(P.filings(spark, sf_dir), "nation", "end_date", "f_ann_date")
    return pit.by_disclosure(f, "nation", "f_ann_date", "end_date").select("nation", "f_ann_date", "end_date")



def _quality_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars with what the supplier's nation had disclosed; measures that the tables lack are made from those they have."""
    w = P.with_values(P.bars(spark, sf_dir)).join(P.dimension(spark, sf_dir).select("entity", "nation"), "entity")
    own = pit.statement_factors(P.filings(spark, sf_dir), "nation", "end_date").withColumnsRenamed({"total_hldr_eqy_exc_min_int": "equity"})
    own = own.withColumns({n: F.expr(e) for n, e in _MADE.items()})
    names = ["total_revenue", "n_income", "total_assets", "total_liab", "equity", "roe_ttm", "gross_margin", "debt_ratio", "accruals", "revenue_growth_yoy", "profit_growth_yoy", "asset_growth_yoy", *_MADE]
    return pit.known_at(w, own, "nation", "d", "f_ann_date", names)


_MADE = {"eps": "n_income / 1e6", "n_cashflow_act": "n_income - oper_cost / 4", "free_cashflow": "n_income - oper_cost / 2", "total_cur_assets": "money_cap + total_revenue", "total_cur_liab": "coalesce(st_borr, 0) + oper_cost", "inventories": "oper_cost / 3"}
_YEAR, _QUARTER = 52, 13
_Q0 = {"sales_to_market": "total_revenue / v", "earnings_to_price": "eps / nullif(close_x, 0)", "book_to_market": "equity / v", "ocf_to_market": "n_cashflow_act / v", "fcf_to_market": "free_cashflow / v",
       "q_roe_ttm": "roe_ttm", "roa_ttm": "n_income / nullif(total_assets, 0)", "q_gross_margin": "gross_margin", "net_margin": "margin", "debt_to_assets": "debt_ratio", "current_ratio": "total_cur_assets / nullif(total_cur_liab, 0)",
       "quick_ratio": "(total_cur_assets - inventories) / nullif(total_cur_liab, 0)", "cash_flow_to_debt": "n_cashflow_act / nullif(total_liab, 0)", "q_accruals": "accruals", "earnings_quality": "n_cashflow_act / nullif(n_income, 0)",
       "q_revenue_growth_yoy": "revenue_growth_yoy", "q_profit_growth_yoy": "profit_growth_yoy", "q_asset_growth_yoy": "asset_growth_yoy"}
_Q1 = {"roe_growth_yoy": ("roe_ttm", _YEAR), "eps_growth_yoy": ("eps", _YEAR), "revenue_growth_qoq": ("total_revenue", _QUARTER), "profit_growth_qoq": ("n_income", _QUARTER), "gross_margin_growth": ("gross_margin", _YEAR), "net_margin_growth": ("margin", _YEAR), "ocf_growth_yoy": ("n_cashflow_act", _YEAR)}
_STATED = "total_revenue n_income total_assets total_liab equity roe_ttm gross_margin debt_ratio accruals revenue_growth_yoy profit_growth_yoy asset_growth_yoy".split()


@query(
    f"""WITH {bars_sql("week", "w")}, {_DIM}, {_FIL},
    fy AS (SELECT a.*, b.total_revenue AS rev_ya, b.n_income AS inc_ya, b.total_assets AS ass_ya FROM fil a LEFT JOIN fil b ON a.nation = b.nation AND b.end_date = last_day(CAST(a.end_date - INTERVAL 12 MONTH AS DATE))),
    own AS (SELECT *, coalesce(sum(n_income_attr_p) OVER w4 / nullif(avg(equity) OVER w4, 0), 0) AS roe_ttm, coalesce((total_revenue - oper_cost) / nullif(total_revenue, 0), 0) AS gross_margin, coalesce(total_liab / nullif(total_assets, 0), 0) AS debt_ratio,
      coalesce((((total_assets - money_cap) - (total_liab - st_borr)) - lag((total_assets - money_cap) - (total_liab - st_borr)) OVER w1) / nullif((total_assets + lag(total_assets) OVER w1) / 2, 0), 0) AS accruals,
      coalesce((total_revenue - rev_ya) / nullif(abs(rev_ya), 0), 0) AS revenue_growth_yoy, coalesce((n_income - inc_ya) / nullif(abs(inc_ya), 0), 0) AS profit_growth_yoy, coalesce((total_assets - ass_ya) / nullif(abs(ass_ya), 0), 0) AS asset_growth_yoy,
      {", ".join(f"{e} AS {n}" for n, e in _MADE.items())} FROM fy WINDOW w1 AS (PARTITION BY nation ORDER BY end_date), w4 AS (PARTITION BY nation ORDER BY end_date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
    base AS (SELECT w.entity, w.d, close_x, total_mv * 1e4 AS v, {", ".join(f"coalesce(f.{n}, 0) AS {n}" for n in (*_STATED, *_MADE))} FROM (SELECT w.*, nation FROM w JOIN dim USING (entity)) w ASOF LEFT JOIN own f ON w.nation = f.nation AND w.d >= f.f_ann_date),
    g AS (SELECT *, CASE WHEN total_revenue <> 0 THEN n_income / total_revenue END AS margin FROM base)
    SELECT entity, d, {", ".join(f"round(coalesce({e}, 0), 6) + 0.0 AS {n}" for n, e in _Q0.items())},
      {", ".join(f"round(coalesce(CASE WHEN abs(lag({c}, {k}) OVER w) > 1e-12 THEN ({c} - lag({c}, {k}) OVER w) / abs(lag({c}, {k}) OVER w) END, 0), 6) + 0.0 AS {n}" for n, (c, k) in _Q1.items())} FROM g WINDOW w AS (PARTITION BY entity ORDER BY d)"""
)
def factors_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statement factors, growth over 52 and 13 weeks."""
    made = FX.quality(_YEAR, _QUARTER)
    return FX.add(_quality_panel(spark, sf_dir), made, digits={"": 6}).select("entity", "d", *made)


_VERSIONS = """v AS (SELECT c_nationkey AS nation, CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH AS DATE) - 1 AS end_date, round(coalesce(sum(o_totalprice) FILTER (o_orderpriority[1] <> '5'), 0), 2) AS first_said,
    round(sum(o_totalprice), 2) AS later_said FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
    vs AS (SELECT nation, end_date, end_date + CAST(20 + nation % 9 AS INTEGER) AS ann, first_said AS revenue FROM v UNION ALL SELECT nation, end_date, end_date + CAST(60 + nation % 50 AS INTEGER), later_said FROM v WHERE nation % 4 <> 1)"""


def _restated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly revenue by nation in two versions: without the orders of least priority, and, but for some nations, with all of them weeks later (for some after the next quarter's first version)."""
    o, c = P.table(spark, sf_dir, "orders"), P.table(spark, sf_dir, "customer")
    end = F.date_sub(F.add_months(F.trunc("o_orderdate", "quarter"), 3), 1)
    total = lambda x: F.round(F.coalesce(F.sum(x), F.lit(0)), 2).cast("double")
    v = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("nation"), end.alias("end_date")).agg(total(F.when(~F.col("o_orderpriority").startswith("5"), F.col("o_totalprice"))).alias("early"), total("o_totalprice").alias("late"))
    version = lambda days, said: v.select("nation", "end_date", F.date_add("end_date", days.cast("int")).alias("ann"), F.col(said).alias("revenue"))
    n = F.col("nation")
    return version(20 + n % 9, "early").unionByName(version(60 + n % 50, "late").where(n % 4 != 1))


@query(f"WITH {_VERSIONS} SELECT nation, end_date, ann AS valid_from, lead(ann) OVER (PARTITION BY nation, end_date ORDER BY ann) AS valid_to, revenue FROM vs")
def statement_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version of a period with the days on which it is the last one."""
    return pit.validity(_restated(spark, sf_dir), "nation", "end_date", "ann").select("nation", "end_date", "valid_from", "valid_to", "revenue")


@query(
    f"""WITH {_VERSIONS}, days AS (SELECT DISTINCT CAST(date_trunc('week', l_shipdate) AS DATE) AS d FROM lineitem), g AS (SELECT n_nationkey AS nation, d FROM nation, days),
    k AS (SELECT g.nation, g.d, arg_max({{'end': vs.end_date, 'ann': vs.ann, 'revenue': vs.revenue}}, (vs.end_date, vs.ann)) AS x FROM g LEFT JOIN vs ON vs.nation = g.nation AND vs.ann <= g.d GROUP BY ALL)
    SELECT nation, d, x['end'] AS end_date, x['ann'] AS version_of, x['revenue'] AS revenue FROM k"""
)
def statement_as_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each nation and week the latest period that had been announced, with the values it had then."""
    days = P.bars(spark, sf_dir).select("d").distinct()
    panel = P.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation")).crossJoin(days)  # 25 nations
    return pit.known_versions(panel, _restated(spark, sf_dir), "nation", "d", "end_date", "ann", ["revenue"])


# ---- cross-section ---------------------------------------------------------------------------


def _neutral_sql(name: str) -> str:
    return f"""c AS (SELECT *, coalesce(industry, min(industry) OVER (PARTITION BY d), '') AS g, ln(circ_mv) - avg(ln(circ_mv)) OVER (PARTITION BY d) AS x FROM wz),
      s AS (SELECT d, g, count(*) AS n, avg(x) AS mx, avg({name}) AS my, covar_pop(x, {name}) AS cxy, var_pop(x) AS vx FROM c WHERE {name} IS NOT NULL GROUP BY ALL),
      b AS (SELECT *, coalesce(sum(cxy * n) OVER (PARTITION BY d) / CASE WHEN sum(vx * n) OVER (PARTITION BY d) > 1e-9 THEN sum(vx * n) OVER (PARTITION BY d) END, 0) AS beta, sum(n) OVER (PARTITION BY d) AS n_all FROM s),
      nz AS (SELECT c.entity, c.d, c.{name}, CASE WHEN n_all >= 2 AND c.{name} IS NOT NULL THEN c.{name} - my - beta * (c.x - mx) END AS neutral FROM c LEFT JOIN b ON c.d = b.d AND c.g = b.g)"""


_WZ = """q AS (SELECT d, quantile_cont(turnover_rate_x, 0.01) AS lo, quantile_cont(turnover_rate_x, 0.99) AS hi FROM mi GROUP BY d),
      wz AS (SELECT mi.* REPLACE (least(greatest(turnover_rate_x, lo), hi) AS turnover_rate_x) FROM mi JOIN q USING (d))"""


@query(
    f"""WITH {_MI}, {_WZ}, {_neutral_sql("turnover_rate_x")}, z AS (SELECT *, stddev_samp(neutral) OVER (PARTITION BY d) AS sd, avg(neutral) OVER (PARTITION BY d) AS mu FROM nz)
    SELECT entity, d, round(turnover_rate_x, 6) + 0.0 AS turnover_rate_x, round(neutral, 6) + 0.0 AS turnover_rate_x_neutral, round(CASE WHEN sd > 1e-9 THEN (neutral - mu) / sd END, 6) + 0.0 AS turnover_rate_x_standard FROM z"""
)
def xsection_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = XS.standardize(_monthly(spark, sf_dir), "d", "industry", "circ_mv", ["turnover_rate_x"])
    return _round(out.select("entity", "d", "turnover_rate_x", "turnover_rate_x_neutral", "turnover_rate_x_standard"))


@query(
    f"""WITH {_M}, z AS (SELECT entity, d, vol, stddev_pop(vol) OVER w AS sd, avg(vol) OVER w AS mu, count(vol) OVER w AS n FROM m WINDOW w AS (PARTITION BY d))
    SELECT entity, d, round(CASE WHEN n >= 5 AND sd > 1e-8 THEN coalesce(least(greatest((vol - mu) / sd, -3), 3), 0) END, 6) + 0.0 AS z FROM z"""
)
def xsection_clipped_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(P.bars(spark, sf_dir, "month").select("entity", "d", XS.clipped_zscore(F.col("vol"), "d", least=5).alias("z")))


_IND = f"""{_MI}, rr AS (SELECT *, close_hfq / lag(close_hfq) OVER (PARTITION BY entity ORDER BY d) - 1 AS ret FROM mi),
  a AS (SELECT d, industry, avg(ret) AS r, avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret <= 0 THEN 0.0 END) AS up, sum(amount_x * (adj_factor - 1.04)) AS flow, sum(circ_mv) AS mv, quantile_cont(turnover_rate_x, 0.5) AS pe FROM rr GROUP BY ALL),
  f AS (SELECT d, industry, sum(r) OVER w1 AS ind_ret_1d, sum(r) OVER w5 AS ind_ret_5d, sum(r) OVER w20 AS ind_ret_20d, avg(up) OVER w5 AS ind_up_5d, avg(up) OVER w20 AS ind_up_20d,
     sum(flow) OVER w5 / avg(mv) OVER w20 AS ind_flow_5d, sum(flow) OVER w20 / avg(mv) OVER w20 AS ind_flow_20d,
     CASE WHEN count(pe) OVER w60 >= 20 AND stddev_samp(pe) OVER w60 > 1e-9 THEN (pe - avg(pe) OVER w60) / stddev_samp(pe) OVER w60 END AS ind_pe_z FROM a
     WINDOW w1 AS (PARTITION BY industry ORDER BY d ROWS BETWEEN 0 PRECEDING AND CURRENT ROW), w5 AS (PARTITION BY industry ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
       w20 AS (PARTITION BY industry ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), w60 AS (PARTITION BY industry ORDER BY d ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))"""


def _returns(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("entity").orderBy("d")
    return df.withColumns({"ret": F.try_divide("close_hfq", F.lag("close_hfq").over(w)) - 1, "flow": F.col("amount_x") * (F.col("adj_factor") - 1.04)})


@query(
    f"""WITH {_IND} SELECT d, industry, {_r("ind_ret_1d ind_ret_5d ind_ret_20d ind_up_5d ind_up_20d ind_flow_5d ind_flow_20d ind_pe_z")},
    round(CASE WHEN ind_ret_20d IS NOT NULL THEN (rank() OVER (PARTITION BY d ORDER BY round(ind_ret_20d, 9) NULLS LAST) + (count(*) OVER (PARTITION BY d, round(ind_ret_20d, 9)) - 1) / 2.0) / count(ind_ret_20d) OVER (PARTITION BY d) END, 6) + 0.0 AS ind_mom_rank FROM f"""
)
def market_industry_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(XS.industry_features(_returns(_monthly(spark, sf_dir)), "d", "industry", "ret", "flow", "circ_mv", "turnover_rate_x"))


def _market_z(c: str) -> str:
    w = "(ORDER BY d ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
    return f"round(CASE WHEN count({c}) OVER {w} >= 20 AND stddev_samp({c}) OVER {w} > 1e-9 THEN ({c} - avg({c}) OVER {w}) / stddev_samp({c}) OVER {w} END, 6) + 0.0 AS {c}"


@query(
    f"""WITH {_M}, rr AS (SELECT *, close_hfq / lag(close_hfq) OVER (PARTITION BY entity ORDER BY d) - 1 AS ret FROM m), a AS (SELECT d, avg(ret) AS r, avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret <= 0 THEN 0.0 END) AS up FROM rr GROUP BY d),
    f AS (SELECT d, sum(r) OVER (ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS mkt_ret_5d, sum(r) OVER (ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS mkt_ret_20d, up AS mkt_up_1d, avg(up) OVER (ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS mkt_up_5d FROM a)
    SELECT d, {", ".join(_market_z(c) for c in ("mkt_ret_5d", "mkt_ret_20d", "mkt_up_1d", "mkt_up_5d"))} FROM f"""
)
def market_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(XS.market_features(_returns(P.bars(spark, sf_dir, "month")), "d", "ret"))


@query(f"WITH {_MI}, done AS (SELECT DISTINCT d FROM mi WHERE month(d) <> 3) SELECT DISTINCT d FROM mi WHERE d NOT IN (SELECT d FROM done)")
def xsection_pending_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.bars(spark, sf_dir, "month")
    return XS.pending_dates(m, m.where(F.month("d") != 3), "d")


@query(f"WITH {_MI}, b AS (SELECT DISTINCT d, month(d) NOT IN (3, 7) AS built, month(d) NOT IN (3, 5, 7) AS done FROM mi) SELECT d, NOT built AS to_build FROM b WHERE NOT done")
def xsection_unfinished_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates not built, and dates built but not standardised."""
    m = P.bars(spark, sf_dir, "month").select("d").distinct()
    return XS.unfinished_dates(m, m.where(~F.month("d").isin(3, 7)), m.where(~F.month("d").isin(3, 5, 7)), "d")


@query(f"WITH {_MI}, q AS (SELECT d, quantile_cont(vol, [0.01, 0.25, 0.5, 0.99]) AS q FROM mi GROUP BY d) SELECT d, round(q[1], 6) AS p01, round(q[2], 6) AS p25, round(q[3], 6) AS p50, round(q[4], 6) AS p99 FROM q")
def xsection_exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of dates of any size, from one range-partitioned table of values."""
    q = OR.quantiles(_monthly(spark, sf_dir), "d", "vol", [0.01, 0.25, 0.5, 0.99])
    return _round(q.select("d", *[F.col("quantiles")[i].alias(n) for i, n in enumerate(("p01", "p25", "p50", "p99"))]))


@query(f"WITH {_MI} SELECT entity, d, round((rank() OVER (PARTITION BY d ORDER BY round(vol, 9)) + (count(*) OVER (PARTITION BY d, round(vol, 9)) - 1) / 2.0) / count(vol) OVER (PARTITION BY d), 6) AS x_rank, (rank() OVER (PARTITION BY entity ORDER BY round(close_hfq, 9)) + (count(*) OVER (PARTITION BY entity, round(close_hfq, 9)) - 1) / 2.0) AS own_rank FROM mi")
def xsection_exact_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average ranks of groups of any size, by date and by history."""
    df = OR.average_ranks(_monthly(spark, sf_dir).select("entity", "d", "vol", "close_hfq"), "d", "vol", "x_rank")
    return OR.average_ranks(df, "entity", "close_hfq", "own_rank", share=False).select("entity", "d", F.round("x_rank", 6).alias("x_rank"), "own_rank")


@query(f"WITH {_MI}, q AS (SELECT d, quantile_cont(vol, 0.01) AS lo, quantile_cont(vol, 0.99) AS hi FROM mi GROUP BY d) SELECT entity, mi.d, round(least(greatest(vol, lo), hi), 6) + 0.0 AS vol FROM mi JOIN q USING (d)")
def xsection_winsorize_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(XS.winsorize(_monthly(spark, sf_dir).select("entity", "d", "vol"), "d", ["vol"], spread=True).select("entity", "d", "vol"))


@query(f"WITH {_W}, a AS (SELECT DISTINCT entity FROM w WHERE vol > 60), b AS (SELECT DISTINCT entity FROM w WHERE amount_x < 40000) SELECT entity, 'both' AS part FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT entity, 'first' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT entity, 'either' FROM (SELECT * FROM a UNION SELECT * FROM b)")
def set_key_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection, difference and union of keys."""
    w = P.bars(spark, sf_dir)
    return H.key_sets(w.where("vol > 60"), w.where("amount_x < 40000"), ["entity"])


@query(f"""WITH {_M}, r AS (SELECT *, 1 AS source FROM m UNION ALL SELECT * REPLACE (vol + 7 AS vol), 2 FROM m WHERE entity % 3 = 0) SELECT entity, d, arg_min(vol, source) AS vol FROM r GROUP BY entity, d""")
def set_transposed_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by entity to partitions by date, of an entity's rows of one date the first in a total order."""
    m = P.bars(spark, sf_dir, "month").select("entity", "d", "vol")
    both = m.withColumn("source", F.lit(1)).unionByName(m.where("entity % 3 = 0").withColumns({"vol": F.col("vol") + 7, "source": F.lit(2)}))
    t = Versions(spark, shared_folder(spark, "transposed"))
    t.replace(H.keep_one(both, ["entity", "d"], [F.col("source"), F.col("vol")]).select("entity", "d", "vol"))
    return t.read()


# ---- aggregates and sets -----------------------------------------------------------------------


@query(
    f"""WITH {_MI}, g AS (SELECT industry, count(vol) AS n, avg(vol) AS mean, stddev_samp(vol) AS std, min(vol) AS min, quantile_cont(vol, 0.01) AS p01, quantile_cont(vol, 0.25) AS p25, quantile_cont(vol, 0.5) AS median, quantile_cont(vol, 0.75) AS p75, quantile_cont(vol, 0.99) AS p99, max(vol) AS max, sum(vol) AS sum, count(*) FILTER (vol > 0) AS n_pos FROM mi GROUP BY ALL)
    SELECT industry, n, {_r("mean std min p01 p25 median p75 p99 max sum", 4)}, n_pos, round(mean / std * sqrt(n), 4) + 0.0 AS t FROM g"""
)
def agg_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(H.describe(_monthly(spark, sf_dir), ["industry"], "vol"), 4)


@query(
    f"""WITH {_MI}, k AS (SELECT industry, vol AS x, close_hfq AS y, rank() OVER (PARTITION BY industry ORDER BY vol) + (count(*) OVER (PARTITION BY industry, vol) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY industry ORDER BY close_hfq) + (count(*) OVER (PARTITION BY industry, close_hfq) - 1) / 2.0 AS ry FROM mi)
    SELECT industry, count(*) AS n, round(corr(x, y), 6) + 0.0 AS pearson, round(corr(rx, ry), 6) + 0.0 AS spearman, round(regr_slope(y, x), 6) + 0.0 AS slope, round(regr_intercept(y, x), 6) + 0.0 AS intercept FROM k GROUP BY industry"""
)
def agg_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(H.correlations(_monthly(spark, sf_dir), ["industry"], "vol", "close_hfq"))


@query(
    f"""WITH {_M}, e AS (SELECT d, quantile_cont(vol, 0.25) AS a, quantile_cont(vol, 0.5) AS b, quantile_cont(vol, 0.75) AS c FROM m GROUP BY d)
    SELECT entity, d, vol, CAST((vol > a)::INT + (vol > b)::INT + (vol > c)::INT AS INTEGER) AS bucket, CASE WHEN vol > 0 AND vol <= 100 THEN 'low' WHEN vol > 100 AND vol <= 200 THEN 'mid' WHEN vol > 200 AND vol <= 1e9 THEN 'high' END AS tier FROM m JOIN e USING (d)"""
)
def agg_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.bars(spark, sf_dir, "month").select("entity", "d", "vol")
    return H.qcut(m, ["d"], "vol", 4).withColumn("tier", H.cut(F.col("vol"), [0, 100, 200, 1e9], ["low", "mid", "high"]))


@query(f"WITH {_M} SELECT CAST(least(floor(vol / 25), 39) AS BIGINT) AS bin, count(*) AS n FROM m WHERE vol BETWEEN 0 AND 1000 GROUP BY 1")
def agg_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.histogram(P.bars(spark, sf_dir, "month"), "vol", 0.0, 1000.0, 40)


@query(
    f"""WITH {_MI}, s AS (SELECT d, industry, round(sum(vol), 2) AS v FROM mi GROUP BY ALL)
    SELECT d, name AS factor, value FROM (SELECT d, max(v) FILTER (industry = 'ASIA') AS ASIA, max(v) FILTER (industry = 'EUROPE') AS EUROPE FROM s GROUP BY d) UNPIVOT (value FOR name IN (ASIA, EUROPE))"""
)
def agg_pivot_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _monthly(spark, sf_dir).groupBy("d", "industry").agg(F.round(F.sum("vol"), 2).alias("v"))
    return H.unpivot(H.pivot(s, "d", "industry", "v", ["ASIA", "EUROPE"]), ["d"], ["ASIA", "EUROPE"]).where("value is not null")


@query(
    """WITH e AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS rn FROM events), l AS (SELECT user_id, event_type, event_id FROM e WHERE rn = 1)
    SELECT user_id, event_type, event_id FROM l QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 5"""
)
def set_dedup_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    last = H.keep_one(e, ["user_id", "event_type"], [F.desc("ts"), F.col("event_id")])
    return H.top_k(last, 5, ["event_type"], [F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query(
    f"""WITH {_M}, half AS (SELECT entity, max(d) AS d, arg_max(vol, d) AS vol FROM m WHERE d < DATE '1997-01-01' GROUP BY entity), now AS (SELECT entity, arg_max(vol, d) AS vol FROM m GROUP BY entity)
    SELECT entity, half.vol AS before, now.vol AS after FROM half JOIN now USING (entity) WHERE half.vol IS DISTINCT FROM now.vol"""
)
def set_state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.bars(spark, sf_dir, "month")
    state, now = (H.latest(x, "entity", "d", ["vol"]) for x in (m.where("d < '1997-01-01'"), m))
    return H.changes(state, now, "entity", "vol")


@query(f"WITH {_M}, a AS (SELECT entity, d, vol, 0 AS side FROM m WHERE d < DATE '1997-01-01' UNION ALL SELECT entity, d, vol + 5, 1 FROM m WHERE d > DATE '1996-06-01') SELECT entity, d, vol FROM a QUALIFY row_number() OVER (PARTITION BY entity, d ORDER BY side, vol) = 1")
def set_append_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.bars(spark, sf_dir, "month").select("entity", "d", "vol")
    return H.append_distinct(m.where("d < '1997-01-01'"), m.where("d > '1996-06-01'").withColumn("vol", F.col("vol") + 5), ["entity", "d"], [F.col("vol")])


@query(f"WITH {_M}, f AS (SELECT entity, d, CAST((vol > 200)::INT AS INTEGER) AS flag FROM m WHERE d < DATE '1998-01-01'), s AS (SELECT entity, arg_max(flag, d) AS flag FROM f GROUP BY entity) SELECT * FROM f UNION ALL SELECT entity, d, flag FROM s CROSS JOIN (SELECT DISTINCT d FROM m WHERE d > (SELECT max(d) FROM f))")
def set_carry_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.bars(spark, sf_dir, "month")
    f = m.where("d < '1998-01-01'").select("entity", "d", (F.col("vol") > 200).cast("int").alias("flag"))
    return H.carry_flags(f, H.latest(f, "entity", "d", ["flag"]), m, "entity", "d", "flag")


@query(f"WITH {_M}, k AS (SELECT d, round(sum(vol), 2) AS v, row_number() OVER (ORDER BY d) - 1 AS rn FROM m GROUP BY d) SELECT d, v FROM k WHERE rn % 6 = 0")
def set_every_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.every_nth(P.bars(spark, sf_dir, "month").groupBy("d").agg(F.round(F.sum("vol"), 2).alias("v")), 6, "d")


# ---- evaluation ----------------------------------------------------------------------------------

_PXM = X.ffill(X.col("close_hfq"))
_SCORES = {"score": X.pct(_PXM, 6), "label": FX.label(1)}


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = X.apply(P.with_values(P.bars(spark, sf_dir, "month")), _SCORES)
    return m.where("score is not null and label is not null").select("entity", "d", "score", "label", "vol", "circ_mv")


_S = f"""{_M}, sc AS (SELECT * FROM (SELECT entity, d, vol, circ_mv, close_hfq / lag(close_hfq, 6) OVER w - 1 AS score, lead(close_hfq, 2) OVER w / lead(close_hfq, 1) OVER w - 1 AS label FROM m WINDOW w AS (PARTITION BY entity ORDER BY d)) WHERE score IS NOT NULL AND label IS NOT NULL)"""


def _rk(c: str, by: str = "d") -> str:
    return f"rank() OVER (PARTITION BY {by} ORDER BY round({c}, 9)) + (count(*) OVER (PARTITION BY {by}, round({c}, 9)) - 1) / 2.0"


_IC = f"rk AS (SELECT *, {_rk('score')} AS rs, {_rk('label')} AS rl FROM sc), ic AS (SELECT d, count(*) AS n, covar_pop(rs, rl) / CASE WHEN stddev_pop(rs) * stddev_pop(rl) > 1e-9 THEN stddev_pop(rs) * stddev_pop(rl) END AS ic FROM rk GROUP BY d HAVING count(*) >= 2)"


@query(f"WITH {_S}, {_IC} SELECT d, n, round(ic, 6) + 0.0 AS ic FROM ic")
def eval_rank_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(E.rank_ic(_scores(spark, sf_dir), ["d"], "score", "label"))


@query(f"WITH {_S}, {_IC} SELECT count(ic) AS n, round(avg(ic), 6) AS ic_mean, round(stddev_samp(ic), 6) AS ic_std, round(avg(ic) / stddev_samp(ic), 6) AS ic_ir, round(avg(CASE WHEN ic > 0 THEN 1.0 WHEN ic <= 0 THEN 0.0 END), 6) AS ic_pos FROM ic")
def eval_ic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(E.ic_summary(E.rank_ic(_scores(spark, sf_dir), ["d"], "score", "label")))


@query(
    f"""WITH {_S}, l AS (SELECT d, label, 'score' AS factor, score AS value FROM sc UNION ALL SELECT d, label, 'vol', vol FROM sc UNION ALL SELECT d, label, 'circ_mv', circ_mv FROM sc),
    k AS (SELECT d, factor, {_rk("value", "d, factor")} AS rs, {_rk("label", "d, factor")} AS rl FROM l), i AS (SELECT d, factor, covar_pop(rs, rl) / CASE WHEN stddev_pop(rs) * stddev_pop(rl) > 1e-9 THEN stddev_pop(rs) * stddev_pop(rl) END AS ic FROM k GROUP BY ALL HAVING count(*) >= 2)
    SELECT factor, count(ic) AS n, round(avg(ic), 6) AS ic_mean, round(stddev_samp(ic), 6) AS ic_std, round(avg(ic) / stddev_samp(ic), 6) AS ic_ir, round(avg(CASE WHEN ic > 0 THEN 1.0 WHEN ic <= 0 THEN 0.0 END), 6) AS ic_pos FROM i GROUP BY factor"""
)
def eval_factor_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlations by factor: mean, deviation, ratio, share above 0."""
    long = _scores(spark, sf_dir).select("d", "label", "score", "vol", "circ_mv").unpivot(["d", "label"], ["score", "vol", "circ_mv"], "factor", "value")
    return _round(E.ic_summary(E.rank_ic(long, ["d", "factor"], "value", "label"), ["factor"]))


@query(
    f"""WITH {_S}, p AS (SELECT *, ({_rk("score")}) / count(*) OVER (PARTITION BY d) AS p FROM sc), b AS (SELECT *, CASE WHEN p <= 0.2 THEN 1 WHEN p <= 0.4 THEN 2 WHEN p <= 0.6 THEN 3 WHEN p <= 0.8 THEN 4 ELSE 5 END AS b FROM p)
    SELECT d, {", ".join(f"round(avg(label) FILTER (b = {i}), 6) + 0.0 AS q{i}" for i in range(1, 6))}, round(avg(label) FILTER (b = 5) - avg(label) FILTER (b = 1), 6) + 0.0 AS long_short FROM b GROUP BY d"""
)
def eval_quintiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(E.quintiles(_scores(spark, sf_dir), "d", "score", "label"))


@query(
    f"""WITH {_S}, p AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, entity) AS p FROM sc)
    SELECT d, round(avg(label), 6) + 0.0 AS market, round(avg(label) FILTER (p <= 3), 6) + 0.0 AS top3, round(avg(label) FILTER (p <= 10), 6) + 0.0 AS top10, round(avg(label) FILTER (p <= 3) - avg(label), 6) + 0.0 AS top3_excess, round(avg(label) FILTER (p <= 10) - avg(label), 6) + 0.0 AS top10_excess FROM p GROUP BY d"""
)
def eval_top_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(E.top_returns(_scores(spark, sf_dir), "d", "score", "label", "entity", (3, 10)))


@query(
    f"""WITH {_S}, g AS (SELECT d, entity, round(score, 9) AS s, row_number() OVER (PARTITION BY d ORDER BY label, entity) AS g FROM sc),
    h AS (SELECT d, g, row_number() OVER (PARTITION BY d ORDER BY s DESC, entity) AS place, row_number() OVER (PARTITION BY d ORDER BY g DESC) AS best, avg(g) OVER (PARTITION BY d, s) AS mean FROM g)
    SELECT d, round(sum(mean / log2(place + 1.0)) FILTER (place <= 10) / sum(g / log2(best + 1.0)) FILTER (best <= 10), 6) AS ndcg FROM h GROUP BY d"""
)
def eval_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(E.ndcg(_scores(spark, sf_dir), "d", "score", "label", "entity"))


@query(
    f"""WITH {_S}, t AS (SELECT d, avg(label) FILTER (p <= 3) - avg(label) AS x FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, entity) AS p FROM sc) GROUP BY d), k AS (SELECT *, row_number() OVER (ORDER BY d) - 1 AS rn FROM t WHERE x IS NOT NULL)
    SELECT count(*) AS n, round(product(1 + x) - 1, 6) AS cumulative, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(avg(x) / stddev_samp(x) * sqrt(252 / 5.0), 6) AS sharpe FROM k WHERE rn % 5 = 0"""
)
def eval_non_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = E.top_returns(_scores(spark, sf_dir), "d", "score", "label", "entity", (3,))
    return _round(E.non_overlapping(t, "d", "top3_excess", 5))


@query(f"WITH {_S}, p AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, entity) AS p FROM sc) SELECT d, round((max(score) FILTER (p = 5) - avg(score)) / CASE WHEN stddev_samp(score) > 1e-9 THEN stddev_samp(score) END, 6) + 0.0 AS alias FROM p GROUP BY d")
def eval_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(E.dispersion(_scores(spark, sf_dir), "d", "score", "entity", 5))


@query(
    f"""WITH {_S}, {_IC}, imp AS (SELECT d, f AS factor, CASE WHEN (month(d) * f) % 3 = 0 THEN 0 ELSE f END AS importance FROM ic CROSS JOIN range(1, 6) r(f)),
    a AS (SELECT factor, count(*) FILTER (importance > 0) AS active, count(*) FILTER (importance <= 0) AS inactive, avg(ic) FILTER (importance > 0) - avg(ic) FILTER (importance <= 0) AS i, avg(n) FILTER (importance > 0) - avg(n) FILTER (importance <= 0) AS t FROM imp JOIN ic USING (d) GROUP BY factor)
    SELECT factor, active, inactive, round(i, 6) + 0.0 AS ic_diff, round(t, 6) + 0.0 AS n_diff, inactive >= 10 AS reliable,
      CASE WHEN inactive < 10 THEN 'unreliable' WHEN i > 0.01 THEN 'positive' WHEN i < -0.01 AND t < 0 THEN 'harmful' WHEN i < -0.01 THEN 'trade_off' ELSE 'neutral' END AS kind FROM a"""
)
def eval_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ic = E.rank_ic(_scores(spark, sf_dir), ["d"], "score", "label")
    imp = ic.select("d", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))).alias("factor"))
    imp = imp.withColumn("importance", F.when((F.month("d") * F.col("factor")) % 3 == 0, 0).otherwise(F.col("factor")))
    return _round(E.classify(E.activity(imp, ic, "d", "factor", "importance", ["ic", "n"]), "ic_diff", "n_diff"))


# ---- exposure ----------------------------------------------------------------------------------------

_IDX = f"""{_W}, {_DIM}, ir AS (SELECT w.*, industry, close_hfq / lag(close_hfq) OVER (PARTITION BY entity ORDER BY d) - 1 AS ret FROM w JOIN dim USING (entity)),
  idx AS (SELECT d, avg(ret) FILTER (entity % 2 = 0) / 100 AS ra, avg(ret) FILTER (entity % 2 = 1) / 100 AS rb, avg(close_hfq) AS close FROM ir GROUP BY d)"""


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _returns(P.bars(spark, sf_dir))
    return r.groupBy("d").agg((F.avg(F.when(F.col("entity") % 2 == 0, F.col("ret"))) / 100).alias("ra"), (F.avg(F.when(F.col("entity") % 2 == 1, F.col("ret"))) / 100).alias("rb"), F.avg("close_hfq").alias("close"))


def _win(n: int) -> str:
    return f"(ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _corr_sql(n: int) -> str:
    return f"CASE WHEN count(ra) OVER {_win(n)} >= {n} AND stddev_pop(ra) OVER {_win(n)} > 1e-9 AND stddev_pop(rb) OVER {_win(n)} > 1e-9 THEN covar_pop(ra, rb) OVER {_win(n)} / (stddev_pop(ra) OVER {_win(n)} * stddev_pop(rb) OVER {_win(n)}) END"


@query(f"WITH {_IDX}, a AS (SELECT *, CASE WHEN count(close) OVER {_win(60)} >= 60 THEN avg(close) OVER {_win(60)} END AS ma FROM idx) SELECT d, CASE WHEN lag(close) OVER (ORDER BY d) > lag(ma) OVER (ORDER BY d) THEN 1.0 ELSE 0.0 END AS ratio FROM a")
def exposure_ma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.ma_regime(_index(spark, sf_dir), "d", "close")


_TWO = "two AS (SELECT * FROM idx WHERE ra IS NOT NULL AND rb IS NOT NULL)"


@query(
    f"""WITH {_IDX}, {_TWO}, c AS (SELECT d, ra, rb, {_corr_sql(10)} AS corr, product(1 + ra) OVER {_win(100000)} AS nav_a, product(1 + rb) OVER {_win(100000)} AS nav_b, sum(ra - rb) OVER {_win(100000)} AS spread,
      CASE WHEN count(ra) OVER {_win(5)} >= 5 THEN sum(ra) OVER {_win(5)} END AS sum_a, CASE WHEN count(rb) OVER {_win(5)} >= 5 THEN sum(rb) OVER {_win(5)} END AS sum_b FROM two)
    SELECT d, {_r("corr spread sum_a sum_b")}, {_r("nav_a nav_b", 2)}, CASE WHEN corr > 0.6 THEN 'converged' WHEN corr < -0.2 THEN 'diverged' WHEN corr IS NOT NULL THEN 'neutral' END AS regime FROM c"""
)
def exposure_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(G.style(_index(spark, sf_dir), "d", "ra", "rb").select("d", "corr", "nav_a", "nav_b", "spread", "sum_a", "sum_b", "regime"), 6, nav_a=2, nav_b=2)


_CONV = f"conv AS (SELECT d, CASE WHEN {_corr_sql(5)} > 0.2 AND count(ra) OVER {_win(5)} >= 5 AND sum(ra) OVER {_win(5)} < 0 AND sum(rb) OVER {_win(5)} < 0 THEN 0.0 ELSE 1.0 END AS ratio FROM two)"


@query(f"WITH {_IDX}, {_TWO}, {_CONV} SELECT d, ratio FROM conv")
def exposure_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.style_convergence(_index(spark, sf_dir), "d", "ra", "rb", bound=0.2)


_BLIND = f"""b0 AS (SELECT *, {_corr_sql(7)} AS c, CASE WHEN count(rb) OVER {_win(7)} >= 7 THEN stddev_samp(rb) OVER {_win(7)} END AS v FROM two),
  b1 AS (SELECT *, CASE WHEN count(close) OVER {_win(20)} >= 20 THEN avg(close) OVER {_win(20)} END AS ma FROM b0 WHERE c IS NOT NULL AND v IS NOT NULL),
  b2 AS (SELECT *, CASE WHEN count(c) OVER {_win(80)} >= 40 THEN quantile_cont(c, 0.2) OVER {_win(80)} END AS qc, CASE WHEN count(v) OVER {_win(80)} >= 40 THEN quantile_cont(v, 0.33) OVER {_win(80)} END AS qv,
    coalesce(lag(close) OVER (ORDER BY d) > lag(ma) OVER (ORDER BY d), false) AS calm FROM b1),
  b3 AS (SELECT d, CASE WHEN coalesce(c < qc, false) OR (coalesce(v < qv, false) AND NOT calm) THEN 0.0 ELSE 1.0 END AS r FROM b2),
  blind AS (SELECT b0.d, CAST(coalesce(x.r, 1.0) AS DOUBLE) AS ratio FROM b0 LEFT JOIN (SELECT d, lag(r) OVER (ORDER BY d) AS r FROM b3) x ON b0.d = x.d)"""


@query(f"WITH {_IDX}, {_TWO}, {_BLIND} SELECT d, ratio FROM blind")
def exposure_blind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.blind_window(_index(spark, sf_dir), "d", "ra", "rb", "close")


@query(
    f"""WITH {_IDX}, v AS (SELECT d, CASE WHEN count(ra) OVER {_win(6)} >= 6 THEN stddev_samp(ra) OVER {_win(6)} END AS v FROM idx), q AS (SELECT *, CASE WHEN count(v) OVER {_win(80)} >= 40 THEN quantile_cont(v, 0.33) OVER {_win(80)} END AS lo, CASE WHEN count(v) OVER {_win(80)} >= 40 THEN quantile_cont(v, 0.67) OVER {_win(80)} END AS hi FROM v)
    SELECT d, CAST(coalesce(lag(CASE WHEN v < lo THEN 0.0 WHEN v < hi THEN 0.5 ELSE 1.0 END) OVER (ORDER BY d), 1.0) AS DOUBLE) AS ratio FROM q"""
)
def exposure_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.volatility_regime(_index(spark, sf_dir), "d", "ra")


@query(f"WITH {_IDX}, {_TWO}, {_CONV}, {_BLIND} SELECT d, CAST(CASE WHEN b.ratio < 1 AND c.ratio < 1 THEN 0 WHEN b.ratio < 1 THEN 0.3 WHEN c.ratio < 1 THEN 0.5 ELSE 1 END AS DOUBLE) AS ratio FROM blind b JOIN conv c USING (d)")
def exposure_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _index(spark, sf_dir)
    return G.hybrid(G.blind_window(i, "d", "ra", "rb", "close"), G.style_convergence(i, "d", "ra", "rb", bound=0.2), "d")


def _drift_part(f: str) -> str:
    t, b = "(ORDER BY d ROWS BETWEEN 39 PRECEDING AND 6 PRECEDING)", "(ORDER BY d ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"
    return f"abs(avg({f}) OVER {b} - avg({f}) OVER {t}) / CASE WHEN stddev_samp({f}) OVER {t} < 1e-8 THEN 1e-8 ELSE stddev_samp({f}) OVER {t} END"


@query(
    f"""WITH {_W}, a AS (SELECT d, avg(vol) AS vol, avg(turnover_rate_x) AS turnover_rate_x, avg(adj_factor) AS adj_factor FROM w GROUP BY d),
    p AS (SELECT d, {_drift_part("vol")} AS p1, {_drift_part("adj_factor")} AS p2 FROM a), r AS (SELECT d, (coalesce(p1, 0) + coalesce(p2, 0)) / nullif((p1 IS NOT NULL)::INT + (p2 IS NOT NULL)::INT, 0) AS drift FROM p),
    q AS (SELECT *, CASE WHEN count(drift) OVER {_win(40)} >= 10 THEN quantile_cont(drift, 0.75) OVER {_win(40)} END AS q FROM r)
    SELECT d, round(drift, 6) + 0.0 AS drift, CAST(coalesce(lag(CASE WHEN drift >= q THEN 0.0 ELSE 1.0 END) OVER (ORDER BY d), 1.0) AS DOUBLE) AS ratio FROM q"""
)
def exposure_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(G.factor_drift(G.factor_means(P.bars(spark, sf_dir), "d", ["vol", "adj_factor"]), "d", ["vol", "adj_factor"]))


@query(
    f"""WITH {_IDX}, g AS (SELECT d, ra, sum(CASE WHEN ra >= 0 THEN 1 ELSE 0 END) OVER (ORDER BY d) AS g FROM idx), n AS (SELECT d, sum(CASE WHEN ra < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY d) AS n FROM g)
    SELECT d, pow(0.5, n) AS ratio FROM n"""
)
def exposure_after_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.after_losses(_index(spark, sf_dir).select("d", "ra"), "d", "ra")


# ---- cohorts and performance ------------------------------------------------------------------------------


def _calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.bars(spark, sf_dir, "month").select("d").distinct()


_CAL = "cal AS (SELECT d, row_number() OVER (ORDER BY d) AS idx FROM (SELECT DISTINCT d FROM m)), reb AS (SELECT a.d AS signal, b.d AS entry, c.d AS exit FROM cal a JOIN cal b ON b.idx = a.idx + 1 LEFT JOIN cal c ON c.idx = a.idx + 4 WHERE (a.idx - 1) % 3 = 0)"


@query(f"WITH {_M}, {_CAL} SELECT * FROM reb")
def cohort_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rebalance_calendar(_calendar(spark, sf_dir), "d", 3)


_CHG = "pr AS (SELECT entity, d, close_hfq, 100 * (close_hfq / lag(close_hfq) OVER (PARTITION BY entity ORDER BY d) - 1) AS chg FROM m)"
_TRADES = f"""{_S}, {_CAL}, {_CHG}, pk AS (SELECT sc.entity, signal, entry, exit, score, row_number() OVER (PARTITION BY signal ORDER BY score DESC, sc.entity) AS place FROM sc JOIN reb ON sc.d = signal WHERE exit IS NOT NULL),
  bt AS (SELECT pk.*, close_hfq * 1.001 AS buy_price, floor(1e7 / 10 / (close_hfq * 1.001) / 100) * 100 AS shares FROM pk JOIN pr ON pr.entity = pk.entity AND pr.d = entry WHERE place <= 10 AND close_hfq > 0 AND coalesce(chg, 0) < 400),
  tr AS (SELECT bt.entity, signal, entry, exit, place, buy_price, shares, s.d AS sell_date, s.close_hfq * 0.999 AS sell_price FROM (SELECT * FROM bt WHERE shares > 0) bt ASOF LEFT JOIN (SELECT * FROM pr WHERE close_hfq > 0 AND coalesce(chg, 0) > -60) s ON bt.entity = s.entity AND bt.exit <= s.d)"""


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.bars(spark, sf_dir, "month")
    w = Window.partitionBy("entity").orderBy("d")
    prices = m.select("entity", "d", "close_hfq", (100 * (F.try_divide("close_hfq", F.lag("close_hfq").over(w)) - 1)).alias("chg"))
    cal = B.rebalance_calendar(_calendar(spark, sf_dir), "d", 3).where("exit is not null")
    s = _scores(spark, sf_dir).select("entity", F.col("d").alias("signal"), "score").join(F.broadcast(cal), "signal")
    picks = B.pick(s, "signal", "entity", "score", 10, 1e7)
    bought = B.entries(picks, prices, "entity", "entry", "d", "close_hfq", "chg", limit=400)
    return B.exits(bought, prices, "entity", "exit", "d", "close_hfq", "chg", limit=-60)


@query(f"WITH {_TRADES} SELECT entity, signal, entry, exit, CAST(place AS INTEGER) AS place, CAST(shares AS BIGINT) AS shares, sell_date, round(buy_price, 4) AS buy_price, round(sell_price, 4) AS sell_price, round(shares * sell_price * (1 - 0.0003 - 0.001), 2) AS proceeds FROM tr")
def cohort_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_trades(spark, sf_dir).select("entity", "signal", "entry", "exit", "place", "shares", "sell_date", "buy_price", "sell_price", "proceeds"), 4, proceeds=2)


_RET = "ret AS (SELECT *, sell_price / buy_price - 1 AS ret, entity * 1000000 + CAST(epoch(signal) / 86400 AS BIGINT) AS key FROM tr WHERE sell_price IS NOT NULL)"


@query(f"WITH {_TRADES}, {_RET} SELECT signal, count(*) AS n, round(avg(ret), 6) + 0.0 AS ret FROM ret GROUP BY signal")
def cohort_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(B.cohort_returns(_trades(spark, sf_dir), "signal"))


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _trades(spark, sf_dir).where("sell_price is not null")
    return t.select("entity", "signal", "entry", "score", (F.col("sell_price") / F.col("buy_price") - 1).alias("ret"), (F.col("entity") * 1000000 + F.unix_date("signal")).alias("key"))


@query(
    f"""WITH {_TRADES}, {_RET}, o AS (SELECT *, row_number() OVER (ORDER BY ret DESC, key) AS p FROM ret)
    SELECT dropped, count(*) AS n, round(avg(ret), 6) + 0.0 AS mean, round(stddev_samp(ret), 6) + 0.0 AS std, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END), 6) AS win, round(avg(ret) / stddev_samp(ret) * sqrt(count(*)), 6) + 0.0 AS t
    FROM o JOIN (SELECT CAST(unnest([0, 5, 10, 20, 30]) AS INTEGER) AS dropped) ON p > dropped GROUP BY dropped"""
)
def perf_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(B.robustness(_keyed(spark, sf_dir), "ret", "key"))


@query(f"WITH {_TRADES}, {_RET} SELECT CAST(year(entry) AS INTEGER) AS year, count(*) FILTER (ret > 0.1) AS n FROM ret GROUP BY 1")
def perf_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.tails(_keyed(spark, sf_dir), "entry", "ret")


@query(f"WITH {_TRADES}, {_RET}, x AS (SELECT ret.*, score FROM ret JOIN (SELECT entity, signal, score FROM pk) USING (entity, signal)), k AS (SELECT signal, {_rk('score', 'signal')} AS rs, {_rk('ret', 'signal')} AS rl FROM x) SELECT signal, count(*) AS n, round(covar_pop(rs, rl) / CASE WHEN stddev_pop(rs) * stddev_pop(rl) > 1e-9 THEN stddev_pop(rs) * stddev_pop(rl) END, 6) + 0.0 AS ic FROM k GROUP BY signal HAVING count(*) >= 4")
def perf_batch_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(E.rank_ic(_keyed(spark, sf_dir), ["signal"], "score", "ret", 4))


_NAV = f"{_IDX}, nav AS (SELECT d, product(1 + coalesce(ra, 0)) OVER {_win(100000)} AS nav FROM idx)"


def _nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).select("d", F.product(1 + F.coalesce("ra", F.lit(0.0))).over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)).alias("nav"))


@query(
    f"""WITH {_NAV}, r AS (SELECT d, nav, nav / lag(nav) OVER (ORDER BY d) - 1 AS r, max(nav) OVER {_win(100000)} AS peak FROM nav), x AS (SELECT *, nav / peak - 1 AS dd FROM r),
    a AS (SELECT arg_max(nav, d) / arg_min(nav, d) - 1 AS total, count(r) AS n, stddev_samp(r) AS s, avg(r) AS m, min(dd) AS mdd, avg(CASE WHEN r > 0 THEN 1.0 WHEN r <= 0 THEN 0.0 END) AS win FROM x)
    SELECT round(total, 6) AS total, round(pow(1 + total, 252.0 / n) - 1, 6) AS annual, round(s * sqrt(252), 6) AS volatility, round(m / s * sqrt(252), 6) AS sharpe, round(mdd, 6) AS max_drawdown, round(win, 6) AS win_rate, n FROM a"""
)
def perf_nav_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(B.nav_metrics(_nav(spark, sf_dir), "d", "nav").select("total", "annual", "volatility", "sharpe", "max_drawdown", "win_rate", "n"))


@query(f"WITH {_NAV} SELECT CAST(date_trunc('month', d) AS DATE) AS month, round(arg_max(nav, d) / arg_min(nav, d) - 1, 6) + 0.0 AS ret FROM nav GROUP BY 1")
def perf_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(B.monthly(_nav(spark, sf_dir), [], "d", "nav"))


@query(f"WITH {_NAV} SELECT round(arg_max(nav, d) FILTER (d <= DATE '1996-01-01') / arg_min(nav, d) FILTER (d <= DATE '1996-01-01') * (arg_max(nav, d) FILTER (d >= DATE '1997-01-01') / arg_min(nav, d) FILTER (d >= DATE '1997-01-01')) - 1, 6) AS ret FROM nav")
def perf_without_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(B.without_window(_nav(spark, sf_dir), "d", "nav", dt.date(1996, 1, 1), dt.date(1997, 1, 1)))


@query(
    f"""WITH {_IDX}, v AS (SELECT d, product(1 + coalesce(ra, 0)) OVER {_win(100000)} AS a, product(1 + coalesce(rb, 0)) OVER {_win(100000)} AS b FROM idx), k AS (SELECT *, row_number() OVER (ORDER BY d) - 1 AS rn FROM v)
    SELECT i.d AS d_i, j.d AS d_j, round(j.a / i.a - j.b / i.b, 4) + 0.0 AS excess FROM k i JOIN k j ON i.d < j.d WHERE i.rn % 20 = 0 AND j.rn % 20 = 0"""
)
def perf_excess_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    v = _index(spark, sf_dir).select("d", *[F.product(1 + F.coalesce(c, F.lit(0.0))).over(w).alias(n) for c, n in (("ra", "a"), ("rb", "b"))])
    return _round(B.excess_matrix(v, "d", "a", "b", 20), 4)


@query(
    f"""WITH {_IDX}, t AS (SELECT close AS x, ra AS r FROM idx WHERE close IS NOT NULL AND ra IS NOT NULL), h AS (SELECT CAST(unnest([3000.0, 4000.0, 5000.0]) AS DOUBLE) AS threshold)
    SELECT threshold, count(*) FILTER (x >= threshold) AS n_above, round(avg((r > 0)::INT) FILTER (x >= threshold), 6) AS win_above, round(avg(r) FILTER (x >= threshold), 6) + 0.0 AS mean_above, round(avg((r > 0)::INT) FILTER (x < threshold), 6) AS win_below, round(avg(r) FILTER (x < threshold), 6) + 0.0 AS mean_below FROM t CROSS JOIN h GROUP BY threshold"""
)
def perf_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(B.threshold_sweep(_index(spark, sf_dir), "close", "ra", [3000.0, 4000.0, 5000.0]))


@query(
    f"""WITH {_IDX}, {_TWO}, {_BLIND}, j AS (SELECT ra AS r, ratio FROM two JOIN blind USING (d)), c AS (SELECT count(*) FILTER (ratio < 1 AND r < 0) AS tp, count(*) FILTER (ratio >= 1 AND r < 0) AS fn, count(*) FILTER (ratio < 1 AND r >= 0) AS fp, count(*) FILTER (ratio >= 1 AND r >= 0) AS tn, avg(r) FILTER (ratio < 1 AND r < 0) AS avoided_mean, avg(r) FILTER (ratio < 1 AND r >= 0) AS missed_mean FROM j), p AS (SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM c)
    SELECT tp, fn, fp, tn, round(avoided_mean, 6) AS avoided_mean, round(missed_mean, 6) AS missed_mean, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / nullif(precision + recall, 0), 6) AS f1 FROM p"""
)
def perf_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _index(spark, sf_dir).where("ra is not null and rb is not null")
    return _round(B.confusion(i, G.blind_window(i, "d", "ra", "rb", "close"), "d", "ra"))


@query(
    f"""WITH {_S} SELECT d, {", ".join(f"count(*) FILTER (circ_mv / 1e4 >= {lo} AND circ_mv / 1e4 < {hi}) AS {n}" for lo, hi, n in ((0, 20, "micro"), (20, 50, "small"), (50, 100, "mid"), (100, 300, "large"), (300, 1000, "giant"), (1000, 1e300, "mega")))},
    {", ".join(f"round(quantile_cont(circ_mv / 1e4, {p}), 4) AS {n}" for p, n in ((0.1, "p10"), (0.25, "p25"), (0.75, "p75"), (0.9, "p90")))} FROM sc GROUP BY d"""
)
def perf_size_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(B.size_tiers(_scores(spark, sf_dir).withColumn("mv", F.col("circ_mv") / 1e4), "d", "mv"), 4)


@query(
    f"""WITH {_S}, r AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, entity) AS m, row_number() OVER (PARTITION BY d ORDER BY vol DESC, entity) AS n FROM sc)
    SELECT d, round(avg(label) FILTER (m <= 5), 6) + 0.0 AS model, round(avg(label) FILTER (n <= 5), 6) + 0.0 AS naive, round(avg(label), 6) + 0.0 AS universe FROM r GROUP BY d"""
)
def perf_model_vs_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(B.compare_picks(_scores(spark, sf_dir), "d", "entity", "score", "vol", "label"))


@query(f"WITH {_MI}, x AS (SELECT industry, d, sum(amount_x) AS v FROM mi GROUP BY ALL) SELECT industry, d, round(v / first_value(v) OVER (PARTITION BY industry ORDER BY d) * 100, 4) AS rebased FROM x")
def perf_rebased(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _monthly(spark, sf_dir).groupBy("industry", "d").agg(F.sum("amount_x").alias("v"))
    return _round(B.rebased(x, "industry", "d", "v").drop("v"), 4)


@query(f"WITH {_TRADES}, lastm AS (SELECT entity, d, amount_x FROM m) SELECT tr.entity, signal, round(shares * buy_price / amount_x, 6) AS participation FROM tr LEFT JOIN lastm ON lastm.entity = tr.entity AND lastm.d = entry")
def perf_participation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _trades(spark, sf_dir).withColumn("amount", F.col("shares") * F.col("buy_price"))
    m = P.bars(spark, sf_dir, "month").select("entity", F.col("d").alias("entry"), "amount_x")
    return _round(B.participation(t, m, ["entity", "entry"], "amount", "amount_x").select("entity", "signal", "participation"))


@query(
    f"""WITH {_TRADES}, b AS (SELECT entry, sum(shares * buy_price) AS bought FROM tr GROUP BY entry), s AS (SELECT sell_date, shares * sell_price * (1 - 0.0003 - 0.001) AS p FROM tr WHERE sell_date IS NOT NULL),
    k AS (SELECT (SELECT max(entry) FROM b WHERE b.entry < s.sell_date) AS entry, p FROM s), g AS (SELECT entry, sum(p) AS sold FROM k GROUP BY entry)
    SELECT entry, round(bought, 2) AS bought, round(sold, 2) AS sold, round(sold / bought - 1, 6) + 0.0 AS profit FROM b LEFT JOIN g USING (entry)"""
)
def cohort_batch_profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _trades(spark, sf_dir).withColumn("amount", F.col("shares") * F.col("buy_price"))
    return _round(B.batch_profit(t, t.where("sell_date is not null"), "entry", "sell_date", "amount", "proceeds"), 6, bought=2, sold=2)


@query(
    f"""WITH {_S}, i AS (SELECT d, row_number() OVER (ORDER BY d) AS i FROM (SELECT DISTINCT d FROM m)), pi AS (SELECT entity, i, close_hfq AS p FROM m JOIN i USING (d) WHERE close_hfq IS NOT NULL),
    pk AS (SELECT entity, i FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, entity) AS place FROM sc WHERE score IS NOT NULL) JOIN i USING (d) WHERE place <= 5),
    vr AS (SELECT pk.i, avg(s.p / b.p - 1) AS ret FROM pk JOIN pi b ON b.entity = pk.entity AND b.i = pk.i + 1 JOIN pi s ON s.entity = pk.entity AND s.i = pk.i + 4 WHERE b.p > 0 GROUP BY pk.i),
    lost AS (SELECT s.i, k, row_number() OVER (PARTITION BY s.i ORDER BY k) AS nth FROM i s CROSS JOIN range(1, 4) r(k) JOIN vr ON vr.i = s.i - 4 + k WHERE ret < -0.02 AND (s.i - 1) % 3 = 0)
    SELECT a.d, b.d AS stop_day FROM i a LEFT JOIN (SELECT lost.i, lost.i + k AS at FROM lost WHERE nth = 2 AND k - 1 < 3) x ON x.i = a.i LEFT JOIN i b ON b.i = x.at WHERE (a.i - 1) % 3 = 0"""
)
def cohort_virtual_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, s, cal = P.bars(spark, sf_dir, "month"), _scores(spark, sf_dir), _calendar(spark, sf_dir)
    virtual = B.virtual_returns(B.pick(s, "d", "entity", "score", 5), m, cal, "d", "entity", "close_hfq", 4)
    signals = B.rebalance_calendar(cal, "d", 3).select(F.col("signal").alias("d"))
    return B.virtual_stop(signals, virtual, cal, "d", 4, 3, 3, -0.02)


@query(f"WITH {_M}, b AS (SELECT entity, d, close_hfq FROM m WHERE month(d) IN (1, 4)), s AS (SELECT entity, d AS sell_date, close_hfq AS sell_price FROM m WHERE month(d) IN (4, 10)) SELECT b.entity, b.d, b.close_hfq, sell_date, sell_price, round(sell_price / b.close_hfq - 1, 6) + 0.0 AS ret, CAST(sell_date - b.d AS INTEGER) AS days FROM b ASOF JOIN s ON b.entity = s.entity AND b.d <= s.sell_date")
def cohort_pair_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.bars(spark, sf_dir, "month").select("entity", "d", "close_hfq")
    out = B.pair_trades(m.where(F.month("d").isin(1, 4)), m.where(F.month("d").isin(4, 10)), "entity", "d", "close_hfq")
    return _round(out, 6, close_hfq=None, sell_price=None)


@query(f"WITH {_W} SELECT DISTINCT entity FROM w WHERE d = (SELECT min(d) FROM w) AND entity NOT IN (SELECT entity FROM w WHERE d = (SELECT max(d) FROM w))")
def perf_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = P.bars(spark, sf_dir)
    lo, hi = w.agg(F.min("d"), F.max("d")).first()
    return B.survivors(w, "entity", "d", lo, hi)


@query()
def perf_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bootstrap(_keyed(spark, sf_dir).select("ret", "key"), "ret", "key")


@query(f"WITH {_S} SELECT entity, CAST(d AS DATE) AS signal_date, round(score, 6) AS score FROM sc WHERE d = (SELECT max(d) FROM sc) ORDER BY score DESC, entity LIMIT 10")
def signal_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scores(spark, sf_dir)
    full = s.select("d").distinct().withColumn("ratio", F.lit(1.0))
    out = B.snapshot(s, _calendar(spark, sf_dir), full, "d", "entity", "score")
    return _round(out.select("entity", "signal_date", "score"))


@query(
    f"""WITH {_IND}, mk AS (SELECT d, avg(ret) AS r FROM rr GROUP BY d), mz AS (SELECT d, sum(r) OVER (ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS v FROM mk)
    SELECT rr.entity, rr.d, round(f.ind_ret_5d, 6) + 0.0 AS ind_ret_5d, round(f.ind_up_5d, 6) + 0.0 AS ind_up_5d, round(CASE WHEN count(v) OVER w >= 0 THEN v END, 6) + 0.0 AS mkt FROM rr JOIN f USING (d, industry) JOIN mz USING (d) WINDOW w AS (ORDER BY rr.d)"""
)
def market_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _returns(_monthly(spark, sf_dir))
    ind = XS.industry_features(r, "d", "industry", "ret", "flow", "circ_mv", "turnover_rate_x")
    mkt = r.groupBy("d").agg(F.avg("ret").alias("r")).select("d", F.sum("r").over(Window.orderBy("d").rowsBetween(-4, 0)).alias("mkt"))
    return _round(XS.attach(r, ind, mkt, "d", "industry").select("entity", "d", "ind_ret_5d", "ind_up_5d", "mkt"))


_AL = f"{_S}, p AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, entity) AS p FROM sc), al AS (SELECT d, (max(score) FILTER (p = 5) - avg(score)) / CASE WHEN stddev_samp(score) > 1e-9 THEN stddev_samp(score) END AS alias, avg(label) FILTER (p <= 5) / 100 AS profit FROM p GROUP BY d)"


def _alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scores(spark, sf_dir)
    profit = E.top_returns(s, "d", "score", "label", "entity", (5,)).select("d", (F.col("top5") / 100).alias("profit"))
    return E.dispersion(s, "d", "score", "entity", 5).join(profit, "d")


@query(
    f"""WITH {_AL}, e AS (SELECT quantile_cont(alias, 0.25) AS a, quantile_cont(alias, 0.5) AS b, quantile_cont(alias, 0.75) AS c FROM al), x AS (SELECT d, alias, profit, CAST(1 + (alias > a)::INT + (alias > b)::INT + (alias > c)::INT AS INTEGER) AS quartile,
      CASE WHEN alias IS NOT NULL THEN profit END AS pp, CASE WHEN profit IS NOT NULL THEN alias END AS aa FROM al CROSS JOIN e)
    SELECT d, round(alias, 6) + 0.0 AS alias, round(profit, 6) + 0.0 AS profit, quartile, round(CASE WHEN count(aa) OVER w >= 3 AND stddev_pop(aa) OVER w > 1e-9 AND stddev_pop(pp) OVER w > 1e-9 THEN covar_pop(aa, pp) OVER w / (stddev_pop(aa) OVER w * stddev_pop(pp) OVER w) END, 6) + 0.0 AS corr,
      round(product(1 + coalesce(profit, 0)) OVER (ORDER BY d) - 1, 6) + 0.0 AS cumulative FROM x WINDOW w AS (ORDER BY d ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"""
)
def perf_dispersion_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(B.dispersion_table(_alias(spark, sf_dir), "d", "alias", "profit"))


@query(
    f"""WITH {_AL}, y AS (SELECT *, CAST(year(d) AS INTEGER) AS year FROM al WHERE alias IS NOT NULL AND profit IS NOT NULL), k AS (SELECT *, rank() OVER (PARTITION BY year ORDER BY alias) + (count(*) OVER (PARTITION BY year, alias) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY year ORDER BY profit) + (count(*) OVER (PARTITION BY year, profit) - 1) / 2.0 AS ry FROM y)
    SELECT year, round(avg(profit), 6) + 0.0 AS mean_profit, round(avg(CASE WHEN profit > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, count(*) AS n, round(corr(alias, profit), 6) + 0.0 AS pearson, round(corr(rx, ry), 6) + 0.0 AS spearman, round(regr_slope(profit, alias), 6) + 0.0 AS slope, round(regr_intercept(profit, alias), 6) + 0.0 AS intercept FROM k GROUP BY year"""
)
def perf_dispersion_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _alias(spark, sf_dir).where("alias is not null and profit is not null").withColumn("year", F.year("d"))
    return _round(B.bin_summary(a, ["year"], "alias", "profit"))


@query(f"WITH {_S}, p AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, entity) AS p FROM sc) SELECT d, {_r('max mean min std spread')} FROM (SELECT d, max(score) AS max, avg(score) AS mean, min(score) AS min, stddev_samp(score) AS std, max(score) - min(score) AS spread FROM p WHERE p <= 10 GROUP BY d)")
def perf_pick_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    picks = B.pick(_scores(spark, sf_dir), "d", "entity", "score", 10)
    return _round(B.pick_aggregates(picks, "d", "score"))


@query(f"WITH {_IDX}, {_TWO}, c AS (SELECT {_corr_sql(10)} AS corr FROM two), g AS (SELECT CASE WHEN corr > 0.6 THEN 'converged' WHEN corr < -0.2 THEN 'diverged' WHEN corr IS NOT NULL THEN 'neutral' END AS regime, count(*) AS n FROM c GROUP BY 1) SELECT regime, n, round(n / sum(n) OVER (), 6) AS share FROM g")
def perf_regime_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(B.regime_shares(G.style(_index(spark, sf_dir), "d", "ra", "rb"), "regime"))


@query(f"SELECT d, n, ic, q1, q2, q3, q4, q5, long_short, market, top3, top10, top3_excess, top10_excess, ndcg FROM ({ORACLE_SQL['eval_rank_ic']}) JOIN ({ORACLE_SQL['eval_quintiles']}) USING (d) JOIN ({ORACLE_SQL['eval_top_returns']}) USING (d) LEFT JOIN ({ORACLE_SQL['eval_ndcg']}) USING (d)")
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily table of all metrics, for any model's scores."""
    return _round(E.report(_scores(spark, sf_dir), "d", "entity", "score", "label", (3, 10)))


@query(f"WITH {_S}, t AS (SELECT *, max(score) OVER (PARTITION BY d) AS top, row_number() OVER (PARTITION BY d ORDER BY score DESC, entity) AS place FROM sc) SELECT d, entity, CAST(place AS INTEGER) AS place, 250000.0 AS notional FROM t WHERE top >= 0.5 AND place <= 4")
def cohort_score_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No cohort on dates whose best score is below the gate."""
    return B.pick(_scores(spark, sf_dir), "d", "entity", "score", 4, 1e6, 0.5).select("d", "entity", "place", "notional")


@query(f"WITH {_TRADES} SELECT tr.entity, signal, cal.d, shares * coalesce(m.close_hfq, buy_price) AS value FROM tr JOIN cal ON cal.d BETWEEN entry AND exit LEFT JOIN m ON m.entity = tr.entity AND m.d = cal.d")
def cohort_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every position on every date it is held, at the close or else at its buy price."""
    held = _trades(spark, sf_dir).select("entity", "signal", "entry", "exit", "shares", "buy_price")
    out = B.marks(held, P.bars(spark, sf_dir, "month"), _calendar(spark, sf_dir), "entity", "entry", "exit", "d", "close_hfq")
    return out.select("entity", "signal", "d", "value")


@query(f"WITH {_TRADES} SELECT entity, signal, CAST(CASE WHEN buy_price > sell_price THEN 0.25 ELSE 1 END AS DOUBLE) AS keep_ratio, CAST(shares - floor(shares * CASE WHEN buy_price > sell_price THEN 0.25 ELSE 1 END) AS BIGINT) AS sold FROM tr WHERE sell_price IS NOT NULL")
def cohort_sell_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule of one's own: losers are cut to a quarter."""
    t = _trades(spark, sf_dir).where("sell_price is not null").withColumn("price", F.col("sell_price"))
    return B.sell_down(t, F.when(F.col("buy_price") > F.col("price"), 0.25)).select("entity", "signal", "keep_ratio", F.col("sold").cast("long").alias("sold"))


@query(f"WITH {_NAV}, r AS (SELECT d, nav, nav / lag(nav) OVER (ORDER BY d) - 1 AS r FROM nav), a AS (SELECT min(d) - 1 AS first FROM r WHERE abs(r) > 1e-9), t AS (SELECT r.* FROM r, a WHERE d >= first) SELECT round(arg_max(nav, d) / arg_min(nav, d) - 1, 6) AS total, count(r) AS n, round(stddev_samp(r) * sqrt(252), 6) AS volatility FROM t")
def perf_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the idle rows before the first move."""
    return _round(B.nav_metrics(_nav(spark, sf_dir), "d", "nav", trim=True).select("total", "n", "volatility"))


@query(f"WITH {_NAV} SELECT round(ln(arg_max(nav, d) FILTER (d BETWEEN DATE '1996-01-01' AND DATE '1996-12-31') / arg_min(nav, d) FILTER (d BETWEEN DATE '1996-01-01' AND DATE '1996-12-31')) / ln(arg_max(nav, d) / arg_min(nav, d)), 6) AS share, round(arg_max(nav, d) / arg_min(nav, d) - 1, 4) AS ret FROM nav")
def perf_log_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of one year in the whole log return, and the whole return."""
    nav = _nav(spark, sf_dir)
    return _round(B.log_share(nav, "d", "nav", dt.date(1996, 1, 1), dt.date(1996, 12, 31)).crossJoin(B.total_return(nav, "d", "nav")), 6, ret=4)  # one row each


@query(f"WITH {_MI}, i AS (SELECT d, industry, avg(vol) AS ind_vol FROM mi GROUP BY ALL), k AS (SELECT d, avg(vol) AS mkt_vol FROM mi GROUP BY d), a AS (SELECT mi.entity, mi.d, CASE WHEN mi.entity % 7 <> 0 THEN ind_vol END AS ind_vol, mkt_vol FROM mi JOIN i USING (d, industry) JOIN k USING (d)) SELECT entity, d, round(CASE WHEN stddev_samp(ind_vol) OVER w > 1e-9 THEN coalesce((ind_vol - avg(ind_vol) OVER w) / stddev_samp(ind_vol) OVER w, 0) ELSE ind_vol END, 6) + 0.0 AS ind_vol, round(mkt_vol, 6) AS mkt_vol FROM a WINDOW w AS (PARTITION BY d)")
def market_zscored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attached industry and market features by date; the market's are constant and stay."""
    mi = _monthly(spark, sf_dir)
    ind, mkt = mi.groupBy("d", "industry").agg(F.avg("vol").alias("ind_vol")), mi.groupBy("d").agg(F.avg("vol").alias("mkt_vol"))
    a = XS.attach(mi.select("entity", "d", "industry"), ind, mkt, "d", "industry").withColumn("ind_vol", F.when(F.col("entity") % 7 != 0, F.col("ind_vol")))
    return _round(XS.zscore_attached(a, "d", ["ind_vol", "mkt_vol"]).select("entity", "d", "ind_vol", "mkt_vol"))
