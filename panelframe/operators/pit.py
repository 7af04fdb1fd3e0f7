"""Point-in-time statements: versions, single quarters, year-ago lookups, as-of values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelframe.functions.kernels import div
from panelframe.operators.joins import asof
from panelframe.operators.relational import keep_one


def best_version(df: DataFrame, keys: Sequence[str], announced: str, measures: Sequence[str]) -> DataFrame:
    """The latest announcement of each key, then the one with most values; rows with a null key go; ties by the values."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in measures), F.lit(0))
    return keep_one(df.dropna(subset=list(keys)), keys, [F.col(announced).desc_nulls_last(), filled.desc(), *[F.col(c).desc_nulls_last() for c in measures]])


def single_quarters(df: DataFrame, entity: str, end: str, measures: Sequence[str]) -> DataFrame:
    """Year-to-date values minus the row before within the year; first quarters and gaps in the year's start stay."""
    w = Window.partitionBy(entity).orderBy(end)
    inside = (F.quarter(end) > 1) & (F.year(end) == F.year(F.lag(end).over(w)))
    return df.withColumns({c: F.when(inside, F.col(c) - F.lag(c).over(w)).otherwise(F.col(c)) for c in measures})


def join_statements(balance: DataFrame, income: DataFrame, cash: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Balance sheets with the income and cash-flow rows of the same keys; other shared names get _x and _y."""
    out = balance
    for other in (income, cash):
        both = (set(out.columns) & set(other.columns)) - set(keys)
        out = out.withColumnsRenamed({c: f"{c}_x" for c in both}).join(other.withColumnsRenamed({c: f"{c}_y" for c in both}), list(keys), "left")
    return out


def latest_restatement(df: DataFrame, entity: str, end: str, announced: str) -> DataFrame:
    """One row a period, the one announced last; of several of that day the one with the largest values, column by column."""
    rest = [c for c in df.columns if c not in (entity, end, announced)]
    return keep_one(df, [entity, end], [F.col(announced).desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in rest]])


def validity(df: DataFrame, entity: str, end: str, announced: str, since: str = "valid_from", until: str = "valid_to") -> DataFrame:
    """All versions of a period, each with the days from which on and before which it is the last one (null: still). One version an announcement day; unannounced ones go."""
    one = best_version(df.where(F.col(announced).isNotNull()), [entity, end, announced], announced, [c for c in df.columns if c not in (entity, end, announced)])
    return one.withColumns({since: F.col(announced), until: F.lead(announced).over(Window.partitionBy(entity, end).orderBy(announced))})


def known_versions(panel: DataFrame, df: DataFrame, entity: str, day: str, end: str, announced: str, values: Sequence[str]) -> DataFrame:
    """P04 with P14, bitemporal: each row of the panel with the latest period announced by its day and its values as they stood that day (before it is restated, the old ones)."""
    one = best_version(df.where(F.col(announced).isNotNull()), [entity, end, announced], announced, list(values))
    # at each announcement the latest period so far, in its latest version so far
    state = F.max(F.struct(F.col(end).alias("end"), F.col(announced).alias("at"), F.struct(*values).alias("v"))).over(Window.partitionBy(entity).orderBy(announced).rangeBetween(Window.unboundedPreceding, 0))
    known = keep_one(one.withColumn("\u0001s", state).select(entity, announced, F.col("\u0001s.end").alias(end), F.col("\u0001s.at").alias("\u0001since"), *[F.col(f"\u0001s.v.{v}").alias(v) for v in values]), [entity, announced], [F.col(end).desc_nulls_last()])
    return asof(panel, known.withColumnRenamed("\u0001since", "version_of"), entity, day, announced, [end, "version_of", *values])


def year_ago(df: DataFrame, entity: str, end: str, measures: Sequence[str]) -> DataFrame:
    """Adds <measure>_ya, the value of the period that ended a year before."""
    back = df.select(entity, F.col(end).alias("\u0001end"), *[F.col(c).alias(f"{c}_ya") for c in measures])
    same = F.add_months(F.col(end), -12)
    last_day = F.when(F.last_day(end) == F.col(end), F.last_day(same)).otherwise(same)
    return df.withColumn("\u0001end", last_day).join(back, [entity, "\u0001end"], "left").drop("\u0001end")


def growth(now: Column, before: Column) -> Column:
    """Relative to the size of the base; 0 where it is 0 or missing."""
    return F.coalesce(div(now - before, F.abs(before)), F.lit(0.0))


def statement_factors(df: DataFrame, entity: str, end: str) -> DataFrame:
    """P06-P13 on quarterly rows; what a column that df lacks enters is 0.

    Return on equity: parent's net profit of four rows over their mean equity. Accruals: change of net operating assets,
    (assets - cash) - (liabilities - short borrowings), over mean assets; 0 where a part is missing.
    """
    have, w = set(df.columns), Window.partitionBy(entity).orderBy(end)
    four = w.rowsBetween(-3, 0)
    c = lambda n: F.col(n) if n in have else F.lit(None).cast("double")
    out = year_ago(df, entity, end, [x for x in ("total_revenue", "n_income", "total_assets") if x in have])
    noa = (c("total_assets") - c("money_cap")) - (c("total_liab") - c("st_borr"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return out.withColumns(
        {
            "gross_margin": zero(div(c("total_revenue") - c("oper_cost"), c("total_revenue"))),
            "debt_ratio": zero(div(c("total_liab"), c("total_assets"))),
            "roe_ttm": zero(div(F.sum(c("n_income_attr_p")).over(four), F.avg(c("total_hldr_eqy_exc_min_int")).over(four))),
            "revenue_growth_yoy": growth(c("total_revenue"), F.col("total_revenue_ya")),
            "profit_growth_yoy": growth(c("n_income"), F.col("n_income_ya")),
            "asset_growth_yoy": growth(c("total_assets"), F.col("total_assets_ya")),
            "accruals": zero(div(noa - F.lag(noa).over(w), (c("total_assets") + F.lag(c("total_assets")).over(w)) / 2)),
        }
    )


def by_disclosure(df: DataFrame, entity: str, announced: str, end: str) -> DataFrame:
    """One row a disclosure date, the latest period."""
    return keep_one(df, [entity, announced], [F.col(end).desc_nulls_last()])


def known_at(panel: DataFrame, filings: DataFrame, entity: str, day: str, announced: str, values: Sequence[str]) -> DataFrame:
    """What was disclosed by the day, 0 where nothing was."""
    out = asof(panel, filings, entity, day, announced, values)
    return out.withColumns({v: F.coalesce(F.col(v), F.lit(0.0)) for v in values})
