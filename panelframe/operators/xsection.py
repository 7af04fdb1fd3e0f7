"""Cross-sections of a date: winsorize, neutralize, standardise, industry and market features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelframe.functions.kernels import TINY, div
from panelframe.operators import order


def winsorize(df: DataFrame, day: str, columns: Sequence[str], lo: float = 0.01, hi: float = 0.99, spread: bool = False) -> DataFrame:
    """Columns clipped to their exact interpolated quantiles of the date. spread: for dates of any size, whose values then never meet in one task."""
    if spread:
        q = None
        for c in columns:
            own = order.quantiles(df, day, c, [lo, hi], f"\u0001q_{c}")
            q = own if q is None else q.join(own, day, "full")
        clip = {c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col(f"\u0001q_{c}")[0]), F.col(f"\u0001q_{c}")[1])) for c in columns}
        return df.join(q, day, "left").withColumns(clip).drop(*[f"\u0001q_{c}" for c in columns])
    q = df.groupBy(day).agg(*[F.percentile(c, F.array(F.lit(lo), F.lit(hi))).alias(f"\u0001q_{c}") for c in columns])
    clip = {c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col(f"\u0001q_{c}")[0]), F.col(f"\u0001q_{c}")[1])) for c in columns}
    return df.join(q, day).withColumns(clip).drop(*[f"\u0001q_{c}" for c in columns])


def neutralize(df: DataFrame, day: str, industry: str, size: str, columns: Sequence[str]) -> DataFrame:
    """Adds <column>_neutral, the least-squares residual on log size and industry.

    The industry means are partialled out first, so that sums by (date, industry) suffice; no solver. A null industry
    counts to the first one of the date. Rows without the value or the size, and dates with fewer than two rows, give null.
    """
    c = Window.partitionBy(day)
    df = df.withColumns({"\u0001g": F.coalesce(F.col(industry), F.min(industry).over(c), F.lit("")), "\u0001x": F.when(F.col(size) > 0, F.ln(size))})
    df = df.withColumn("\u0001x", F.col("\u0001x") - F.avg("\u0001x").over(c))
    sums = []
    for i, name in enumerate(columns):
        ok = F.col("\u0001x").isNotNull() & F.col(name).isNotNull()
        x, y = F.when(ok, F.col("\u0001x")), F.when(ok, F.col(name))
        sums += [F.count(x).alias(f"\u0001n{i}"), F.avg(x).alias(f"\u0001mx{i}"), F.avg(y).alias(f"\u0001my{i}"), F.covar_pop(x, y).alias(f"\u0001cxy{i}"), F.var_pop(x).alias(f"\u0001vx{i}")]
    groups = df.groupBy(day, "\u0001g").agg(*sums)
    fits = groups
    for i in range(len(columns)):
        xy, xx = F.sum(F.col(f"\u0001cxy{i}") * F.col(f"\u0001n{i}")).over(c), F.sum(F.col(f"\u0001vx{i}") * F.col(f"\u0001n{i}")).over(c)
        fits = fits.withColumns({f"\u0001b{i}": F.coalesce(div(xy, F.when(xx > TINY, xx)), F.lit(0.0)), f"\u0001all{i}": F.sum(f"\u0001n{i}").over(c)})
    out = df.join(fits, [day, "\u0001g"])
    residual = {f"{name}_neutral": F.when(F.col(f"\u0001all{i}") >= 2, F.col(name) - F.col(f"\u0001my{i}") - F.col(f"\u0001b{i}") * (F.col("\u0001x") - F.col(f"\u0001mx{i}"))) for i, name in enumerate(columns)}
    return out.select(*[x for x in df.columns if x not in ("\u0001g", "\u0001x")], *[v.alias(k) for k, v in residual.items()])


def zscore(x: Column, day: str) -> Column:
    """Null where the date's deviation is 0 or missing."""
    w = Window.partitionBy(day)
    s = F.stddev_samp(x).over(w)
    return F.when(s > TINY, (x - F.avg(x).over(w)) / s)


def clipped_zscore(x: Column, day: str, bound: float = 3.0, least: int = 30) -> Column:
    """Population deviation, clipped, 0 for missing; null below `least` values or without spread."""
    w = Window.partitionBy(day)
    s, n = F.stddev_pop(x).over(w), F.count(x).over(w)
    return F.when((n >= least) & (s > 1e-8), F.coalesce(F.least(F.greatest((x - F.avg(x).over(w)) / s, F.lit(-bound)), F.lit(bound)), F.lit(0.0)))


def standardize(df: DataFrame, day: str, industry: str, size: str, neutral: Sequence[str], plain: Sequence[str] = (), spread: bool = False) -> DataFrame:
    """X11: winsorize (spread: dates of any size), neutralize and z-score the factors; z-score the plain columns. Adds <name>_standard."""
    out = neutralize(winsorize(df, day, [*neutral, *plain], spread=spread), day, industry, size, neutral)
    w = Window.partitionBy(day)
    out = out.withColumns({f"{c}_neutral": F.when(F.count(c).over(w) == 0, F.lit(0.0)).otherwise(F.col(f"{c}_neutral")) for c in neutral})
    return out.withColumns({f"{c}_standard": zscore(F.col(f"{c}_neutral"), day) for c in neutral} | {f"{c}_standard": zscore(F.col(c), day) for c in plain})


def pending_dates(calendar: DataFrame, manifest: DataFrame, day: str) -> DataFrame:
    """Calendar dates that the manifest of processed ones lacks."""
    return calendar.select(day).distinct().join(manifest.select(day), day, "left_anti")


def unfinished_dates(calendar: DataFrame, built: DataFrame, standardized: DataFrame, day: str) -> DataFrame:
    """(day, to_build) of the calendar dates that are not standardised; to_build: not even built."""
    todo = pending_dates(calendar, standardized, day)
    return todo.join(built.select(day).distinct().withColumn("\u0001b", F.lit(True)), day, "left").select(day, F.col("\u0001b").isNull().alias("to_build"))


def rebuild_needed(have: Sequence[str], wanted: Sequence[str]) -> tuple[bool, list[str]]:
    """Whether the newest partition lacks columns that are wanted (then all dates are built again), and which."""
    lacking = [c for c in wanted if c not in set(have)]
    return bool(lacking), lacking


def industry_features(df: DataFrame, day: str, industry: str, ret: str, flow: str, size: str, pe: str) -> DataFrame:
    """By date and industry: sums, shares and ranks over rows of the industry's own history."""
    g = df.withColumn(industry, F.coalesce(F.col(industry), F.lit("__UNKNOWN__")))
    a = g.groupBy(day, industry).agg(F.avg(ret).alias("r"), F.avg((F.col(ret) > 0).cast("double")).alias("up"), F.sum(flow).alias("flow"), F.sum(size).alias("mv"), F.percentile(pe, F.lit(0.5)).alias("pe"))
    w = lambda n: Window.partitionBy(industry).orderBy(day).rowsBetween(-(n - 1), 0)
    s60 = F.stddev_samp("pe").over(w(60))
    out = a.withColumns(
        {f"ind_ret_{n}d": F.sum("r").over(w(n)) for n in (1, 5, 20)}
        | {f"ind_up_{n}d": F.avg("up").over(w(n)) for n in (5, 20)}
        | {f"ind_flow_{n}d": div(F.sum("flow").over(w(n)), F.avg("mv").over(w(20))) for n in (5, 20)}
        | {"ind_pe_z": F.when((F.count("pe").over(w(60)) >= 20) & (s60 > TINY), (F.col("pe") - F.avg("pe").over(w(60))) / s60)}
    )
    held = F.round("ind_ret_20d", 9)
    rank = F.rank().over(Window.partitionBy(day).orderBy(held.asc_nulls_last())) + (F.count(F.lit(1)).over(Window.partitionBy(day, held)) - 1) / 2.0
    return out.withColumn("ind_mom_rank", F.when(F.col("ind_ret_20d").isNotNull(), rank / F.count("ind_ret_20d").over(Window.partitionBy(day)))).drop("r", "up", "flow", "mv", "pe")


def market_features(df: DataFrame, day: str, ret: str) -> DataFrame:
    """Market return and breadth, each against its own 60 rows (20 at least). One row a date: a single series."""
    a = df.groupBy(day).agg(F.avg(ret).alias("r"), F.avg((F.col(ret) > 0).cast("double")).alias("up"))
    w = lambda n: Window.orderBy(day).rowsBetween(-(n - 1), 0)
    raw = a.withColumns({"mkt_ret_5d": F.sum("r").over(w(5)), "mkt_ret_20d": F.sum("r").over(w(20)), "mkt_up_1d": F.col("up"), "mkt_up_5d": F.avg("up").over(w(5))})
    names = ("mkt_ret_5d", "mkt_ret_20d", "mkt_up_1d", "mkt_up_5d")
    z = lambda c: F.when((F.count(c).over(w(60)) >= 20) & (F.stddev_samp(c).over(w(60)) > TINY), (F.col(c) - F.avg(c).over(w(60))) / F.stddev_samp(c).over(w(60)))
    return raw.select(day, *[z(c).alias(c) for c in names])


def attach(df: DataFrame, industries: DataFrame, market: DataFrame, day: str, industry: str) -> DataFrame:
    """Both tables back to the rows; infinite values become null."""
    key = F.coalesce(F.col(industry), F.lit("__UNKNOWN__"))
    added = [c for c in (*industries.columns, *market.columns) if c not in (day, industry)]
    out = df.withColumn("\u0001ind", key).join(industries.withColumnRenamed(industry, "\u0001ind"), [day, "\u0001ind"], "left").join(market, day, "left").drop("\u0001ind")
    return out.withColumns({c: F.when(F.abs(F.col(c)) != float("inf"), F.col(c)) for c in added})


def zscore_attached(df: DataFrame, day: str, columns: Sequence[str]) -> DataFrame:
    """Attached features by date, missing as 0; those that are constant on a date (the market's) stay as they are."""
    w = Window.partitionBy(day)

    def one(c: str) -> Column:
        s = F.stddev_samp(c).over(w)
        return F.when(s > TINY, F.coalesce((F.col(c) - F.avg(c).over(w)) / s, F.lit(0.0))).otherwise(F.col(c))

    return df.withColumns({c: one(c) for c in columns})
