"""Panels built from the driver's tables: bars by supplier and week or month, dimensions, filings, spells, indices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    """One row for each supplier and period with trades: open, high, low, close, vol, amount, adj and derived columns."""
    li = table(spark, sf_dir, "lineitem")
    px = F.col("l_extendedprice") / F.col("l_quantity")
    at = F.struct(*_ORDER)
    out = li.groupBy(F.col("l_suppkey").alias("entity"), F.trunc("l_shipdate", unit).alias("d")).agg(
        F.min_by(px, at).cast("double").alias("open"),
        F.max(px).cast("double").alias("high"),
        F.min(px).cast("double").alias("low"),
        F.max_by(px, at).cast("double").alias("close_x"),
        F.sum("l_quantity").cast("double").alias("vol"),
        F.round(F.sum("l_extendedprice"), 2).cast("double").alias("amount_x"),
        F.round(1 + F.avg("l_tax"), 6).cast("double").alias("adj_factor"),
    )
    return adjusted(out.withColumn("turnover_rate_x", F.col("vol") / 100))


def adjusted(df: DataFrame) -> DataFrame:
    """adjusted prices; raw ones where there is no factor."""
    a = F.coalesce("adj_factor", F.lit(1.0)) if "adj_factor" in df.columns else F.lit(1.0)
    raw = {"open": "open_hfq", "high": "high_hfq", "low": "low_hfq", "close_x": "close_hfq"}
    return df.withColumns({new: F.col(old) * a for old, new in raw.items() if old in df.columns})


def with_values(df: DataFrame) -> DataFrame:
    """Market values: the running amount of the entity."""
    run = Window.partitionBy("entity").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    mv = F.round(F.sum("amount_x").over(run), 2)
    return df.withColumns({"circ_mv": mv, "total_mv": mv})


def densify(df: DataFrame, entity: str = "entity", order: str = "d") -> DataFrame:
    """A row for each entity and date of the panel; missing where there was none. Both sides of the product are distinct keys."""
    grid = df.select(entity).distinct().crossJoin(F.broadcast(df.select(order).distinct()))  # dates: a calendar, some thousands at most
    return grid.join(df, [entity, order], "left")


def dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").alias("entity"), F.col("s_name").alias("name"), F.col("r_name").alias("industry"), F.col("s_nationkey").alias("nation"))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly statements by nation from orders by status and priority, running balances, disclosure 30 days and more after the period's end."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    some = lambda which: F.round(F.coalesce(F.sum(F.when(which, F.col("o_totalprice"))), F.lit(0)), 2).cast("double")
    urgent, high = F.col("o_orderpriority").startswith("1"), F.col("o_orderpriority").startswith("2")
    q = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("nation"), F.trunc("o_orderdate", "quarter").alias("q")).agg(
        F.round(F.sum("o_totalprice"), 2).cast("double").alias("total_revenue"),
        some(F.col("o_orderstatus") == "F").alias("n_income"),
        some((F.col("o_orderstatus") == "F") & ~urgent).alias("n_income_attr_p"),
        some(F.col("o_orderstatus") != "O").alias("oper_cost"),
        some(urgent).alias("_cash"),
        some(high).alias("_debt"),
    )
    run = Window.partitionBy("nation").orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
    end = F.date_sub(F.add_months("q", 3), 1)
    sofar = lambda x: F.round(F.sum(x).over(run), 2)
    q = q.withColumns({"total_assets": sofar("total_revenue"), "total_liab": sofar("_debt"), "money_cap": sofar("_cash")})
    return q.select(
        "nation", end.alias("end_date"), F.date_add(end, (F.lit(30) + F.col("nation") % 15).cast("int")).alias("f_ann_date"), "total_revenue", "n_income", "total_assets",
        "n_income_attr_p", "oper_cost", "total_liab", "money_cap", F.when(F.col("nation") % 7 != 3, F.col("_debt")).alias("st_borr"), F.round(F.col("total_assets") - F.col("total_liab"), 2).alias("total_hldr_eqy_exc_min_int"),
    )
