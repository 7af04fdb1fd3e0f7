"""Readers, sinks and upkeep of panel tables: CSV folders, date partitions, manifests.

A table is a folder of Parquet partitions by date with a fixed schema. Writers replace
whole partitions, so that a rerun of a date gives the same table. Upserts, compaction, resets and rollbacks with
readers at work are in panelframe.sources.versions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from panelframe.functions.scalar import normal_date
from panelframe.operators.joins import keep_old, outer_join
from panelframe.operators.relational import upsert


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType | str, tolerant: bool = False) -> DataFrame:
    """A folder of CSV files with headers; tolerant: rows and files that can't be read are left out."""
    r = spark.read.schema(schema).option("header", True).option("enforceSchema", False)
    if tolerant:
        r = r.option("mode", "DROPMALFORMED").option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).option("enforceSchema", True)
    return r.csv(path)


def read_csv_since(spark: SparkSession, path: str, schema: StructType | str, since: str) -> DataFrame:
    """Only files named by a later date (YYYYMMDD), or all if none is. The names are listed, no other file is opened."""
    names = spark.read.format("binaryFile").load(path).select("path").withColumn("_at", F.regexp_extract("path", r"(\d{8})[^/]*(/part-[^/]*)?$", 1))  # a file, or a folder of parts
    later = [r["path"] for r in names.where(F.col("_at") > since).collect()]  # a file a date
    return read_csv(spark, later or path, schema)


def column_names(df: DataFrame) -> list[str]:
    """Without unnamed index columns."""
    return [c for c in df.columns if not c.startswith("Unnamed") and c != "_c0"]


def parse_dates(df: DataFrame, column: str) -> DataFrame:
    """The date column as a date, first."""
    return df.select(normal_date(F.col(column)).alias(column), *[c for c in df.columns if c != column])


def write_dates(df: DataFrame, path: str, day: str = "d", mode: str = "overwrite") -> None:
    """Replaces the partitions of the dates in df, one file each, and leaves the others."""
    df.repartition(F.col(day)).write.partitionBy(day).option("partitionOverwriteMode", "dynamic").mode(mode).parquet(path)


def read_dates(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    r = spark.read
    return (r.schema(schema) if schema is not None else r).parquet(path)


def read_day(spark: SparkSession, path: str, value, columns: Sequence[str] | None = None, day: str = "d") -> DataFrame:
    """Only the partition of the day is read."""
    df = read_dates(spark, path).where(F.col(day) == F.lit(value))
    return df.select(day, *columns) if columns else df


def read_window(spark: SparkSession, path: str, start, end, columns: Sequence[str] | None = None, day: str = "d") -> DataFrame:
    """Dates from start to end, both included, in either order."""
    lo, hi = sorted((start, end))
    df = read_dates(spark, path).where(F.col(day).between(F.lit(lo), F.lit(hi)))
    return df.select(day, *columns) if columns else df


def read_entity(spark: SparkSession, path: str, value, entity: str = "entity", start=None, end=None, day: str = "d") -> DataFrame:
    """The history of one entity; dates prune partitions, the entity row groups."""
    df = read_dates(spark, path).where(F.col(entity) == F.lit(value))
    if start is not None:
        df = df.where(F.col(day) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(day) <= F.lit(end))
    return df


def dates(df: DataFrame, day: str = "d") -> DataFrame:
    """The dates that exist; only the partition column is read."""
    return df.select(day).distinct()


def latest_date(df: DataFrame, day: str = "d"):
    """The last date, or None."""
    return df.agg(F.max(day)).first()[0]


def entities(df: DataFrame, entity: str = "entity") -> DataFrame:
    """S12"""
    return df.select(entity).distinct()


def footer_columns(spark: SparkSession, path: str) -> list[str]:
    """Names without reading rows."""
    return spark.read.parquet(path).columns


def export_sorted(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Range-partitioned and sorted by the keys."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.option("compression", "snappy").parquet(path)


def numbered(spark: SparkSession, path: str, out: str = "place") -> DataFrame:
    """The rows of a folder of Parquet files with their place (from 1) in the order of the files' names and the rows in them.

    A file's first place follows from the counts of the files before it, a row a file; no row is moved.
    """
    rows = spark.read.parquet(path).withColumns({"\u0001file": F.col("_metadata.file_name"), "\u0001row": F.col("_metadata.row_index")})
    before = Window.orderBy("\u0001file").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("\u0001file").count().withColumn("\u0001before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    return rows.join(F.broadcast(counts), "\u0001file").withColumn(out, F.col("\u0001before") + F.col("\u0001row") + 1).drop("\u0001file", "\u0001row", "\u0001before")


def write_results(tables: dict[str, DataFrame], path: str, form: str = "csv") -> None:
    """Each table under its name."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        (w.option("header", True).csv if form == "csv" else w.parquet)(f"{path}/{name}")


def next_start(df: DataFrame, day: str = "d"):
    """The day after the last one, or None for an empty source."""
    return df.agg(F.date_add(F.max(day), 1)).first()[0]


def rewind(manifest: DataFrame, since, end: str = "end_date") -> DataFrame:
    """No progress beyond `since`."""
    return manifest.withColumn(end, F.least(F.col(end), F.lit(since)))


def record_progress(manifest: DataFrame, df: DataFrame, entity: str = "entity", day: str = "d") -> DataFrame:
    """First and last date of each entity; the new record wins."""
    return upsert(manifest, df.groupBy(entity).agg(F.min(day).alias("start_date"), F.max(day).alias("end_date")), [entity])


def since_last(calendar: DataFrame, n: int, day: str = "d"):
    """The date n calendar rows before the last one."""
    row = calendar.select(day).distinct().orderBy(F.desc(day)).limit(n + 1).agg(F.min(day)).first()
    return row[0]


def extend_panel(old: DataFrame, sources: Sequence[DataFrame], keys: Sequence[str], day: str = "d") -> DataFrame:
    """The wide panel with the rows of its sources after its last date: only these are joined; old rows stay as they are."""
    last = latest_date(old, day)
    if last is None:
        return keep_old(old, outer_join(sources, keys), keys)
    newer = outer_join([s.where(F.col(day) > F.lit(last)) for s in sources], keys)
    if day in keys:  # none of these keys is in the old panel: nothing to look for
        return old.unionByName(newer, allowMissingColumns=True)
    return keep_old(old, newer, keys)


def lookback_start(calendar: DataFrame, start, rows: int, day: str = "d"):
    """The date so many calendar rows before the first one from `start` on, or the first there is."""
    row = calendar.select(day).distinct().where(F.col(day) < F.lit(start)).orderBy(F.desc(day)).limit(rows).agg(F.min(day)).first()
    return row[0] if row[0] is not None else start
