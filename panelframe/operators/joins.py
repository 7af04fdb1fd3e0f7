"""Joins over panels: suffixed outer joins, defaults, as-of, intervals, offsets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def outer_join(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer join on the keys, left to right; names that both sides have get _x and _y at each step."""

    def two(a: DataFrame, b: DataFrame) -> DataFrame:
        both = (set(a.columns) & set(b.columns)) - set(keys)
        a = a.withColumnsRenamed({c: f"{c}_x" for c in both})
        b = b.withColumnsRenamed({c: f"{c}_y" for c in both})
        return a.join(b, list(keys), "full_outer")

    return reduce(two, frames)


def left_with_default(df: DataFrame, other: DataFrame, keys: Sequence[str], defaults: dict[str, object]) -> DataFrame:
    """Left join; missing values of the right side get defaults."""
    out = df.join(other, list(keys), "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def _bucket(df: DataFrame, at: str, days: int):
    """The time bucket of a date or time, or None for other types."""
    kind = df.schema[at].dataType.typeName()
    if kind == "date":
        return lambda x: F.floor(F.unix_date(x) / days)
    return (lambda x: F.floor(F.unix_seconds(x) / (86400 * days))) if kind == "timestamp" else None


def asof(left: DataFrame, right: DataFrame, by: str, left_at: str, right_at: str, values: Sequence[str], strict: bool = False, days: int = 64) -> DataFrame:
    """For each left row the values of the latest right row of its key at or before it (before it, if strict).

    In two levels, so that a key of any size spreads over its time buckets of so many days: the last values of each bucket are carried to the
    key's next buckets (a row a key and bucket), and stand first where the rows of a key and bucket are sorted. Right rows that share key and time must be one. Keys
    whose time is neither date nor timestamp are sorted whole.
    """
    tag, at, side, found, bucket = "\u0001side", "\u0001at", "\u0001left", "\u0001asof", "\u0001bucket"
    of = _bucket(right, right_at, days)
    place = (lambda x: F.lit(0)) if of is None else of
    r = right.select(F.col(by), F.col(right_at).alias(at), F.struct(*values).alias(found), F.lit(1 if strict else 0).alias(tag), place(F.col(right_at)).alias(bucket))
    lf = left.withColumns({at: F.col(left_at).cast(r.schema[at].dataType), found: F.lit(None).cast(r.schema[found].dataType), tag: F.lit(0 if strict else 1)}).withColumn(bucket, place(F.col(at)))
    both = lf.withColumn(side, F.lit(True)).unionByName(r.withColumn(side, F.lit(False)), allowMissingColumns=True)
    if of is not None:
        last = r.groupBy(by, bucket).agg(F.max_by(found, at).alias(found))
        asked = lf.select(by, bucket).distinct().withColumn(found, F.lit(None).cast(r.schema[found].dataType))
        before = Window.partitionBy(by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        each = last.unionByName(asked).groupBy(by, bucket).agg(F.first(found, ignorenulls=True).alias(found))
        carried = each.withColumn(found, F.last(found, ignorenulls=True).over(before)).where(F.col(found).isNotNull())
        both = both.unionByName(carried.withColumns({at: F.lit(None).cast(r.schema[at].dataType), tag: F.lit(0), side: F.lit(False)}), allowMissingColumns=True)
    w = Window.partitionBy(by, bucket).orderBy(F.col(at).asc_nulls_first(), tag).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn(found, F.when(F.col(at).isNotNull(), F.last(found, ignorenulls=True).over(w))).where(F.col(side))
    return out.select(*left.columns, *[F.col(f"{found}.{v}").alias(v) for v in values])


def merged_spells(spells: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, start, end): spells that overlap or touch as one; a null end is open; spells without a start, or that end before it, go."""
    s = spells.select(key, F.col(start).alias("\u0001from"), F.coalesce(F.col(end), F.to_date(F.lit("9999-12-31"))).alias("\u0001to")).where(F.col("\u0001from") <= F.col("\u0001to"))
    w = Window.partitionBy(key).orderBy("\u0001from", "\u0001to")
    reach = F.max("\u0001to").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = reach.isNull() | (F.datediff(F.col("\u0001from"), reach) > 1)
    s = s.withColumn("\u0001new", new.cast("int")).withColumn("\u0001n", F.sum("\u0001new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(key, "\u0001n").agg(F.min("\u0001from").alias(start), F.max("\u0001to").alias(end)).drop("\u0001n")


def expand_intervals(spells: DataFrame, days: DataFrame, key: str, start: str, end: str, day: str, flag: str = "flag", width: int = 64) -> DataFrame:
    """(key, day, flag) for every key with a spell and every day: 1 if the day lies in one of its spells (open end: for ever).

    Spells are merged, cut to the calendar and laid into bins of `width` days; a day meets the spells of its key and bin. So a spell costs its bins,
    not its days, and no day meets two of them.
    """
    first, last = days.agg(F.min(day), F.max(day)).first()
    keys = spells.select(key).distinct()
    if last is None:
        return keys.limit(0).join(days.select(day), F.lit(True)).withColumn(flag, F.lit(0))
    bins = lambda x: F.floor(F.unix_date(x) / width)
    s = merged_spells(spells, key, start, end).select(key, F.greatest(start, F.lit(first)).alias("\u0001from"), F.least(end, F.lit(last)).alias("\u0001to")).where(F.col("\u0001from") <= F.col("\u0001to"))
    s = s.withColumn("\u0001bin", F.explode(F.sequence(bins(F.col("\u0001from")), bins(F.col("\u0001to")))))
    grid = keys.crossJoin(F.broadcast(days.select(day).distinct())).withColumn("\u0001bin", bins(F.col(day)))  # days: a calendar, some thousands at most
    own = s.select(F.col(key).alias("\u0001key"), F.col("\u0001bin").alias("\u0001b"), "\u0001from", "\u0001to")
    met = grid.join(own, (F.col(key) == F.col("\u0001key")) & (F.col("\u0001bin") == F.col("\u0001b")) & F.col(day).between(F.col("\u0001from"), F.col("\u0001to")), "left")
    return met.select(key, day, F.col("\u0001from").isNotNull().cast("int").alias(flag))


def replicate(df: DataFrame, dates: DataFrame) -> DataFrame:
    """Every row for every new date (a calendar of bounded size)."""
    return df.crossJoin(F.broadcast(dates.distinct()))


def keep_old(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows win; old rows whose keys the new ones lack stay; columns are united."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def offset_join(df: DataFrame, calendar: DataFrame, by: str, day: str, k: int, values: Sequence[str], suffix: str) -> DataFrame:
    """Values of the same key k calendar rows later (earlier for negative k)."""
    index = calendar_index(calendar, day)
    other = df.join(F.broadcast(index), day).select(by, (F.col("idx") - k).alias("idx"), *[F.col(v).alias(f"{v}{suffix}") for v in values])
    return df.join(F.broadcast(index), day).join(other, [by, "idx"], "left").drop("idx")


def calendar_index(calendar: DataFrame, day: str) -> DataFrame:
    """Days in order with their number; a calendar, some thousands of rows at most, in one window."""
    return calendar.select(day).distinct().withColumn("idx", F.row_number().over(Window.orderBy(day)))


def pairs_before(df: DataFrame, at: str, columns: Sequence[str]) -> DataFrame:
    """Each pair of rows i < j by `at` of a reduced table (such as every fifth date of one series)."""
    i = df.select(*[F.col(c).alias(f"{c}_i") for c in (at, *columns)])
    j = df.select(*[F.col(c).alias(f"{c}_j") for c in (at, *columns)])
    return i.join(j, F.col(f"{at}_i") < F.col(f"{at}_j"))


def between_batches(events: DataFrame, batches: DataFrame, at: str, start: str) -> DataFrame:
    """Events with the batch they fall in: after its start, up to and with the next one's. As-of, strict, on one series."""
    one = batches.select(F.col(start)).distinct().withColumns({"\u0001k": F.lit(0), "batch": F.col(start)})
    return asof(events.withColumn("\u0001k", F.lit(0)), one, "\u0001k", at, start, ["batch"], strict=True).drop("\u0001k")


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default: Column | None = None) -> DataFrame:
    """The mapped value, or the default."""
    out = df.join(table.select(key, value), key, "left")
    return out if default is None else out.withColumn(value, F.coalesce(F.col(value), default))
