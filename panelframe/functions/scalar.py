"""Scalar helpers: missing values, dates, names, filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_if_zero(x: Column) -> Column:
    return F.nullif(x, F.lit(0))


def safe_log(x: Column) -> Column:
    """Null at and below zero."""
    return F.when(x > 0, F.ln(x))


def finite(x: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def to_number(x: Column) -> Column:
    """Unparsable becomes null."""
    return finite(x.try_cast("double"))


def clip(x: Column, lo: float, hi: float) -> Column:
    """A missing value stays missing."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def flag(condition: Column) -> Column:
    """C11: 1 or 0; an unknown condition is 0."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def normal_date(x: Column) -> Column:
    """2024-01-02, 20240102 and 2024/01/02 to a date; anything else fails."""
    bare = F.regexp_replace(F.trim(x.cast("string")), "[-/]", "")
    return F.when(x.isNull(), F.lit(None).cast("date")).when(bare.rlike("^[0-9]{8}$"), F.to_date(bare, "yyyyMMdd")).otherwise(F.raise_error(F.concat(F.lit("not a date: "), x.cast("string"))).cast("date"))


def year_before(d: Column) -> Column:
    """C17"""
    return F.add_months(d, -12)


def next_weekday(d: Column) -> Column:
    """C20: the next day that is not Saturday or Sunday."""
    n = F.dayofweek(d)
    return F.date_add(d, F.when(n == 6, 3).when(n == 7, 2).otherwise(1))


def half_life(age: Column, half: float) -> Column:
    """K31, C22"""
    return F.pow(F.lit(2.0), -age / half)


def lots(amount: Column, lot: int = 100) -> Column:
    """C05"""
    return F.floor(amount / lot) * lot


def main_board(code: Column) -> Column:
    """Codes like 600000.SH (6, but not 688) and 000001.SZ (0)."""
    market, number = F.upper(F.right(code, F.lit(2))), F.substring(code, 1, 6)
    return F.coalesce((market == "SH") & number.startswith("6") & ~number.startswith("688") | (market == "SZ") & number.startswith("0"), F.lit(False))


def special_name(name: Column) -> Column:
    """Names marked ST, in any case of letters; a null name is not."""
    return F.coalesce(F.upper(name).contains("ST"), F.lit(False))


def with_key(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The key first, then the given columns that exist."""
    return df.select(key, *[c for c in columns if c != key and c in df.columns])


def eligible(df: DataFrame, flag_col: str = "is_st", name: str = "name", mv: str = "total_mv", least: float = 0.0) -> DataFrame:
    """Without special names (by flag, else by name) and below the least market value."""
    marked = F.coalesce(F.col(flag_col) == 1, special_name(F.col(name))) if flag_col in df.columns else special_name(F.col(name))
    return df.where(~marked & (F.coalesce(F.col(mv), F.lit(0.0)) >= least))


def open_days(calendar: DataFrame, day: str, is_open: str = "is_open") -> DataFrame:
    """J06"""
    return calendar.where(F.col(is_open) == 1).select(day)


def next_open(calendar: DataFrame, day: str, after, is_open: str = "is_open"):
    """The first open day after the given one, or None."""
    return calendar.where((F.col(is_open) == 1) & (F.col(day) > F.lit(after))).agg(F.min(day)).first()[0]


def latest_open(calendar: DataFrame, day: str, upto, is_open: str = "is_open"):
    return calendar.where((F.col(is_open) == 1) & (F.col(day) <= F.lit(upto))).agg(F.max(day)).first()[0]


def scaled(df: DataFrame, factors: dict[str, float]) -> DataFrame:
    """Columns in other units: each times its factor (thousands to ones, lots to shares)."""
    return df.withColumns({c: F.col(c) * F.lit(float(k)) for c, k in factors.items() if c in df.columns})


def eligible_view(df: DataFrame, names: DataFrame, key: str, features: DataFrame | None = None, keys: Sequence[str] = (), board: bool | str = False, **how) -> DataFrame:
    """Rows whose entity is listed, with its name and attached features, without special or small names, of the main board if asked (by the key, or by the column of codes that `board` names)."""
    out = df.join(names, key)
    if features is not None:
        out = out.join(features, list(keys), "left")
    out = eligible(out, **how)
    return out.where(main_board(F.col(board if isinstance(board, str) else key))) if board else out


def only_listed(df: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Rows whose key the list has; the list's columns are not added."""
    return df.join(names.select(key).distinct(), key, "left_semi")
