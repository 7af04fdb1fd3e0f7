"""Kernels over entity x date panels: guarded rolling statistics, ranks, positions, cross-sections.

Missing is null, never NaN. A rolling statistic is null until `least` values are in
its frame (the whole window if not given). Divisions by zero give null. A deviation
below 1e-9 counts as zero. Ranks compare to nine decimals and average ties.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TINY = 1e-9


@dataclass(frozen=True)
class Spec:
    entity: str = "entity"
    order: str = "d"

    @property
    def rows(self):
        return Window.partitionBy(self.entity).orderBy(self.order)

    def last(self, n: int):
        return self.rows.rowsBetween(-(n - 1), 0)

    @property
    def so_far(self):
        return self.rows.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def date(self):
        return Window.partitionBy(self.order)


def div(x: Column, y: Column) -> Column:
    return F.try_divide(x, y)


def _guard(value: Column, x: Column, n: int, least: int | None, w) -> Column:
    return F.when(F.count(x).over(w) >= (n if least is None else least), value)


def lag(s: Spec, x: Column, n: int) -> Column:
    return F.lag(x, n).over(s.rows)


def lead(s: Spec, x: Column, n: int) -> Column:
    return F.lead(x, n).over(s.rows)


def ffill(s: Spec, x: Column) -> Column:
    return F.last(x, ignorenulls=True).over(s.so_far)


def _rolling(f):
    def kernel(s: Spec, x: Column, n: int, least: int | None = None) -> Column:
        w = s.last(n)
        return _guard(f(x).over(w), x, n, least, w)

    return kernel


def _settled(x: Column) -> Column:
    """A deviation, with noise of constant frames set to zero."""
    return F.when(x < TINY, F.lit(0.0)).otherwise(x)


mean, total, low, high, product = _rolling(F.avg), _rolling(F.sum), _rolling(F.min), _rolling(F.max), _rolling(F.product)


def std(s: Spec, x: Column, n: int, least: int | None = None) -> Column:
    w = s.last(n)
    return _guard(_settled(F.stddev_samp(x).over(w)), x, n, least, w)


def _pair(x: Column, y: Column) -> tuple[Column, Column]:
    both = x.isNotNull() & y.isNotNull()
    return F.when(both, x), F.when(both, y)


def corr(s: Spec, x: Column, y: Column, n: int, least: int | None = None) -> Column:
    """Pearson over pairs; null where a side is constant (the built-in raises there)."""
    w, (x, y) = s.last(n), _pair(x, y)
    sx, sy = F.stddev_pop(x).over(w), F.stddev_pop(y).over(w)
    value = F.when((sx > TINY) & (sy > TINY), F.covar_pop(x, y).over(w) / (sx * sy))
    return _guard(value, x, n, least, w)


def cov(s: Spec, x: Column, y: Column, n: int, least: int | None = None) -> Column:
    w, (x, y) = s.last(n), _pair(x, y)
    return _guard(F.covar_samp(x, y).over(w), x, n, least, w)


def quantile(s: Spec, x: Column, p: float, n: int, least: int | None = None) -> Column:
    w = s.last(n)
    return _guard(F.percentile(x, F.lit(p)).over(w), x, n, least, w)


def slope(s: Spec, y: Column, x: Column, n: int) -> Column:
    """Least-squares slope of y on x over pairs, two at least, after n rows."""
    w, (y, x) = s.last(n), _pair(y, x)
    value = F.when((F.count(x).over(w) >= 2) & (F.stddev_pop(x).over(w) > TINY), F.regr_slope(y, x).over(w))
    return F.when(F.count(F.lit(1)).over(w) >= n, value)


def mad(s: Spec, x: Column, n: int) -> Column:
    w = s.last(n)
    values = F.collect_list(x).over(w)
    middle = F.avg(x).over(w)
    gaps = F.aggregate(values, F.lit(0.0), lambda a, v: a + F.abs(v - middle))
    return F.when(F.count(x).over(w) >= n, gaps / F.lit(float(n)))


def _held(x: Column) -> Column:
    return F.round(x, 9)


def ts_rank(s: Spec, x: Column, n: int) -> Column:
    """Percentile rank, ties averaged, of the current value in its full frame."""
    w = s.last(n)
    v = F.collect_list(_held(x)).over(w)
    here = _held(x)
    below, same = F.size(F.filter(v, lambda a: a < here)), F.size(F.filter(v, lambda a: a == here))
    return F.when((F.size(v) == n) & x.isNotNull(), (below + (same + 1) / 2.0) / F.lit(float(n)))


def ts_argmax(s: Spec, x: Column, n: int) -> Column:
    """Place (0 oldest) of the first maximum of a full frame."""
    v = F.collect_list(_held(x)).over(s.last(n))
    return F.when(F.size(v) == n, (F.array_position(v, F.array_max(v)) - 1).cast("double"))


def ts_argmin(s: Spec, x: Column, n: int) -> Column:
    v = F.collect_list(_held(x)).over(s.last(n))
    return F.when(F.size(v) == n, (F.array_position(v, F.array_min(v)) - 1).cast("double"))


def _ranked(x: Column, *by: str) -> Column:
    h = _held(x)
    w = Window.partitionBy(*by).orderBy(h.asc_nulls_last())  # one sort serves ranks and ties
    rank = F.rank().over(w)
    peers = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(x.isNotNull(), (rank + (peers - 1) / 2.0) / F.count(x).over(Window.partitionBy(*by)))


def prank(s: Spec, x: Column) -> Column:
    """Percentile rank in the whole history of the entity, as the legacy factors define it: later rows change it."""
    return _ranked(x, s.entity)


def x_rank(s: Spec, x: Column) -> Column:
    """Percentile rank among the entities of a date."""
    return _ranked(x, s.order)


def ranks_of_dates(df: DataFrame, values: dict[str, Column], keep: Sequence[str], order: str) -> DataFrame:
    """The columns to keep and under their names the `x_rank` of each value: one exchange by date for all of them, a date a group."""
    names = list(values)
    d = df.select(*keep, *[_held(x.cast("double")).alias(n) for n, x in values.items()])

    def ranked(table: pa.Table) -> pa.Table:
        for n in names:
            column = table.column(n)
            there = np.flatnonzero(column.is_valid().to_numpy())
            found = np.zeros(table.num_rows)
            if len(there):
                _, value, count = np.unique(column.drop_null().to_numpy(), return_inverse=True, return_counts=True)
                below = count.cumsum() - count
                found[there] = ((below + 1 + (count - 1) / 2.0) / len(there))[value]
            none = np.ones(table.num_rows, bool)
            none[there] = False
            table = table.set_column(table.column_names.index(n), n, pa.array(found, mask=none))
        return table

    return d.groupBy(order).applyInArrow(ranked, d.select(*keep, *[F.col(n) for n in names]).schema)


def cum_sum(s: Spec, x: Column) -> Column:
    return F.sum(x).over(s.so_far)


def cum_max(s: Spec, x: Column) -> Column:
    return F.max(x).over(s.so_far)


def cum_prod(s: Spec, x: Column) -> Column:
    return F.product(x).over(s.so_far)


def cum_count(s: Spec, x: Column) -> Column:
    return F.count(x).over(s.so_far).cast("double")


def first(s: Spec, x: Column) -> Column:
    return F.first(x, ignorenulls=True).over(s.so_far)


def run_sum(s: Spec, x: Column, group: Column) -> Column:
    """Running sum of x within runs of equal group."""
    return F.sum(x).over(Window.partitionBy(s.entity, group).orderBy(s.order).rowsBetween(Window.unboundedPreceding, 0))


def x_mean(s: Spec, x: Column) -> Column:
    return F.avg(x).over(s.date)


def x_std(s: Spec, x: Column) -> Column:
    return _settled(F.stddev_samp(x).over(s.date))


def x_stdp(s: Spec, x: Column) -> Column:
    return _settled(F.stddev_pop(x).over(s.date))


def x_count(s: Spec, x: Column) -> Column:
    return F.count(x).over(s.date).cast("double")


def x_quantile(s: Spec, x: Column, p: float) -> Column:
    return F.percentile(x, F.lit(p)).over(s.date)


def ewm(s: Spec, x: Column, alpha: float) -> Column:
    raise TypeError("recursive: see panelframe.operators.history")


WINDOWED = {
    "lag": lag, "lead": lead, "ffill": ffill, "mean": mean, "sum": total, "min": low, "max": high, "prod": product, "std": std, "corr": corr, "cov": cov,
    "quantile": quantile, "slope": slope, "mad": mad, "ts_rank": ts_rank, "ts_argmax": ts_argmax, "ts_argmin": ts_argmin, "prank": prank, "x_rank": x_rank,
    "cum_sum": cum_sum, "cum_max": cum_max, "cum_prod": cum_prod, "cum_count": cum_count, "first": first, "run_sum": run_sum, "x_mean": x_mean, "x_std": x_std,
    "x_stdp": x_stdp, "x_count": x_count, "x_quantile": x_quantile, "ewm": ewm,
}

SCALAR = {
    "add": lambda x, y: x + y,
    "sub": lambda x, y: x - y,
    "mul": lambda x, y: x * y,
    "div": div,
    "pow": F.pow,
    "lt": lambda x, y: x < y,
    "gt": lambda x, y: x > y,
    "le": lambda x, y: x <= y,
    "ge": lambda x, y: x >= y,
    "eq": lambda x, y: x == y,
    "and": lambda x, y: x & y,
    "or": lambda x, y: x | y,
    "abs": F.abs,
    "sign": F.signum,
    "ln": lambda x: F.when(x > 0, F.ln(x)),
    "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)),
    "ceil": lambda x: F.ceil(x).cast("double"),
    "floor": lambda x: F.floor(x).cast("double"),
    "not_null": lambda x: x.isNotNull(),
    "greatest": F.greatest,
    "least": F.least,
    "coalesce": F.coalesce,
    "if": lambda c, x, y=None: F.when(c, x) if y is None else F.when(c, x).otherwise(y),
}
