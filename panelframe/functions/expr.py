"""Column expressions over an entity x date panel, written once and put in layers.

A window function can't stand inside another one, so that an expression such as the
rank of a rolling correlation takes several steps. `Ex` keeps the formula; `layers`
names what a window reads and orders all names by depth, and `apply` adds one
`withColumns` per depth. The same formulas print as SQL (see panelframe.oracle).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelframe.functions import kernels as K


@dataclass(frozen=True)
class Ex:
    op: str
    args: tuple[Ex, ...] = ()
    params: tuple = ()

    @property
    def key(self) -> str:
        return f"{self.op}({','.join([*(a.key for a in self.args), *map(repr, self.params)])})"

    @property
    def windowed(self) -> bool:
        return self.op in K.WINDOWED

    @property
    def level(self) -> int:
        inner = max((a.level for a in self.args), default=0)
        return inner + 1 if self.windowed else inner

    def __add__(self, o):
        return Ex("add", (self, of(o)))

    def __radd__(self, o):
        return Ex("add", (of(o), self))

    def __sub__(self, o):
        return Ex("sub", (self, of(o)))

    def __rsub__(self, o):
        return Ex("sub", (of(o), self))

    def __mul__(self, o):
        return Ex("mul", (self, of(o)))

    def __rmul__(self, o):
        return Ex("mul", (of(o), self))

    def __truediv__(self, o):
        return Ex("div", (self, of(o)))

    def __rtruediv__(self, o):
        return Ex("div", (of(o), self))

    def __pow__(self, o):
        return Ex("pow", (self, of(o)))

    def __neg__(self):
        return Ex("sub", (of(0.0), self))

    def __lt__(self, o):
        return Ex("lt", (self, of(o)))

    def __gt__(self, o):
        return Ex("gt", (self, of(o)))

    def __le__(self, o):
        return Ex("le", (self, of(o)))

    def __ge__(self, o):
        return Ex("ge", (self, of(o)))

    def __and__(self, o):
        return Ex("and", (self, of(o)))

    def __or__(self, o):
        return Ex("or", (self, of(o)))

    def eq(self, o):
        return Ex("eq", (self, of(o)))

    def fill(self, v: float):
        return Ex("coalesce", (self, of(v)))


def of(x) -> Ex:
    return x if isinstance(x, Ex) else Ex("lit", (), (float(x) if isinstance(x, int | float) and not isinstance(x, bool) else x,))


def col(name: str) -> Ex:
    return Ex("col", (), (name,))


def _window(op: str) -> Callable[..., Ex]:
    def build(*args) -> Ex:
        exprs = tuple(a for a in args if isinstance(a, Ex))
        return Ex(op, exprs, tuple(a for a in args if not isinstance(a, Ex)))

    return build


def _scalar(op: str) -> Callable[..., Ex]:
    return lambda *args: Ex(op, tuple(of(a) for a in args))


lag, lead, ffill = _window("lag"), _window("lead"), _window("ffill")
mean, total, low, high, std = _window("mean"), _window("sum"), _window("min"), _window("max"), _window("std")
corr, cov, quantile, slope, mad = _window("corr"), _window("cov"), _window("quantile"), _window("slope"), _window("mad")
ts_rank, ts_argmax, ts_argmin, prank = _window("ts_rank"), _window("ts_argmax"), _window("ts_argmin"), _window("prank")
cum_sum, cum_max, cum_prod, cum_count, first = _window("cum_sum"), _window("cum_max"), _window("cum_prod"), _window("cum_count"), _window("first")
prod = _window("prod")
run_sum = _window("run_sum")
x_rank, x_mean, x_std, x_stdp, x_count, x_quantile = _window("x_rank"), _window("x_mean"), _window("x_std"), _window("x_stdp"), _window("x_count"), _window("x_quantile")
ewm = _window("ewm")
absolute, sign, ln, sqrt, ceil, floor, not_null = _scalar("abs"), _scalar("sign"), _scalar("ln"), _scalar("sqrt"), _scalar("ceil"), _scalar("floor"), _scalar("not_null")
greatest, least, coalesce, where = _scalar("greatest"), _scalar("least"), _scalar("coalesce"), _scalar("if")


def delta(x: Ex, n: int) -> Ex:
    return x - lag(x, n)


def pct(x: Ex, n: int) -> Ex:
    """Relative change over n rows, without padding: pad the input first where the gaps are to be bridged."""
    return x / lag(x, n) - 1


def signed_power(x: Ex, p: float) -> Ex:
    return sign(x) * absolute(x) ** p


def streak(up: Ex, stop: Ex) -> Ex:
    """Length of the run of `up` since the last `stop`; rows that are neither leave it as it is, and give 0."""
    one = where(up, 1.0, 0.0)
    so_far = cum_sum(one)
    return where(up, so_far - ffill(where(stop, so_far - one)).fill(0.0), 0.0)


def compound(x: Ex, n: int) -> Ex:
    return prod(1 + x, n) - 1


def poly(x: list[Ex], w: Iterable[float]) -> Ex:
    out = None
    for a, b in zip(x, w, strict=True):
        out = a * b if out is None else out + a * b
    return out


def layers(named: dict[str, Ex]) -> list[dict[str, Ex]]:
    """Steps of (name, expression): what a window reads is a column by then. Temporaries begin with `_t`."""
    steps: dict[int, dict[str, Ex]] = {}
    temps: dict[str, str] = {}

    def settle(e: Ex) -> Ex:
        """The expression with temporaries for what its windows read, and for windows below other windows."""
        args = tuple(settle(a) for a in e.args)
        if not e.windowed:
            return Ex(e.op, args, e.params)
        return Ex(e.op, tuple(named_as(raw, a) for raw, a in zip(e.args, args, strict=True)), e.params)

    def named_as(raw: Ex, settled: Ex) -> Ex:
        if raw.op == "col" and raw.params[0] not in named:
            return raw
        if raw.key not in temps:
            temps[raw.key] = f"_t{len(temps)}"
            steps.setdefault(raw.level, {})[temps[raw.key]] = settled
        return col(temps[raw.key])

    for name, e in named.items():
        steps.setdefault(e.level, {})[name] = settle(e)
    return [steps[k] for k in sorted(steps)]


def to_column(e: Ex, spec: K.Spec) -> Column:
    if e.op == "col":
        return F.col(e.params[0])
    if e.op == "lit":
        return F.lit(e.params[0])
    args = [to_column(a, spec) for a in e.args]
    if e.windowed:
        return K.WINDOWED[e.op](spec, *args, *e.params)
    return K.SCALAR[e.op](*args)


def _read(e: Ex) -> set[str]:
    return {e.params[0]} if e.op == "col" else set().union(*map(_read, e.args))


def _by_history(e: Ex) -> Iterable[Ex]:
    """The steps of a settled formula that take a pass over histories."""
    from panelframe.operators.history import by_history

    if e.windowed and by_history(e):
        yield e
    for a in e.args:
        yield from _by_history(a)


def _replaced(e: Ex, by: dict[str, str]) -> Ex:
    return col(by[e.key]) if e.key in by else Ex(e.op, tuple(_replaced(a, by) for a in e.args), e.params)


def _of_dates(e: Ex) -> Iterable[Ex]:
    """The ranks among the entities of a date in a settled formula."""
    if e.op == "x_rank":
        yield e
    else:
        for a in e.args:
            yield from _of_dates(a)


def apply(df: DataFrame, named: dict[str, Ex], entity: str = "entity", order: str = "d", digits: dict[str, int | None] | None = None, keep: Iterable[str] | None = None) -> DataFrame:
    """df with the named expressions added; of df's own columns those to keep, or all.

    Short frames stay in Spark's windows. Formulas with recursions, long frames or order statistics run in one pass over
    histories (panelframe.operators.history), all of them together, unless some look across entities: then only the
    steps that windows can't do take a pass each. Ranks within dates wait for each other: all that can be made by then take one pass over dates.
    """
    from panelframe.operators import history

    known = list(df.columns) if keep is None else [c for c in df.columns if c in set(keep)]
    if any(map(history.by_history, named.values())) and history.able(named):
        aside = {n: n + "\u0001" if n in df.columns else n for n in named}  # a formula may read the column that it replaces
        df = history.evaluate(df, {aside[n]: e for n, e in named.items()}, entity, order).drop(*[n for n in named if n in df.columns])
        df = df.withColumnsRenamed({a: n for n, a in aside.items()})
        return df.select(*[c for c in known if c not in named], *[_rounded(n, digits) for n in named])
    spec, done = K.Spec(entity, order), {}
    pending = [dict(step) for step in layers(named)]
    while any(pending):
        made: set[str] = set()  # by this wave: later steps may read it
        for i, step in enumerate(pending):
            waits = set().union(*pending[:i])  # of earlier steps, not there yet
            asked = set().union(*(_read(_replaced(e, done)) for earlier in pending[:i] for e in earlier.values()))  # not to be replaced yet
            ready = {n: e for n, e in ((n, _replaced(e, done)) for n, e in step.items()) if not any(True for _ in _of_dates(e)) and not waits & _read(e) and n not in asked}
            wanted = {x.key: x for e in ready.values() for x in _by_history(e) if x.key not in done}
            if wanted:
                done |= {key: f"_e{len(done) + k}" for k, key in enumerate(wanted)}
                df = history.evaluate(df, {done[k]: x for k, x in wanted.items()}, entity, order)
            if ready:
                df = df.withColumns({n: to_column(_replaced(e, done), spec) for n, e in ready.items()})
                made |= set(ready)
                pending[i] = {n: e for n, e in step.items() if n not in ready}
                df = _still_read(df, pending, done, [*named, *known, entity, order])
        waiting = set().union(*pending)
        ranks = {x.key: x for step in pending for e in step.values() for x in _of_dates(e) if x.key not in done and not waiting & _read(x)}
        if ranks:
            new = {key: f"_x{len(done) + k}" for k, key in enumerate(ranks)}
            args = {new[k]: to_column(x.args[0], spec) for k, x in ranks.items()}
            done |= new
            later = set(_still_read(df, pending, done, [*named, *known, entity, order]).columns)
            df = K.ranks_of_dates(df, args, [c for c in df.columns if c in later or c == order], order)
        elif not made:
            raise ValueError("formulas that read each other")
    return df.select(*[c for c in known if c not in named], *[_rounded(n, digits) for n in named])


def _still_read(df: DataFrame, pending: list[dict[str, Ex]], done: dict[str, str], kept: Iterable[str]) -> DataFrame:
    """What a pass over histories or dates sends is all that it gets: only columns that are read later stay."""
    read = set(kept).union(*(_read(_replaced(e, done)) for step in pending for e in step.values()))
    return df.select(*[c for c in df.columns if c in read])


def _rounded(name: str, digits: dict[str, int | None] | None) -> Column:
    n = None if digits is None else digits.get(name, digits.get("", 6))
    return F.col(name) if n is None else (F.round(F.col(name), n) + F.lit(0.0)).alias(name)
