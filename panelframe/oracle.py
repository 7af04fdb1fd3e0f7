"""The panel formulas as SQL text, for the comparison with another engine."""

from __future__ import annotations

from panelframe.functions.expr import Ex, col, cum_count, cum_sum, first, layers, of

TINY = "1e-9"


def _ewm(x: Ex, alpha: float) -> Ex:
    """The closed form over prefix sums, for series without gaps after their first value."""
    at = cum_count(x) - 1
    keep = of(1 - alpha)
    return keep**at * (cum_sum(x * alpha * keep ** (0 - at)) + (1 - alpha) * first(x))


def _plain(e: Ex) -> Ex:
    args = tuple(_plain(a) for a in e.args)
    return _ewm(args[0], e.params[0]) if e.op == "ewm" else Ex(e.op, args, e.params)


_SCALAR = {
    "add": "({0} + {1})", "sub": "({0} - {1})", "mul": "({0} * {1})", "div": "(CASE WHEN {1} = 0 THEN NULL ELSE {0} / {1} END)", "pow": "pow({0}, {1})",
    "lt": "({0} < {1})", "gt": "({0} > {1})", "le": "({0} <= {1})", "ge": "({0} >= {1})", "eq": "({0} = {1})", "and": "({0} AND {1})", "or": "({0} OR {1})",
    "abs": "abs({0})", "sign": "CAST(sign({0}) AS DOUBLE)", "ln": "(CASE WHEN {0} > 0 THEN ln({0}) END)", "sqrt": "(CASE WHEN {0} >= 0 THEN sqrt({0}) END)",
    "ceil": "ceil({0})", "floor": "floor({0})", "not_null": "({0} IS NOT NULL)",
}


def to_sql(e: Ex, entity: str = "entity", order: str = "d") -> str:
    if e.op == "col":
        return e.params[0]
    if e.op == "lit":
        v = e.params[0]
        return "NULL" if v is None else f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else repr(v)
    a = [to_sql(x, entity, order) for x in e.args]
    if e.op in _SCALAR:
        return _SCALAR[e.op].format(*a)
    if e.op in ("greatest", "least", "coalesce"):
        return f"{e.op}({', '.join(a)})"
    if e.op == "if":
        return f"(CASE WHEN {a[0]} THEN {a[1]}{f' ELSE {a[2]}' if len(a) > 2 else ''} END)"
    p, rows = e.params, f"PARTITION BY {entity} ORDER BY {order}"
    so_far = f"({rows} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    if e.op in ("lag", "lead"):
        return f"{e.op}({a[0]}, {p[0]}) OVER ({rows})"
    if e.op == "ffill":
        return f"last_value({a[0]} IGNORE NULLS) OVER {so_far}"
    if e.op == "first":
        return f"first_value({a[0]} IGNORE NULLS) OVER {so_far}"
    if e.op.startswith("cum_"):
        f = {"cum_sum": "sum", "cum_max": "max", "cum_prod": "product", "cum_count": "count"}[e.op]
        return f"CAST({f}({a[0]}) OVER {so_far} AS DOUBLE)"
    if e.op == "run_sum":
        return f"sum({a[0]}) OVER (PARTITION BY {entity}, {a[1]} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    if e.op in ("prank", "x_rank"):
        by, h = entity if e.op == "prank" else order, f"round({a[0]}, 9)"
        return f"(CASE WHEN {a[0]} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {h} NULLS LAST) + (count(*) OVER (PARTITION BY {by}, {h}) - 1) / 2.0) / count({a[0]}) OVER (PARTITION BY {by}) END)"
    if e.op.startswith("x_"):
        w = f"OVER (PARTITION BY {order})"
        f = {"x_mean": f"avg({a[0]}) {w}", "x_count": f"CAST(count({a[0]}) {w} AS DOUBLE)", "x_quantile": f"quantile_cont({a[0]}, {p[0] if p else 0}) {w}"}
        if e.op in f:
            return f[e.op]
        s = f"{'stddev_samp' if e.op == 'x_std' else 'stddev_pop'}({a[0]}) {w}"
        return f"(CASE WHEN {s} < {TINY} THEN 0.0 ELSE {s} END)"
    n = p[1] if e.op == "quantile" else p[0]
    least = (p[2] if len(p) > 2 else n) if e.op == "quantile" else (p[1] if len(p) > 1 else n)
    w = f"OVER ({rows} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    if e.op in ("mean", "sum", "min", "max", "prod"):
        f = {"mean": "avg", "prod": "product"}.get(e.op, e.op)
        return f"(CASE WHEN count({a[0]}) {w} >= {least} THEN {f}({a[0]}) {w} END)"
    if e.op == "std":
        s = f"stddev_samp({a[0]}) {w}"
        return f"(CASE WHEN count({a[0]}) {w} >= {least} THEN CASE WHEN {s} < {TINY} THEN 0.0 ELSE {s} END END)"
    if e.op == "quantile":
        return f"(CASE WHEN count({a[0]}) {w} >= {least} THEN quantile_cont({a[0]}, {p[0]}) {w} END)"
    if e.op in ("corr", "cov", "slope"):
        x, y = f"(CASE WHEN {a[1]} IS NOT NULL THEN {a[0]} END)", f"(CASE WHEN {a[0]} IS NOT NULL THEN {a[1]} END)"
        if e.op == "cov":
            return f"(CASE WHEN count({x}) {w} >= {least} THEN covar_samp({x}, {y}) {w} END)"
        if e.op == "slope":
            return f"(CASE WHEN count(*) {w} >= {n} AND count({y}) {w} >= 2 AND stddev_pop({y}) {w} > {TINY} THEN regr_slope({x}, {y}) {w} END)"
        sx, sy = f"stddev_pop({x}) {w}", f"stddev_pop({y}) {w}"
        return f"(CASE WHEN count({x}) {w} >= {least} AND {sx} > {TINY} AND {sy} > {TINY} THEN covar_pop({x}, {y}) {w} / ({sx} * {sy}) END)"
    if e.op == "mad":
        v = f"list_filter(list({a[0]}) {w}, lambda v: v IS NOT NULL)"
        return f"(CASE WHEN count({a[0]}) {w} >= {n} THEN list_sum(list_transform({v}, lambda v: abs(v - avg_{a[0]}))) / {float(n)} END)".replace(f"avg_{a[0]}", f"list_avg({v})")
    v, here = f"list_filter(list(round({a[0]}, 9)) {w}, lambda v: v IS NOT NULL)", f"round({a[0]}, 9)"
    if e.op == "ts_rank":
        return f"(CASE WHEN len({v}) = {n} AND {a[0]} IS NOT NULL THEN (len(list_filter({v}, lambda u: u < {here})) + (len(list_filter({v}, lambda u: u = {here})) + 1) / 2.0) / {float(n)} END)"
    if e.op in ("ts_argmax", "ts_argmin"):
        f = "list_max" if e.op == "ts_argmax" else "list_min"
        return f"(CASE WHEN len({v}) = {n} THEN CAST(list_position({v}, {f}({v})) - 1 AS DOUBLE) END)"
    raise KeyError(e.op)


def select(base: str, columns: list[str], named: dict[str, Ex], digits: dict[str, int | None] | None = None, entity: str = "entity", order: str = "d") -> str:
    """SQL that adds the named formulas to the rows of the query `base` (WITH parts, ending in a table named base)."""
    sql, at = base, "base"
    for i, step in enumerate(layers({n: _plain(e) for n, e in named.items()})):
        parts = ", ".join(f"{to_sql(e, entity, order)} AS {n}" for n, e in step.items())
        sql += f", s{i} AS (SELECT *, {parts} FROM {at})"
        at = f"s{i}"
    places = {n: None if digits is None else digits.get(n, digits.get("", 6)) for n in named}
    out = [n if places[n] is None else f"round({n}, {places[n]}) + 0.0 AS {n}" for n in named]
    return f"{sql} SELECT {', '.join([*columns, *out])} FROM {at}"


__all__ = ["col", "select", "to_sql"]
