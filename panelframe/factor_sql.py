"""The factor families as SQL written by hand from their definitions: a second version beside panelframe.plans.factors.

Nothing here is printed from the formulas of the library. A family is a chain of steps, each a list of "expression AS name" over the step before.
"""

from __future__ import annotations

from collections.abc import Sequence

_ROWS = "PARTITION BY entity ORDER BY d"
#: In one history: rows before and after, and all rows so far.
AT, SO_FAR = f"OVER ({_ROWS})", f"OVER ({_ROWS} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def over(n: int) -> str:
    return f"OVER ({_ROWS} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(f: str, x: str, n: int, least: int | None = None) -> str:
    """An aggregate of the last n rows, of which `least` (or all) must have a value."""
    return f"(CASE WHEN count({x}) {over(n)} >= {n if least is None else least} THEN {f}({x}) {over(n)} END)"


def dev(x: str, n: int) -> str:
    """Sample deviation of n values; what is below 1e-9 is 0."""
    return f"(CASE WHEN count({x}) {over(n)} >= {n} THEN CASE WHEN stddev_samp({x}) {over(n)} < 1e-9 THEN 0 ELSE stddev_samp({x}) {over(n)} END END)"


def pairs(f: str, x: str, y: str, n: int, least: int | None = None) -> str:
    """A covariance or correlation over rows that have both; no correlation with a constant."""
    a, b = f"(CASE WHEN {y} IS NOT NULL THEN {x} END)", f"(CASE WHEN {x} IS NOT NULL THEN {y} END)"
    enough = f"count({a}) {over(n)} >= {n if least is None else least}"
    if f == "cov":
        return f"(CASE WHEN {enough} THEN covar_samp({a}, {b}) {over(n)} END)"
    s = f"stddev_pop({a}) {over(n)} > 1e-9 AND stddev_pop({b}) {over(n)} > 1e-9"
    return f"(CASE WHEN {enough} AND {s} THEN covar_pop({a}, {b}) {over(n)} / (stddev_pop({a}) {over(n)} * stddev_pop({b}) {over(n)}) END)"


def rank(x: str) -> str:
    """Average percentile rank among the values of the whole history, to nine decimals."""
    return f"(CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY entity ORDER BY round({x}, 9)) + (count(*) OVER (PARTITION BY entity, round({x}, 9)) - 1) / 2.0) / count({x}) OVER (PARTITION BY entity) END)"


def newest_rank(x: str, n: int) -> str:
    """Average percentile rank of the newest of n values."""
    v = f"list_filter(list(round({x}, 9)) {over(n)}, lambda v: v IS NOT NULL)"
    return f"(CASE WHEN len({v}) = {n} THEN (len(list_filter({v}, lambda u: u < {v}[-1])) + (len(list_filter({v}, lambda u: u = {v}[-1])) + 1) / 2.0) / {n} END)"


def first_max(x: str, n: int) -> str:
    v = f"list_filter(list(round({x}, 9)) {over(n)}, lambda v: v IS NOT NULL)"
    return f"(CASE WHEN len({v}) = {n} THEN list_position({v}, list_max({v})) - 1.0 END)"


def smooth(x: str, a: str) -> str:
    """Exponential mean from the first value on, value after value; for series without gaps after it."""
    v = f"list_filter(list({x}) {SO_FAR}, lambda v: v IS NOT NULL)"
    return f"(CASE WHEN len({v}) > 0 THEN list_reduce({v}, lambda m, v: m * (1 - {a}) + v * {a}) END)"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) {AT}"


def nz(x: str) -> str:
    """For a divisor: null if 0."""
    return f"nullif({x}, 0)"


def chain(base: str, steps: Sequence[Sequence[str]], out: Sequence[str], digits: dict[str, int | None]) -> str:
    sql, at = base, "base"
    for i, step in enumerate(steps):
        sql += f", h{i} AS (SELECT *, {', '.join(step)} FROM {at})"
        at = f"h{i}"
    said = (n if (k := digits.get(n, digits.get("", 6))) is None else f"round({n}, {k}) + 0.0 AS {n}" for n in out)
    return f"WITH {sql} SELECT entity, d, {', '.join(said)} FROM {at}"


# ---- what many families start from ----------------------------------------------------------------------

_PX = "last_value(close_hfq IGNORE NULLS) " + SO_FAR + " AS px"
_RET = f"px / {nz(lag('px'))} - 1 AS ret"
_BASIC = [_PX, f"close_hfq - {lag('close_hfq')} AS dc", "(high_hfq + low_hfq + close_hfq) / 3 AS tp", "amount_x / nullif(vol, 0) * 10 AS vwap", f"last_value(vol IGNORE NULLS) {SO_FAR} AS pv"]


def labels() -> tuple[list, list]:
    names = {"label": 5, "label_1": 1, "label_3": 3, "label_10": 10, "label_25": 25}
    return [[_PX], [f"(lead(px, {n + 1}) {AT} - lead(px, 1) {AT}) / nullif(lead(px, 1) {AT}, 0) AS {k}" for k, n in names.items()]], list(names)


def _technical(o: str = "open_hfq", h: str = "high_hfq", lo: str = "low_hfq", c: str = "close_hfq") -> list[list[str]]:
    return [
        [f"last_value({c} IGNORE NULLS) {SO_FAR} AS px", f"{c} - {lag(c)} AS dc", f"({h} + {lo} + {c}) / 3 AS tp", "amount_x / nullif(vol, 0) * 10 AS vwap"],
        [_RET, smooth("px", "(2.0/13)") + " AS fast", smooth("px", "(2.0/27)") + " AS slow", "CASE WHEN dc >= 0 THEN tp * vol ELSE 0 END AS positive_flow", "CASE WHEN dc < 0 THEN tp * vol ELSE 0 END AS negative_flow",
         f"CASE WHEN {roll('max', h, 9, 1)} = {roll('min', lo, 9, 1)} THEN 50.0 ELSE ({c} - {roll('min', lo, 9, 1)}) / ({roll('max', h, 9, 1)} - {roll('min', lo, 9, 1)}) * 100 END AS rsv",
         "CASE WHEN dc > 0 THEN dc WHEN dc <= 0 THEN 0 END AS gain", "CASE WHEN dc < 0 THEN -dc WHEN dc >= 0 THEN 0 END AS loss", "vol * dc AS raw_force_index",
         f"list_aggregate([{h} - {lo}, abs({h} - {lag(c)}), abs({lo} - {lag(c)})], 'max') AS tr", f"{h} - {lag(h)} AS up", f"{lag(lo)} - {lo} AS down"],
        ["fast - slow AS dif", smooth("rsv", "(1.0/3)") + " AS kdj_k", f"{roll('avg', 'gain', 14)} AS g14", f"{roll('avg', 'loss', 14)} AS l14", f"{roll('avg', 'tp', 14)} AS tp14", f"last_value(raw_force_index IGNORE NULLS) {SO_FAR} AS force_index_smoothed",
         f"{roll('sum', 'positive_flow', 14)} AS p14", f"{roll('sum', 'negative_flow', 14)} AS n14", smooth("tr", "(1.0/14)") + " AS atr", "CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS dm_up", "CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS dm_down"],
        [smooth("dif", "(2.0/10)") + " AS dea", smooth("kdj_k", "(1.0/3)") + " AS kdj_d", smooth("dm_up", "(1.0/14)") + " AS s_up", smooth("dm_down", "(1.0/14)") + " AS s_down",
         "CASE WHEN tp14 IS NOT NULL THEN list_avg(list_transform(list(tp) " + over(14) + ", lambda v: abs(v - tp14))) END AS mad14"],
        ["2 * (dif - dea) AS macd", "3 * kdj_k - 2 * kdj_d AS kdj_j", "CASE WHEN s_up + s_down > 0 THEN 100 * abs(100 * s_up / nullif(atr, 0) - 100 * s_down / nullif(atr, 0)) / nullif(100 * s_up / nullif(atr, 0) + 100 * s_down / nullif(atr, 0), 0) ELSE 0 END AS dx"],
        [f"{lag('macd')} < {lag('macd', 2)} AND {lag('macd')} < macd AS trough", f"{lag('macd')} AS macd1", f"{lag('macd', 2)} AS macd2", smooth("coalesce(dx, 0)", "(1.0/14)") + " AS adx0", f"{roll('min', lo, 5)} AS low5", f"{roll('min', 'macd', 5)} AS bar5"],
        ["CASE WHEN trough THEN dif END AS trough_dif"],
        [f"last_value(trough_dif IGNORE NULLS) {SO_FAR} AS known_dif"],
        ["CASE WHEN l14 > 1e-12 THEN 100 - 100 / (1 + g14 / l14) WHEN g14 > 1e-12 THEN 100 ELSE 0 END AS rsi", "coalesce((tp - tp14) / nullif(0.015 * mad14, 0), 0) AS cci", "coalesce(force_index_smoothed, 0) AS force_index",
         f"({c} - vwap) / nullif(vwap, 0) AS close_to_vwap_ratio", "coalesce(100 - 100 / (1 + p14 / nullif(n14, 0)), 50) AS mfi", "coalesce((positive_flow - negative_flow) / nullif(amount_x, 0), 0) AS big_order_ratio",
         f"CASE WHEN trough AND dif > {lag('known_dif')} THEN 1.0 ELSE 0 END AS macd_air_refuel", f"CASE WHEN {lo} < {lag('low5')} AND NOT coalesce(macd < {lag('bar5')}, false) THEN 1.0 ELSE 0 END AS macd_divergence",
         f"CASE WHEN vol > 1.5 * {roll('avg', 'vol', 20)} THEN 1.0 ELSE 0 END AS vol_breakout", f"coalesce({dev('ret', 20)} * sqrt(252), 0) AS volatility_20d", f"coalesce(-(px / nullif({lag('px', 5)}, 0) - 1), 0) AS reversal_5d",
         f"coalesce(({h} - {lo}) / nullif({c}, 0), 0) AS high_low_spread", "coalesce(adx0, 0) AS adx"],
    ]


TECHNICAL = "dif dea macd kdj_k kdj_d kdj_j rsi cci raw_force_index force_index_smoothed force_index vwap close_to_vwap_ratio positive_flow negative_flow mfi big_order_ratio macd_air_refuel macd_divergence vol_breakout volatility_20d reversal_5d high_low_spread adx".split()


def technical() -> tuple[list, list]:
    return _technical(), TECHNICAL


def legacy() -> tuple[list, list]:
    """The earlier definitions on raw prices: the looser second push, the label from the row's own price."""
    steps = _technical("open", "high", "low", "close_x")
    push = "CASE WHEN dif > dea AND macd > macd1 AND (macd1 <= 0 OR macd1 - macd2 < 0) THEN 1.0 ELSE 0 END"
    names = [n for n in TECHNICAL if n not in ("adx", "macd_air_refuel")]
    made = [f"{n} AS {n}_raw" for n in names] + [f"{push} AS macd_air_refuel_raw", f"lead(close_x, 5) {AT} / nullif(close_x, 0) - 1 AS label_raw"]
    return [*steps, made], [*(f"{n}_raw" for n in names), "label_raw", "macd_air_refuel_raw"]


def _momentum(x: str = "px") -> str:
    return f"coalesce((1 + ({x} / nullif({lag(x, 252)}, 0) - 1)) / (1 + coalesce({x} / nullif({lag(x, 21)}, 0) - 1, 0)) - 1, 0)"


def size_value() -> tuple[list, list]:
    return [
        [_PX], [_RET, f"{_momentum()} AS momentum_12_1"],
        ["coalesce(-ln(CASE WHEN circ_mv > 0 THEN circ_mv END), 0) AS size_factor", "coalesce(1 / nullif(pb, 0), 0) AS value_factor", "-asset_growth_yoy AS cma_factor", f"coalesce({dev('ret', 20)} * sqrt(252), 0) AS vol20"],
        ["size_factor * size_factor AS smb_squared", "size_factor * momentum_12_1 AS smb_mom", "size_factor * size_factor * momentum_12_1 AS smb_squared_mom", "value_factor * roe_ttm AS hml_rmw", "size_factor * value_factor AS smb_hml", "vol20 * momentum_12_1 AS vol_mom"],
    ], "size_factor value_factor cma_factor momentum_12_1 smb_squared smb_mom smb_squared_mom hml_rmw smb_hml vol_mom".split()


def margin_lists() -> tuple[list, list]:
    return [[f"coalesce(rzye / nullif({lag('rzye', 5)}, 0) - 1, 0) AS mtm_margin_balance_change", f"coalesce({roll('sum', 'net_amount', 5)} / nullif(circ_mv, 0), 0) AS lhb_strength_5d"]], ["mtm_margin_balance_change", "lhb_strength_5d"]


def momentum() -> tuple[list, list]:
    return [
        [*_BASIC, "abs(close_hfq - open_hfq) AS body", "high_hfq / nullif(low_hfq, 0) - 1 AS amp", f"{lag('close_hfq')} AS before"],
        [_RET, f"pv / nullif({lag('pv')}, 0) - 1 AS vret", "CASE WHEN high_hfq - greatest(open_hfq, close_hfq) > 3 * body OR least(open_hfq, close_hfq) - low_hfq > 3 * body THEN 1.0 ELSE 0 END AS shadow",
         "CASE WHEN coalesce(body / nullif(high_hfq - low_hfq, 0), 0) < 0.2 THEN 1.0 ELSE 0 END AS doji", "turnover_rate_x / CASE WHEN abs(amp) > 1e-12 THEN amp END AS busy", "(high_hfq - close_hfq) / nullif(high_hfq, 0) AS fall",
         "abs(open_hfq - before) / nullif(before, 0) AS gap", "CASE WHEN dc > 0 THEN 1.0 ELSE 0 END AS is_up"],
        [*(f"coalesce(px / nullif({lag('px', n)}, 0) - 1, 0) AS ret_{n}d" for n in (10, 20, 60)), f"coalesce(close_hfq / nullif({roll('max', 'close_hfq', 252, 20)}, 0) - 1, 0) AS dist_52w_high", f"coalesce(close_hfq / nullif({roll('avg', 'close_hfq', 20, 5)}, 0) - 1, 0) AS close_ma20_ratio",
         f"coalesce({roll('avg', 'is_up', 20, 5)}, 0) AS up_day_ratio_20", f"coalesce({pairs('corr', 'ret', 'vret', 20, 10)}, 0) AS vol_price_corr_20d", f"coalesce({roll('avg', 'busy', 20, 10)}, 0) AS turnover_amplitude_ratio", f"coalesce({roll('avg', 'shadow', 20, 10)}, 0) AS long_shadow_freq",
         f"coalesce({roll('avg', 'doji', 20, 10)}, 0) AS doji_freq", f"coalesce({roll('avg', 'fall', 20, 10)}, 0) AS intraday_drawdown", f"coalesce({roll('avg', 'gap', 20, 10)} / CASE WHEN {roll('avg', 'amp', 20, 10)} > 1e-12 THEN {roll('avg', 'amp', 20, 10)} END, 0) AS gap_vs_range_ratio"],
    ], "ret_10d ret_20d ret_60d dist_52w_high close_ma20_ratio up_day_ratio_20 vol_price_corr_20d turnover_amplitude_ratio long_shadow_freq doji_freq intraday_drawdown gap_vs_range_ratio".split()


def poly_shape() -> tuple[list, list]:
    """Least squares by the normal equations of y = a2 t^2 + a1 t + a0, t = 0..5: with centred squares, as a regression on t and the part of t^2 that t doesn't explain."""
    y = lambda x: [f"({lag(x, 5 - t)})" if t < 5 else x for t in range(6)]
    # t^2 less its regression on t (slope 5, intercept -10/3); its squares sum to 112/3
    q = [t * t - 5 * t + 10 / 3 for t in range(6)]
    a2 = lambda v: "(" + " + ".join(f"({w!r}) * {u}" for w, u in zip(q, v, strict=True)) + f") / {112 / 3!r}"
    slope = lambda v: "(" + " + ".join(f"({t - 2.5}) * {u}" for t, u in enumerate(v)) + ") / 17.5"
    p = [f"({u} / nullif({lag('close_hfq', 5)}, 0) - 1)" for u in y("close_hfq")]
    return [
        [f"coalesce(vol / nullif({roll('avg', 'vol', 20, 10)}, 0), 1) AS rel"],
        [f"coalesce({a2(p)}, 0) AS poly_close_a2", f"coalesce({slope(p)} - 5 * {a2(p)}, 0) AS poly_close_a1", f"coalesce({a2(y('rel'))}, 0) AS poly_vol_a2", f"coalesce({slope(y('rel'))} - 5 * {a2(y('rel'))}, 0) AS poly_vol_a1"],
    ], ["poly_close_a1", "poly_close_a2", "poly_vol_a1", "poly_vol_a2"]


def time_changes() -> tuple[list, list]:
    names = "kdj_k kdj_d kdj_j rsi macd adx volatility_20d turnover_rate_x reversal_5d momentum_12_1 rzye".split()
    made = {f"{n}_chg_{p}d": f"coalesce({n} - {lag(n, p)}, 0)" for n in names for p in (5, 10)}
    return [*_technical(), [f"{_momentum()} AS momentum_12_1"], [f"{e} AS {n}" for n, e in made.items()]], list(made)


def alpha101() -> tuple[list, list]:
    c, o, h, lo, v = "close_hfq", "open_hfq", "high_hfq", "low_hfq", "vol"
    turn = lambda n: f"CASE WHEN min_{n} > 0 THEN dc WHEN max_{n} < 0 THEN dc ELSE -dc END"
    r = lambda name, e: f"{rank(e)} AS {name}"
    a = [
        _BASIC,
        [_RET, f"{roll('avg', v, 20)} AS adv", f"{v} - {lag(v)} AS dv", f"{v} - {lag(v, 3)} AS dv3", f"ln(CASE WHEN {v} > 0 THEN {v} END) - ln(CASE WHEN {lag(v, 2)} > 0 THEN {lag(v, 2)} END) AS dlv", f"({c} - {o}) / nullif({o}, 0) AS co", f"{c} - {lag(c, 7)} AS c7", f"vwap - {c} AS gap", f"{c} - vwap AS over_vwap",
         f"{roll('min', 'dc', 5)} AS min_5", f"{roll('max', 'dc', 5)} AS max_5", f"{roll('min', 'dc', 4)} AS min_4", f"{roll('max', 'dc', 4)} AS max_4", f"dc - {lag('dc')} AS ddc", f"{roll('avg', 'vwap', 10)} AS vwap10", f"(({c} - {lo}) - ({h} - {c})) / CASE WHEN abs({c} - {lo}) > 1e-12 THEN {c} - {lo} END AS shape",
         r("ro", o), r("rv", v), r("rl", lo), r("rc", c), r("rh", h), r("r_ov", f"({o} / nullif({c}, 0) - 1)"), f"{roll('min', lo, 5)} AS low5", f"{roll('sum', o, 5)} AS o5", f"{pairs('corr', o, v, 10)} AS cov10", f"{pairs('corr', h, v, 5)} AS chv5", f"{pairs('corr', c, o, 10)} AS cco10", f"abs({c} - {o}) AS body",
         f"{dev(c, 20)} AS dev_c20", f"{o} - {lag(h)} AS oh", f"{o} - {lag(c)} AS oc", f"{o} - {lag(lo)} AS ol"],
        [f"{dev('ret', 20)} AS dev20", f"{dev('ret', 2)} AS dev2", f"{dev('ret', 5)} AS dev5", f"ret - {lag('ret', 3)} AS dret3", *(f"{roll('sum', 'ret', n)} AS ret{n}" for n in (5, 20, 240, 250)), r("r_dlv", "dlv"), r("r_co", "co"), r("r_ov10", "(open_hfq - vwap10)"), r("r_cv", "over_vwap"), f"{newest_rank('rl', 9)} AS tr_l9", f"abs(c7) AS ac7",
         f"{turn(5)} AS turn5", f"{turn(4)} AS turn4", f"{roll('max', 'gap', 3)} AS gmax", f"{roll('min', 'gap', 3)} AS gmin", r("r_dv3", "dv3"), f"{pairs('cov', 'rc', 'rv', 5)} AS cov_cv", f"{pairs('cov', 'rh', 'rv', 5)} AS cov_hv", f"{pairs('corr', 'rh', 'rv', 3)} AS cor_hv3", f"{newest_rank(c, 10)} AS tr_c10",
         r("r_ddc", "ddc"), r("r_va", f"({v} / nullif(adv, 0))"), f"{dev('body', 5)} AS dev_body", r("r_oh", "oh"), r("r_oc", "oc"), r("r_ol", "ol"), r("r_dev_c20", "dev_c20"), r("r_dc", "dc"), f"{newest_rank(v, 5)} AS tr_v5", f"{first_max(c, 30)} AS am30"],
        ["CASE WHEN ret < 0 THEN dev20 ELSE close_hfq END AS cond", "o5 * ret5 AS prod5", f"{pairs('corr', 'r_dlv', 'r_co', 6)} AS c2", f"{newest_rank('ac7', 60)} AS tr_ac7", r("r_turn4", "turn4"), r("r_gmax", "gmax"), r("r_gmin", "gmin"), r("r_cov_cv", "cov_cv"), r("r_cov_hv", "cov_hv"), r("r_cor_hv3", "cor_hv3"), r("r_dret3", "dret3"),
         r("r_trc10", "tr_c10"), f"{newest_rank('r_va', 5)} AS tr_va5", r("r_18", "(dev_body + (close_hfq - open_hfq) + cco10)"), r("r_250", "ret250"), r("r_25", "(-ret * adv * vwap * (high_hfq - close_hfq))"), r("r_dev", "(dev2 / nullif(dev5, 0))"), r("r_220", "((ret240 - ret20) / 220)"), r("r_am30", "am30"), f"{pairs('corr', 'ro', 'rv', 10)} AS c3"],
        ["sign(cond) * cond * cond AS power", f"prod5 - {lag('prod5', 10)} AS dprod", r("r_34", "((1 - r_dev) + (1 - r_dc))"), smooth("r_am30", "(2.0/3)") + " AS decay", f"{roll('sum', 'r_cor_hv3', 3)} AS s15"],
        [f"{first_max('power', 5)} AS am5", r("r_dprod", "dprod")],
        [r("r_am5", "am5")],
    ]
    made = {
        1: "coalesce(r_am5 - 0.5, 0.5)", 2: "coalesce(-c2, 0)", 3: "coalesce(-c3, 0)", 4: "coalesce(-tr_l9, 0.5)", 5: "coalesce(r_ov10 * -abs(r_cv), 0)", 6: "coalesce(-cov10, 0)", 7: "coalesce(CASE WHEN adv < vol THEN -tr_ac7 * sign(c7) ELSE -1 END, -1)",
        8: "coalesce(-r_dprod, 0)", 9: "coalesce(turn5, 0)", 10: "coalesce(r_turn4, 0.5)", 11: "coalesce((r_gmax + r_gmin) * r_dv3, 0)", 12: "coalesce(sign(dv) * -dc, 0)", 13: "coalesce(-r_cov_cv, 0)", 14: "coalesce(-r_dret3 * cov10, 0)", 15: "coalesce(-s15, 0)",
        16: "coalesce(-r_cov_hv, 0)", 17: "coalesce(-r_trc10 * r_ddc * tr_va5, 0)", 18: "coalesce(-r_18, 0)", 19: "coalesce(sign(c7) * (1 + r_250) - sign(c7) * rc, 0)", 20: "coalesce(-r_oh * r_oc * r_ol, 0)", 22: f"coalesce(-(chv5 - {lag('chv5', 5)}) * r_dev_c20, 0)",
        23: f"coalesce(CASE WHEN {roll('avg', 'high_hfq', 20)} < high_hfq THEN -(high_hfq - {lag('high_hfq', 2)}) ELSE 0 END, 0)", 25: "coalesce(r_25, 0.5)", 33: "coalesce(r_ov, 0.5)", 34: "coalesce(r_34, 0.5)", 41: "coalesce(sqrt(high_hfq * low_hfq) - vwap, 0)",
        52: f"coalesce(({lag('low5', 5)} - low5) * r_220 * tr_v5, 0)", 53: f"coalesce(-(shape - {lag('shape', 9)}), 0)", 54: "coalesce(-(low_hfq - close_hfq) * pow(open_hfq, 5) / CASE WHEN high_hfq - low_hfq > 1e-12 THEN (low_hfq - high_hfq) * pow(close_hfq, 5) END, 0)",
        57: "coalesce(-(close_hfq - vwap) / nullif(decay, 0), 0)", 101: "coalesce((close_hfq - open_hfq) / (high_hfq - low_hfq + 0.001), 0)",
    }
    return [*a, [f"{e} AS alpha101_{k}" for k, e in made.items()]], [f"alpha101_{k}" for k in made]


def risk(long: int, rsrs_rows: int) -> tuple[list, list]:
    run = lambda test, stop: f"(CASE WHEN {test} THEN count(*) FILTER ({test}) OVER (PARTITION BY entity, {stop} ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) ELSE 0 END)"
    windows = (21, 42, 63, 126, 252)
    xx, yy = "(CASE WHEN low_hfq IS NOT NULL THEN high_hfq END)", "(CASE WHEN high_hfq IS NOT NULL THEN low_hfq END)"
    sharpe = lambda n, p: f"coalesce({roll('avg', 'ret', n)} / CASE WHEN {dev('ret', n)} > 1e-12 THEN pow({dev('ret', n)}, {p}) END, 0)"
    return [
        [_PX, "(close_hfq - open_hfq) / CASE WHEN high_hfq - low_hfq > 1e-12 THEN high_hfq - low_hfq END AS ratio", f"{roll('avg', 'close_hfq', 21)} AS mid", f"{dev('close_hfq', 21)} AS wide",
         f"CASE WHEN count(*) {over(18)} >= 18 AND count({xx}) {over(18)} >= 2 AND stddev_pop({xx}) {over(18)} > 1e-9 THEN regr_slope({yy}, {xx}) {over(18)} END AS slope"],
        [_RET, "CASE WHEN close_hfq > mid + wide THEN 1.0 ELSE 0 END AS above", "CASE WHEN close_hfq < mid - wide THEN 1.0 ELSE 0 END AS below"],
        [f"count(*) FILTER (ret <= 0) {SO_FAR} AS up_stop", f"count(*) FILTER (ret >= 0) {SO_FAR} AS down_stop", f"product(1 + ret) {SO_FAR} AS nav"],
        ["coalesce(-ln(CASE WHEN total_mv > 0 THEN total_mv / 100 END), 0) AS size", "coalesce(-ln(CASE WHEN circ_mv > 0 THEN circ_mv / 100 END), 0) AS float_size", f"coalesce(-(px / nullif({lag('px', 21)}, 0) - 1) / nullif(circ_mv, 0), 0) AS small_cap_reversal_21d",
         "CASE WHEN close_hfq < 10 THEN ceil(close_hfq) - close_hfq WHEN close_hfq < 100 THEN ceil(close_hfq / 10) * 10 - close_hfq ELSE ceil(close_hfq / 100) * 100 - close_hfq END AS price_dist",
         *(f"coalesce(px / nullif({lag('px', n)}, 0) - 1, 0) AS return_{n}d" for n in (5, *windows)), f"coalesce({roll('avg', 'close_hfq', 20)}, 0) AS ma_20d", f"coalesce({roll('avg', 'ratio', 60)} / CASE WHEN {dev('ratio', 60)} > 1e-12 THEN {dev('ratio', 60)} END, 0) AS price_position_ir_60d",
         f"coalesce((slope - {roll('avg', 'slope', rsrs_rows)}) / nullif({dev('slope', rsrs_rows)}, 0), 0) AS rsrs", f"abs({run('ret > 0', 'up_stop')} - {run('ret < 0', 'down_stop')}) - 1.0 AS days_down_up",
         *(f"coalesce({dev('ret', n)}, 0) AS return_std_{n}d" for n in windows), f"{sharpe(60, 1)} AS sharpe_60d", f"{sharpe(long, 1)} AS sharpe_{long}d", f"{sharpe(long, 4)} AS adjusted_sharpe_{long}d",
         *(f"coalesce({roll('max', 'nav', n)} / nullif({roll('min', 'nav', n)}, 0), 1) AS high_low_{n}d" for n in windows),
         f"coalesce({roll('sum', 'above', 21)} - {roll('sum', 'below', 21)}, 0) AS days_beyond_upper_lower_21d", "coalesce(ln(CASE WHEN close_hfq > 0 THEN close_hfq END), 0) AS log_price"],
    ], f"size float_size small_cap_reversal_21d price_dist {' '.join(f'return_{n}d' for n in (5, *windows))} ma_20d price_position_ir_60d rsrs days_down_up {' '.join(f'return_std_{n}d' for n in windows)} sharpe_60d sharpe_{long}d adjusted_sharpe_{long}d {' '.join(f'high_low_{n}d' for n in windows)} days_beyond_upper_lower_21d log_price".split()


def liquidity(base: int, long: int) -> tuple[list, list]:
    t, made = "turnover_rate_x", {}
    for n in (5, 10, 20, 21, 42, 63, 126, 252):
        made[f"avg_turnover_{n}d"] = f"coalesce({roll('avg', t, n)}, 0)"
    for n in (21, 42, 63, 126, 252):
        made[f"std_turnover_{n}d"] = f"coalesce({dev(t, n)}, 0)"
    made |= {"amount_ma_20d": f"coalesce({roll('avg', 'amount_x', 20)}, 0)", "turnover_ma_20d": f"coalesce(-{roll('avg', 'rate', 20)}, 0)", "sum_abs_rtn_amount_20d": f"coalesce({roll('sum', 'move', 20)} / nullif({roll('sum', 'amount_x', 20)}, 0), 0)"}
    for m, spreads in ((base, (21,)), (long, (21, 42, 63, 126))):
        for n in (21, 42, 63, 126):
            made[f"bias_turn_{n}d_{m}d"] = f"coalesce({roll('avg', t, n)} / nullif({roll('avg', t, m)}, 0) - 1, 0)"
        for n in spreads:
            made[f"bias_std_turn_{n}d_{m}d"] = f"coalesce({dev(t, n)} / CASE WHEN {dev(t, m)} > 1e-12 THEN {dev(t, m)} END - 1, 0)"
    made["turnover_ma_20d_120d"] = f"coalesce({roll('avg', 'rate', 20)} / nullif({roll('avg', 'rate', 120)}, 0), 0)"
    return [[_PX, "vol / nullif(circ_mv, 0) AS rate"], [_RET], ["abs(ret) AS move"], [f"{e} AS {n}" for n, e in made.items()]], list(made)
