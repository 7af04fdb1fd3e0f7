"""The factor library: every factor is a formula over panel columns, by family.

Columns expected (those of an adjusted panel): open_hfq, high_hfq, low_hfq, close_hfq, close_x, vol,
amount_x, turnover_rate_x, circ_mv, total_mv, and for some families pb, rzye, net_amount and statement columns.
A family asks for its columns through `cols`, and a column that the panel lacks makes its factors the
constant 0, as documented for each. `fill` gives what stands where history is short.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelframe.functions import expr as X
from panelframe.functions.expr import Ex, absolute, ceil, col, corr, cov, delta, ewm, ffill, greatest, high, lag, lead, least, ln, low, mad, mean, pct, poly, prank, sign, signed_power, slope, sqrt, std, streak, total, ts_argmax, ts_rank, where

O, H, L, C, V = (col(x) for x in ("open_hfq", "high_hfq", "low_hfq", "close_hfq", "vol"))
AMOUNT, TURNOVER, CIRC, TOTAL = (col(x) for x in ("amount_x", "turnover_rate_x", "circ_mv", "total_mv"))
PX = ffill(C)
RET = pct(PX, 1)
VWAP = AMOUNT / V * 10


def flag(condition: Ex) -> Ex:
    return where(condition, 1.0, 0.0)


def label(period: int = 5) -> Ex:
    """Forward return of an entry at the next row: the row itself is never used."""
    return lead(PX, period + 1) / lead(PX, 1) - 1


def labels() -> dict[str, Ex]:
    return {"label": label(5), "label_1": label(1), "label_3": label(3), "label_10": label(10), "label_25": label(25)}


def span(n: int) -> float:
    return 2 / (n + 1)


def macd(fast: int = 12, slow: int = 26, signal: int = 9) -> dict[str, Ex]:
    dif = ewm(PX, span(fast)) - ewm(PX, span(slow))
    dea = ewm(dif, span(signal))
    return {"dif": dif, "dea": dea, "macd": 2 * (dif - dea)}


def kdj(n: int = 9, k: int = 3, d: int = 3) -> dict[str, Ex]:
    lo, hi = low(L, n, 1), high(H, n, 1)
    rsv = where(hi.eq(lo), 50.0, (C - lo) / (hi - lo) * 100)
    kk = ewm(rsv, 1 / k)
    dd = ewm(kk, 1 / d)
    return {"kdj_k": kk, "kdj_d": dd, "kdj_j": 3 * kk - 2 * dd}


def rsi(n: int = 14) -> Ex:
    """Simple means of gains and losses; all gain is 100, flat or short history 0."""
    move = delta(C, 1)
    gain, loss = mean(where(X.not_null(move), greatest(move, 0.0)), n), mean(where(X.not_null(move), 0 - least(move, 0.0)), n)
    return where((loss > 1e-12), 100 - 100 / (1 + gain / loss), where(gain > 1e-12, 100.0, 0.0)).fill(0.0)


def cci(n: int = 14) -> Ex:
    tp = (H + L + C) / 3
    return ((tp - mean(tp, n)) / (0.015 * mad(tp, n))).fill(0.0)


def force_index(window: int = 1) -> dict[str, Ex]:
    """unsmoothed (the last known value) unless the window is longer."""
    raw = V * delta(C, 1)
    smooth = ewm(raw, span(window)) if window > 1 else ffill(raw)
    return {"raw_force_index": raw, "force_index_smoothed": smooth, "force_index": smooth.fill(0.0)}


def money_flow(n: int = 14) -> dict[str, Ex]:
    flow, move = (H + L + C) / 3 * V, delta(C, 1)
    up, down = where(move >= 0, flow, 0.0), where(move < 0, flow, 0.0)
    ratio = total(up, n) / where(total(down, n) > 0, total(down, n))
    return {"positive_flow": up, "negative_flow": down, "mfi": (100 - 100 / (1 + ratio)).fill(50.0), "big_order_ratio": ((up - down) / AMOUNT).fill(0.0)}


def macd_signals(window: int = 5) -> dict[str, Ex]:
    m = macd()
    bar, dif = m["macd"], m["dif"]
    trough = (lag(bar, 1) < lag(bar, 2)) & (lag(bar, 1) < bar)
    before = lag(ffill(where(trough, dif)), 1)
    new_low = L < lag(low(L, window), 1)
    new_bar = bar < lag(low(bar, window), 1)
    return {"macd_air_refuel": flag(trough & (dif > before)), "macd_divergence": where(new_low, where(new_bar, 0.0, 1.0), 0.0)}


def adx(n: int = 14) -> Ex:
    before = lag(C, 1)
    tr = greatest(H - L, absolute(H - before), absolute(L - before))
    up, down = delta(H, 1), 0 - delta(L, 1)
    plus = where((up > down) & (up > 0), up, 0.0)
    minus = where((down > up) & (down > 0), down, 0.0)
    a = 1 / n
    atr = ewm(tr, a)
    p, m = 100 * ewm(plus, a) / atr, 100 * ewm(minus, a) / atr
    both = p + m
    return ewm(where(both > 0, 100 * absolute(p - m) / both).fill(0.0), a).fill(0.0)


def technical() -> dict[str, Ex]:
    """Indicators of prices and volume."""
    return {
        **macd(),
        **kdj(),
        "rsi": rsi(),
        "cci": cci(),
        **force_index(),
        "vwap": VWAP,
        "close_to_vwap_ratio": (C - VWAP) / VWAP,
        **money_flow(),
        **macd_signals(),
        "vol_breakout": flag(V > 1.5 * mean(V, 20)),
        "volatility_20d": (std(RET, 20) * 252**0.5).fill(0.0),
        "reversal_5d": (0 - pct(PX, 5)).fill(0.0),
        "high_low_spread": ((H - L) / C).fill(0.0),
        "adx": adx(),
    }


def size_value() -> dict[str, Ex]:
    """Size, value and their products; statement columns roe_ttm and asset_growth_yoy, and pb."""
    size, value, r252, r21 = (0 - ln(CIRC)).fill(0.0), (1 / col("pb")).fill(0.0), pct(PX, 252), pct(PX, 21)
    mom = ((1 + r252) / (1 + r21.fill(0.0)) - 1).fill(0.0)
    vol20 = (std(RET, 20) * 252**0.5).fill(0.0)
    return {
        "size_factor": size,
        "value_factor": value,
        "cma_factor": 0 - col("asset_growth_yoy"),
        "momentum_12_1": mom,
        "smb_squared": size * size,
        "smb_mom": size * mom,
        "smb_squared_mom": size * size * mom,
        "hml_rmw": value * col("roe_ttm"),
        "smb_hml": size * value,
        "vol_mom": vol20 * mom,
    }


def margin_and_lists() -> dict[str, Ex]:
    """change of the margin balance (unpadded) and net amounts of listed days over market value."""
    return {"mtm_margin_balance_change": pct(col("rzye"), 5).fill(0.0), "lhb_strength_5d": (total(col("net_amount"), 5) / CIRC).fill(0.0)}


def momentum() -> dict[str, Ex]:
    """Returns, distances and shapes of bars."""
    body, rng = absolute(C - O), H - L
    upper, lower = H - greatest(O, C), least(O, C) - L
    long_shadow = flag((upper > body * 3) | (lower > body * 3))
    doji = flag((body / rng).fill(0.0) < 0.2)
    amplitude = H / L - 1
    amplitude = where(absolute(amplitude) > 1e-12, amplitude)
    before = lag(C, 1)
    return {
        **{f"ret_{n}d": pct(PX, n).fill(0.0) for n in (10, 20, 60)},
        "dist_52w_high": (C / high(C, 252, 20) - 1).fill(0.0),
        "close_ma20_ratio": (C / mean(C, 20, 5) - 1).fill(0.0),
        "up_day_ratio_20": mean(flag(delta(C, 1) > 0), 20, 5).fill(0.0),
        "vol_price_corr_20d": corr(RET, pct(ffill(V), 1), 20, 10).fill(0.0),
        "turnover_amplitude_ratio": mean(TURNOVER / amplitude, 20, 10).fill(0.0),
        "long_shadow_freq": mean(long_shadow, 20, 10).fill(0.0),
        "doji_freq": mean(doji, 20, 10).fill(0.0),
        "intraday_drawdown": mean((H - C) / H, 20, 10).fill(0.0),
        "gap_vs_range_ratio": where(mean(H / L - 1, 20, 10) > 1e-12, mean(absolute(O - before) / before, 20, 10) / mean(H / L - 1, 20, 10)).fill(0.0),
    }


# Least-squares weights of a parabola over six points, times 56 and 280.
A2, A1 = (5, -1, -4, -4, -1, 5), (-165, 1, 92, 108, 49, -85)


def poly_shape() -> dict[str, Ex]:
    """parabola through the last six rebased prices and six relative volumes."""
    back = lambda x: [*(lag(x, k) for k in (5, 4, 3, 2, 1)), x]
    start = lag(C, 5)
    rel = (V / mean(V, 20, 10)).fill(1.0)
    prices, volumes = [x / start - 1 for x in back(C)], back(rel)
    return {
        "poly_close_a1": (poly(prices, A1) / 280).fill(0.0),
        "poly_close_a2": (poly(prices, A2) / 56).fill(0.0),
        "poly_vol_a1": (poly(volumes, A1) / 280).fill(0.0),
        "poly_vol_a2": (poly(volumes, A2) / 56).fill(0.0),
    }


CHANGED = ("kdj_k", "kdj_d", "kdj_j", "rsi", "macd", "adx", "volatility_20d", "turnover_rate_x", "reversal_5d", "momentum_12_1", "rzye")


def time_changes(factors: dict[str, Ex], names: Sequence[str] = CHANGED, periods: Sequence[int] = (5, 10)) -> dict[str, Ex]:
    """differences of factors over rows; names without a factor are skipped."""
    return {f"{n}_chg_{p}d": delta(factors[n], p).fill(0.0) for n in names if n in factors for p in periods}


def alpha101(rank: Callable[[Ex], Ex] = prank) -> dict[str, Ex]:
    """A01-A31. rank is the percentile rank in the entity's whole history (later rows change it), or X.x_rank within the date."""
    R, c1 = rank, delta(C, 1)
    adv20 = mean(V, 20)
    s1 = total(O, 5) * total(RET, 5)
    move = lambda n: where(low(c1, n) > 0, c1, where(high(c1, n) < 0, c1, 0 - c1))
    c7 = delta(C, 7)
    gap = VWAP - C
    shape = (C - L - (H - C)) / where(absolute(C - L) > 1e-12, C - L)
    l5 = low(L, 5)
    return {
        "alpha101_1": (R(ts_argmax(signed_power(where(RET < 0, std(RET, 20), C), 2), 5)) - 0.5).fill(0.5),
        "alpha101_2": (0 - corr(R(delta(ln(V), 2)), R((C - O) / O), 6)).fill(0.0),
        "alpha101_3": (0 - corr(R(O), R(V), 10)).fill(0.0),
        "alpha101_4": (0 - ts_rank(R(L), 9)).fill(0.5),
        "alpha101_5": (R(O - mean(VWAP, 10)) * (0 - absolute(R(C - VWAP)))).fill(0.0),
        "alpha101_6": (0 - corr(O, V, 10)).fill(0.0),
        "alpha101_7": where(adv20 < V, (0 - ts_rank(absolute(c7), 60)) * sign(c7), -1.0).fill(-1.0),
        "alpha101_8": (0 - R(s1 - lag(s1, 10))).fill(0.0),
        "alpha101_9": move(5).fill(0.0),
        "alpha101_10": R(move(4)).fill(0.5),
        "alpha101_11": ((R(high(gap, 3)) + R(low(gap, 3))) * R(delta(V, 3))).fill(0.0),
        "alpha101_12": (sign(delta(V, 1)) * (0 - c1)).fill(0.0),
        "alpha101_13": (0 - R(cov(R(C), R(V), 5))).fill(0.0),
        "alpha101_14": ((0 - R(delta(RET, 3))) * corr(O, V, 10)).fill(0.0),
        "alpha101_15": (0 - total(R(corr(R(H), R(V), 3)), 3)).fill(0.0),
        "alpha101_16": (0 - R(cov(R(H), R(V), 5))).fill(0.0),
        "alpha101_17": ((0 - R(ts_rank(C, 10))) * R(delta(c1, 1)) * ts_rank(R(V / adv20), 5)).fill(0.0),
        "alpha101_18": (0 - R(std(absolute(C - O), 5) + (C - O) + corr(C, O, 10))).fill(0.0),
        "alpha101_19": (sign(C - lag(C, 7)) * (1 + R(total(RET, 250))) - sign(c7) * R(C)).fill(0.0),
        "alpha101_20": ((0 - R(O - lag(H, 1))) * R(O - lag(C, 1)) * R(O - lag(L, 1))).fill(0.0),
        "alpha101_22": ((0 - delta(corr(H, V, 5), 5)) * R(std(C, 20))).fill(0.0),
        "alpha101_23": where(mean(H, 20) < H, 0 - delta(H, 2), 0.0).fill(0.0),
        "alpha101_25": R((0 - RET) * adv20 * VWAP * (H - C)).fill(0.5),
        "alpha101_33": R(O / C - 1).fill(0.5),
        "alpha101_34": R((1 - R(std(RET, 2) / std(RET, 5))) + (1 - R(c1))).fill(0.5),
        "alpha101_41": sqrt(H * L) - VWAP,
        "alpha101_52": ((lag(l5, 5) - l5) * R((total(RET, 240) - total(RET, 20)) / 220) * ts_rank(V, 5)).fill(0.0),
        "alpha101_53": (0 - delta(shape, 9)).fill(0.0),
        "alpha101_54": ((0 - (L - C) * O**5) / where(H - L > 1e-12, (L - H) * C**5)).fill(0.0),
        "alpha101_57": ((0 - (C - VWAP)) / ewm(R(ts_argmax(C, 30)), span(2))).fill(0.0),
        "alpha101_101": ((C - O) / (H - L + 0.001)).fill(0.0),
    }


def price_distance(x: Ex = C, window: int | None = None) -> Ex:
    """Up to the next 1, 10 or 100 by price band; its mean over the window, if there is one."""
    step = where(x < 10, 1.0, where(x < 100, 10.0, 100.0))
    up = ceil(x / step) * step - x
    return up if window is None else mean(up, window)


def rsrs(n: int = 18, m: int = 200) -> Ex:
    """Slope of low on high over n rows, standardised over m."""
    s = slope(L, H, n)
    return ((s - mean(s, m)) / std(s, m)).fill(0.0)


def risk(nav_windows: Sequence[int] = (21, 42, 63, 126, 252), long: int = 750, rsrs_rows: int = 200) -> dict[str, Ex]:
    """Size, reversal, momentum and risk."""
    ratio = (C - O) / where(H - L > 1e-12, H - L)
    sharpe = lambda n, p=1: where(std(RET, n) > 1e-12, mean(RET, n) / std(RET, n) ** p).fill(0.0)
    upper, lower = flag(mean(C, 21) + std(C, 21) < C), flag(mean(C, 21) - std(C, 21) > C)
    up, down = streak(RET > 0, RET <= 0), streak(RET < 0, RET >= 0)
    nav = {f"high_low_{n}d": where(X.not_null(total(RET, n)), high(PX, n) / low(PX, n)).fill(1.0) for n in nav_windows}
    return {
        "size": (0 - ln(TOTAL / 100)).fill(0.0),
        "float_size": (0 - ln(CIRC / 100)).fill(0.0),
        "small_cap_reversal_21d": ((0 - pct(PX, 21)) / CIRC).fill(0.0),
        "price_dist": price_distance(),
        **{f"return_{n}d": pct(PX, n).fill(0.0) for n in (5, 21, 42, 63, 126, 252)},
        "ma_20d": mean(C, 20).fill(0.0),
        "price_position_ir_60d": where(std(ratio, 60) > 1e-12, mean(ratio, 60) / std(ratio, 60)).fill(0.0),
        "rsrs": rsrs(18, rsrs_rows),
        "days_down_up": absolute(up - down) - 1,
        **{f"return_std_{n}d": std(RET, n).fill(0.0) for n in (21, 42, 63, 126, 252)},
        "sharpe_60d": sharpe(60),
        f"sharpe_{long}d": sharpe(long),
        f"adjusted_sharpe_{long}d": sharpe(long, 4),
        **nav,
        "days_beyond_upper_lower_21d": (total(upper, 21) - total(lower, 21)).fill(0.0),
        "log_price": ln(C).fill(0.0),
    }


def liquidity(base: int = 252, long: int = 504) -> dict[str, Ex]:
    """Turnover and amounts; windows of the biases over `base` and `long` rows."""
    t = TURNOVER
    rate = V / CIRC
    bias = lambda f, n, m: (f(t, n) / f(t, m) - 1).fill(0.0)
    spread = lambda n, m: (std(t, n) / where(std(t, m) > 1e-12, std(t, m)) - 1).fill(0.0)
    return {
        **{f"avg_turnover_{n}d": mean(t, n).fill(0.0) for n in (5, 10, 20, 21, 42, 63, 126, 252)},
        **{f"std_turnover_{n}d": std(t, n).fill(0.0) for n in (21, 42, 63, 126, 252)},
        "amount_ma_20d": mean(AMOUNT, 20).fill(0.0),
        "turnover_ma_20d": (0 - mean(rate, 20)).fill(0.0),
        "sum_abs_rtn_amount_20d": (total(absolute(RET), 20) / total(AMOUNT, 20)).fill(0.0),
        **{f"bias_turn_{n}d_{base}d": bias(mean, n, base) for n in (21, 42, 63, 126)},
        f"bias_std_turn_21d_{base}d": spread(21, base),
        **{f"bias_turn_{n}d_{long}d": bias(mean, n, long) for n in (21, 42, 63, 126)},
        **{f"bias_std_turn_{n}d_{long}d": spread(n, long) for n in (21, 42, 63, 126)},
        "turnover_ma_20d_120d": (mean(rate, 20) / mean(rate, 120)).fill(0.0),
    }


def quality(year: int = 252, quarter: int = 63) -> dict[str, Ex]:
    """R03-R07, Q01-Q20 over statement columns joined as of the date; growth against the value `year` or `quarter` rows back."""
    k = col
    growth = lambda x, n: where(absolute(lag(x, n)) > 1e-12, (x - lag(x, n)) / absolute(lag(x, n))).fill(0.0)
    margin = k("n_income") / k("total_revenue")
    value = TOTAL * 1e4
    return {
        "earnings_to_price": (k("eps") / k("close_x")).fill(0.0),
        "book_to_market": (k("equity") / value).fill(0.0),
        "ocf_to_market": (k("n_cashflow_act") / value).fill(0.0),
        "fcf_to_market": (k("free_cashflow") / value).fill(0.0),
        "sales_to_market": (k("total_revenue") / value).fill(0.0),
        "q_roe_ttm": k("roe_ttm").fill(0.0),
        "roa_ttm": (k("n_income") / k("total_assets")).fill(0.0),
        "q_gross_margin": k("gross_margin").fill(0.0),
        "net_margin": margin.fill(0.0),
        "debt_to_assets": k("debt_ratio").fill(0.0),
        "current_ratio": (k("total_cur_assets") / k("total_cur_liab")).fill(0.0),
        "quick_ratio": ((k("total_cur_assets") - k("inventories")) / k("total_cur_liab")).fill(0.0),
        "cash_flow_to_debt": (k("n_cashflow_act") / k("total_liab")).fill(0.0),
        "q_accruals": k("accruals").fill(0.0),
        "earnings_quality": (k("n_cashflow_act") / k("n_income")).fill(0.0),
        "q_revenue_growth_yoy": k("revenue_growth_yoy").fill(0.0),
        "q_profit_growth_yoy": k("profit_growth_yoy").fill(0.0),
        "q_asset_growth_yoy": k("asset_growth_yoy").fill(0.0),
        "roe_growth_yoy": growth(k("roe_ttm"), year),
        "eps_growth_yoy": growth(k("eps"), year),
        "revenue_growth_qoq": growth(k("total_revenue"), quarter),
        "profit_growth_qoq": growth(k("n_income"), quarter),
        "gross_margin_growth": growth(k("gross_margin"), year),
        "net_margin_growth": growth(margin, year),
        "ocf_growth_yoy": growth(k("n_cashflow_act"), year),
    }


RAW = {"open_hfq": "open", "high_hfq": "high", "low_hfq": "low", "close_hfq": "close_x"}


def on_raw(named: dict[str, Ex]) -> dict[str, Ex]:
    """The same formulas on unadjusted prices."""
    swap = lambda e: col(RAW.get(e.params[0], e.params[0])) if e.op == "col" else Ex(e.op, tuple(map(swap, e.args)), e.params)
    return {n: swap(e) for n, e in named.items()}


def legacy() -> dict[str, Ex]:
    """The earlier definitions, on unadjusted prices: the label of the row's own price, and the looser second push of the trend.

    The trend pushes again where the fast line is above the slow one, the bar is higher than the day before, and the day before
    was a pullback: its bar not above zero, or lower than the one before it. The others are those of the technical family.
    """
    m = macd()
    bar = m["macd"]
    push = (m["dif"] > m["dea"]) & (bar > lag(bar, 1)) & ((lag(bar, 1) <= 0) | (lag(bar, 1) - lag(bar, 2) < 0))
    now = {k: v for k, v in technical().items() if k not in ("adx", "macd_air_refuel")}
    return on_raw({**now, "label": lead(C, 5) / C - 1, "macd_air_refuel": flag(push)})


def columns_of(e: Ex) -> set[str]:
    return {e.params[0]} if e.op == "col" else set().union(*(columns_of(a) for a in e.args))


def add(df: DataFrame, factors: dict[str, Ex], only: Sequence[str] | None = None, entity: str = "entity", order: str = "d", digits: dict[str, int] | None = None) -> DataFrame:
    """df with the factors that it lacks (or `only` those); a factor whose columns df lacks is the constant 0."""
    have = set(df.columns)
    wanted = {n: e for n, e in factors.items() if n not in have and (only is None or n in only)}
    able = {n: e for n, e in wanted.items() if columns_of(e) <= have}
    return X.apply(df, able, entity, order, digits).withColumns({n: F.lit(0.0) for n in wanted if n not in able})


def lookback(e: Ex) -> int | None:
    """Rows before a row that its value may depend on; None: the whole history."""
    if e.op in ("prank", "ewm", "cum_sum", "cum_max", "cum_prod", "cum_count", "first", "run_sum", "ffill"):
        return None
    inner = [lookback(a) for a in e.args]
    if None in inner:
        return None
    own = {"lag": lambda p: p[0], "quantile": lambda p: p[1] - 1}.get(e.op, lambda p: p[0] - 1 if e.op in ("mean", "sum", "min", "max", "prod", "std", "corr", "cov", "slope", "mad", "ts_rank", "ts_argmax", "ts_argmin") else 0)
    return max(inner, default=0) + own(e.params)
