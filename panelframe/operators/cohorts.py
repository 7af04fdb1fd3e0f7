"""Cohort returns, trades and performance tables, set-based.

Every batch invests a fixed notional: results are those of independent cohorts, not of
capital that compounds from batch to batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelframe.functions import kernels as K
from panelframe.functions.kernels import TINY, div
from panelframe.operators.joins import asof, calendar_index, pairs_before
from panelframe.operators.relational import correlations


def rebalance_calendar(calendar: DataFrame, day: str, holding: int) -> DataFrame:
    """Signal rows every `holding` days, the entry the day after, the exit `holding` days after that. (signal, entry, exit)"""
    i = calendar_index(calendar, day)
    nxt = lambda k, name: i.select((F.col("idx") - k).alias("idx"), F.col(day).alias(name))
    return i.where((F.col("idx") - 1) % holding == 0).withColumnRenamed(day, "signal").join(nxt(1, "entry"), "idx").join(nxt(1 + holding, "exit"), "idx", "left").drop("idx")


def align(calendar: DataFrame, day: str, start, end) -> tuple:
    """First day at or after start, last at or before end; ValueError if there is none between."""
    row = calendar.where(F.col(day).between(start, end)).agg(F.min(day), F.max(day)).first()
    if row[0] is None:
        raise ValueError("no trading day in the range")
    return row[0], row[1]


def pick(scores: DataFrame, day: str, entity: str, score: str, n: int, capital: float = 1e6, min_score: float | None = None) -> DataFrame:
    """The n best names of each signal date with equal notional; dates whose best score is too low are left out."""
    s = scores.where(F.col(score).isNotNull())
    if min_score is not None:
        s = s.withColumn("\u0001top", F.max(score).over(Window.partitionBy(day))).where(F.col("\u0001top") >= min_score).drop("\u0001top")
    place = F.row_number().over(Window.partitionBy(day).orderBy(F.desc(score), entity))
    return s.withColumn("place", place).where(F.col("place") <= n).withColumn("notional", F.lit(capital / n))


def entries(picks: DataFrame, prices: DataFrame, entity: str, at: str, day: str, price: str, change: str, limit: float = 9.8, slip: float = 0.001, lot: int = 100) -> DataFrame:
    """Bought at the entry day's price plus slippage in whole lots; limit-up, unpriced and lot-less names are skipped."""
    p = prices.select(F.col(entity), F.col(day).alias(at), F.col(price).alias("raw_price"), F.col(change).alias("\u0001chg"))
    out = picks.join(p, [entity, at]).where((F.col("raw_price") > 0) & (F.coalesce("\u0001chg", F.lit(0.0)) < limit)).drop("\u0001chg")
    out = out.withColumn("buy_price", F.col("raw_price") * (1 + slip))
    return out.withColumn("shares", F.floor(F.col("notional") / F.col("buy_price") / lot) * lot).where("shares > 0")


def exits(bought: DataFrame, prices: DataFrame, entity: str, due: str, day: str, price: str, change: str, limit: float = -9.8, slip: float = 0.001, commission: float = 0.0003, stamp: float = 0.001) -> DataFrame:
    """Sold on the first tradable day at or after the due one (limit-down blocks), with costs."""
    ok = prices.where((F.col(price) > 0) & (F.coalesce(F.col(change), F.lit(0.0)) > limit))
    w = Window.partitionBy(entity).orderBy(F.desc("\u0001at"), F.desc("\u0001side")).rowsBetween(Window.unboundedPreceding, 0)
    p = ok.select(F.col(entity), F.col(day).alias("\u0001at"), F.lit(1).alias("\u0001side"), F.struct(F.col(day).alias("sell_date"), F.col(price).alias("p")).alias("\u0001s"))
    b = bought.withColumns({"\u0001at": F.col(due), "\u0001side": F.lit(0), "\u0001s": F.lit(None).cast(p.schema["\u0001s"].dataType), "\u0001own": F.lit(True)})
    out = b.unionByName(p, allowMissingColumns=True).withColumn("\u0001s", F.last("\u0001s", ignorenulls=True).over(w)).where(F.col("\u0001own"))
    out = out.select(*bought.columns, F.col("\u0001s.sell_date").alias("sell_date"), (F.col("\u0001s.p") * (1 - slip)).alias("sell_price"))
    amount = F.col("shares") * F.col("sell_price")
    return out.withColumns({"proceeds": amount * (1 - commission - stamp), "commission": amount * commission, "stamp": amount * stamp})


def marks(held: DataFrame, prices: DataFrame, calendar: DataFrame, entity: str, start: str, end: str, day: str, price: str) -> DataFrame:
    """Value of every position on every day it is held; the buy price where there is no price."""
    days = calendar.select(F.col(day)).distinct()
    span = held.withColumn(day, F.explode(F.sequence(F.col(start), F.col(end)))).join(F.broadcast(days), day)  # the calendar is bounded
    out = span.join(prices.select(entity, day, F.col(price).alias("\u0001p")), [entity, day], "left")
    return out.withColumn("value", F.col("shares") * F.coalesce("\u0001p", "buy_price")).drop("\u0001p")


def virtual_returns(picks: DataFrame, prices: DataFrame, calendar: DataFrame, day: str, entity: str, price: str, ahead: int = 6) -> DataFrame:
    """(idx, ret): for each signal date, by its calendar number, the mean return of its picks from the next date on to `ahead` dates after it."""
    i = calendar_index(calendar, day)
    p = prices.where(F.col(price).isNotNull()).join(i, day).select(entity, "idx", F.col(price).alias("\u0001price"))
    own = picks.join(i, day).select(entity, "idx")
    at = lambda k, name: p.select(entity, (F.col("idx") - k).alias("idx"), F.col("\u0001price").alias(name))
    return own.join(at(1, "\u0001buy"), [entity, "idx"]).join(at(ahead, "\u0001sell"), [entity, "idx"]).where(F.col("\u0001buy") > 0).groupBy("idx").agg(F.avg(F.col("\u0001sell") / F.col("\u0001buy") - 1).alias("ret"))


def virtual_stop(signals: DataFrame, virtual: DataFrame, calendar: DataFrame, day: str, ahead: int = 6, holding: int = 5, check: int = 3, bound: float = -0.05, least: int = 2) -> DataFrame:
    """(day, stop_day) for each real signal date: when its cohort, bought the date after, is given up early, or null.

    The `check` virtual cohorts picked last before the signal, of the signal dates ahead - 1 to ahead - check before it, end on the dates
    after it, one a date; as soon as `least` of them have lost more than the bound, before the holding time is over, the cohort is sold.
    """
    i = calendar_index(calendar, day)
    s = signals.select(day).distinct().join(i, day).withColumn("\u0001k", F.explode(F.sequence(F.lit(1), F.lit(check))))
    lost = s.join(virtual.select(F.col("idx").alias("\u0001at"), "ret"), F.col("\u0001at") == F.col("idx") - ahead + F.col("\u0001k")).where(F.col("ret") < bound)
    # the least-th of at most `check` losses, in order of their ends
    nth = lost.groupBy(day, "idx").agg(F.get(F.array_sort(F.collect_list("\u0001k")), F.lit(least - 1)).alias("\u0001k")).where(F.col("\u0001k").isNotNull() & (F.col("\u0001k") - 1 < holding))
    stops = nth.select(day, (F.col("idx") + F.col("\u0001k")).alias("idx")).join(i.withColumnRenamed(day, "stop_day"), "idx").select(day, "stop_day")
    return signals.select(day).distinct().join(stops, day, "left")


def cohort_returns(trades: DataFrame, batch: str, buy: str = "buy_price", sell: str = "sell_price") -> DataFrame:
    """Mean return of the priced names."""
    return trades.where((F.col(buy) > 0) & F.col(sell).isNotNull()).groupBy(batch).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(sell) / F.col(buy) - 1).alias("ret"))


def batch_profit(buys: DataFrame, sells: DataFrame, buy_day: str, sell_day: str, buy_amount: str, sell_amount: str) -> DataFrame:
    """Proceeds of the sells after a buy date up to and with the next one, over what was bought."""
    b = buys.groupBy(buy_day).agg(F.sum(buy_amount).alias("bought"))
    daily = sells.groupBy(sell_day).agg(F.sum(sell_amount).alias("sold"))  # a row a day: what follows is as long as the calendar
    keyed = asof(daily.withColumn("\u0001k", F.lit(0)), b.select(F.lit(0).alias("\u0001k"), F.col(buy_day), F.col(buy_day).alias("batch")), "\u0001k", sell_day, buy_day, ["batch"], strict=True)
    s = keyed.groupBy(F.col("batch").alias(buy_day)).agg(F.sum("sold").alias("sold"))
    return b.join(s, buy_day, "left").withColumn("profit", div(F.col("sold"), F.col("bought")) - 1)


def pair_trades(buys: DataFrame, sells: DataFrame, entity: str, day: str, price: str) -> DataFrame:
    """Every buy with the first sell of its entity at or after it, return and days held. A forward as-of: one sort by entity and day."""
    least = sells.groupBy(entity, day).agg(F.min(price).alias("\u0001price"))
    s = least.select(F.col(entity), F.col(day).alias("\u0001at"), F.lit(1).alias("\u0001side"), F.struct(F.col(day).alias("sell_date"), F.col("\u0001price").alias("sell_price")).alias("\u0001sold"))
    b = buys.withColumns({"\u0001at": F.col(day), "\u0001side": F.lit(0), "\u0001sold": F.lit(None).cast(s.schema["\u0001sold"].dataType), "\u0001own": F.lit(True)})
    w = Window.partitionBy(entity).orderBy(F.desc("\u0001at"), F.desc("\u0001side")).rowsBetween(Window.unboundedPreceding, 0)
    out = b.unionByName(s, allowMissingColumns=True).withColumn("\u0001sold", F.last("\u0001sold", ignorenulls=True).over(w)).where(F.col("\u0001own"))
    return out.select(*buys.columns, "\u0001sold.sell_date", "\u0001sold.sell_price").withColumns({"ret": F.col("sell_price") / F.col(price) - 1, "days": F.datediff("sell_date", day)})


def nav_metrics(nav: DataFrame, day: str, value: str, year: int = 252, trim: bool = False) -> DataFrame:
    """Total, annual, volatility, ratio, deepest drawdown with its dates, calmar, win rate of one value series."""
    w = Window.orderBy(day)
    d = nav.select(F.col(day).alias("d"), F.col(value).cast("double").alias("v")).withColumn("r", div(F.col("v"), F.lag("v").over(w)) - 1)
    if trim:
        active = F.min(F.when(F.abs("r") > 1e-9, F.col("d"))).over(Window.partitionBy())
        d = d.withColumn("\u0001a", active).where(F.col("d") >= F.date_sub(F.col("\u0001a"), 1)).drop("\u0001a")
    so_far = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"peak": F.max("v").over(so_far), "peak_at": F.max(F.struct("v", F.negate(F.unix_date("d")).alias("t"))).over(so_far)})
    d = d.withColumn("dd", F.col("v") / F.col("peak") - 1)
    s, n = F.stddev_samp("r"), F.count("r")
    total = F.max_by("v", "d") / F.min_by("v", "d") - 1
    out = d.agg(total.alias("total"), n.alias("n"), (s * year**0.5).alias("volatility"), (div(F.avg("r"), F.when(s > TINY, s)) * year**0.5).alias("sharpe"), F.min("dd").alias("max_drawdown"), F.min(F.struct("dd", "d", "peak_at")).alias("\u0001m"), F.avg(F.when(F.col("r").isNotNull(), (F.col("r") > 0).cast("double"))).alias("win_rate"))
    out = out.withColumn("annual", F.when(F.col("n") > 0, F.pow(1 + F.col("total"), F.lit(float(year)) / F.col("n")) - 1))
    return out.select("total", "annual", "volatility", "sharpe", "max_drawdown", F.date_from_unix_date(F.negate(F.col("\u0001m.peak_at.t"))).alias("peak_date"), F.col("\u0001m.d").alias("trough_date"), div(F.col("annual"), F.abs("max_drawdown")).alias("calmar"), "win_rate", "n")


def monthly(series: DataFrame, by: Sequence[str], day: str, value: str) -> DataFrame:
    """Last over first of each month."""
    return series.groupBy(*by, F.trunc(day, "month").alias("month")).agg((F.max_by(value, day) / F.min_by(value, day) - 1).alias("ret"))


def compare_picks(scored: DataFrame, day: str, entity: str, score: str, naive: str, label: str, n: int = 5) -> DataFrame:
    """By date, mean label of the model's n best, of the n best by a naive score, and of all."""
    place = lambda c: F.row_number().over(Window.partitionBy(day).orderBy(F.col(c).desc_nulls_last(), entity))
    r = scored.where(F.col(label).isNotNull()).withColumns({"\u0001m": place(score), "\u0001n": place(naive)})
    return r.groupBy(day).agg(F.avg(F.when(F.col("\u0001m") <= n, F.col(label))).alias("model"), F.avg(F.when(F.col("\u0001n") <= n, F.col(label))).alias("naive"), F.avg(label).alias("universe"))


def without_window(nav: DataFrame, day: str, value: str, start, end) -> DataFrame:
    """Return with the dates of a window left out: before and after, chained."""
    before, after = F.col(day) <= F.lit(start), F.col(day) >= F.lit(end)
    r = lambda c: F.max_by(F.when(c, F.col(value)), F.when(c, F.col(day))) / F.min_by(F.when(c, F.col(value)), F.when(c, F.col(day)))
    return nav.agg((F.coalesce(r(before), F.lit(1.0)) * F.coalesce(r(after), F.lit(1.0)) - 1).alias("ret"))


def survivors(panel: DataFrame, entity: str, day: str, early, late) -> DataFrame:
    """Entities of an early date that the late one lacks."""
    return panel.where(F.col(day) == F.lit(early)).select(entity).distinct().join(panel.where(F.col(day) == F.lit(late)).select(entity), entity, "left_anti")


def robustness(trades: DataFrame, ret: str, order: str, drops: Sequence[int] = (0, 5, 10, 20, 30)) -> DataFrame:
    """Mean, deviation, win rate and t after the best trades are left out. The best max(drops) are found first."""
    best = trades.where(F.col(ret).isNotNull()).orderBy(F.desc(ret), order).limit(max(drops)).select(order, F.row_number().over(Window.orderBy(F.desc(ret), order)).alias("\u0001p"))
    t = trades.where(F.col(ret).isNotNull()).join(F.broadcast(best), order, "left")  # max(drops) rows
    t = t.withColumn("dropped", F.explode(F.array(*map(F.lit, drops)))).where(F.col("\u0001p").isNull() | (F.col("\u0001p") > F.col("dropped")))
    s = F.stddev_samp(ret)
    return t.groupBy("dropped").agg(F.count(F.lit(1)).alias("n"), F.avg(ret).alias("mean"), s.alias("std"), F.avg((F.col(ret) > 0).cast("double")).alias("win"), (div(F.avg(ret), F.when(s > TINY, s)) * F.sqrt(F.count(F.lit(1)))).alias("t"))


def bootstrap(trades: DataFrame, ret: str, key: str, reps: int = 5000, seed: int = 7) -> DataFrame:
    """Percentile interval of the mean over replicates. A row's weight in a replicate is Poisson(1), drawn by hash, in place of n draws with
    replacement, whose counts tend to it: no replicate needs the number of rows. Weights beyond 16 have a probability of 1e-15 and count as 16.

    A task adds up its rows' weighted returns and weights for all replicates and sends two numbers a replicate."""
    cuts, p, acc = [], 2.718281828459045**-1, 0.0
    for k in range(1, 17):
        acc += p
        cuts.append(acc)
        p /= k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, total = spread(np.arange(reps, dtype=np.uint64) + np.uint64(1)), np.zeros((2, reps))
        for batch in batches:
            h, r = batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64), batch.column("r").to_numpy(zero_copy_only=False)
            for lo in range(0, len(h), 128):
                u = (spread(h[lo : lo + 128, None] ^ each[None, :]) >> np.uint64(11)) / 2.0**53
                w = np.searchsorted(cuts, u, "right").astype(float)
                total += np.stack([r[lo : lo + 128] @ w, w.sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(range(reps), pa.int32()), pa.array(total[0]), pa.array(total[1])], names=["rep", "s", "w"])

    def spread(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    rows = trades.where(F.col(ret).isNotNull()).select(F.xxhash64(F.col(key), F.lit(seed)).alias("h"), F.col(ret).cast("double").alias("r"))
    means = rows.mapInArrow(run, "rep int, s double, w double").groupBy("rep").agg(div(F.sum("s"), F.sum("w")).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"))


def log_share(nav: DataFrame, day: str, value: str, start, end) -> DataFrame:
    """Share of the log return that falls into a window."""
    inside = F.col(day).between(F.lit(start), F.lit(end))
    r = lambda c: F.ln(F.max_by(F.when(c, F.col(value)), F.when(c, F.col(day))) / F.min_by(F.when(c, F.col(value)), F.when(c, F.col(day))))
    return nav.agg(div(r(inside), r(F.lit(True))).alias("share"))


def participation(trades: DataFrame, market: DataFrame, keys: Sequence[str], amount: str, market_amount: str) -> DataFrame:
    """B25"""
    return trades.join(market.select(*keys, F.col(market_amount).alias("\u0001m")), list(keys), "left").withColumn("participation", div(F.col(amount), F.col("\u0001m"))).drop("\u0001m")


def tails(trades: DataFrame, day: str, ret: str, bound: float = 0.1) -> DataFrame:
    """B27"""
    return trades.groupBy(F.year(day).alias("year")).agg(F.count_if(F.col(ret) > bound).alias("n"))


#: Bounds of the size tiers, in hundreds of millions.
TIERS = ((0, 20, "micro"), (20, 50, "small"), (50, 100, "mid"), (100, 300, "large"), (300, 1000, "giant"), (1000, float("inf"), "mega"))


def size_tiers(picks: DataFrame, day: str, mv: str, tiers=TIERS) -> DataFrame:
    """Counts by right-open size bin and quantiles by date."""
    count = [F.count_if((F.col(mv) >= lo) & (F.col(mv) < hi)).alias(name) for lo, hi, name in tiers]
    q = F.percentile(mv, F.array(*map(F.lit, (0.1, 0.25, 0.75, 0.9))))
    return picks.groupBy(day).agg(*count, q.alias("\u0001q")).select(day, *[t[2] for t in tiers], *[F.col("\u0001q")[i].alias(n) for i, n in enumerate(("p10", "p25", "p75", "p90"))])


def rebased(series: DataFrame, by: str, day: str, value: str) -> DataFrame:
    """100 at the first day."""
    return series.withColumn("rebased", F.col(value) / F.first(value).over(Window.partitionBy(by).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)) * 100)


def excess_matrix(two: DataFrame, day: str, a: str, b: str, every: int = 5) -> DataFrame:
    """Excess of a over b between each pair of every n-th dates."""
    k = two.withColumn("\u0001rn", F.row_number().over(Window.orderBy(day)) - 1).where(F.col("\u0001rn") % every == 0).drop("\u0001rn")
    p = pairs_before(k, day, [a, b])
    return p.select(f"{day}_i", f"{day}_j", (F.col(f"{a}_j") / F.col(f"{a}_i") - F.col(f"{b}_j") / F.col(f"{b}_i")).alias("excess"))


def threshold_sweep(df: DataFrame, x: str, ret: str, thresholds: Sequence[float]) -> DataFrame:
    """Number, win rate and mean return at or above, and below, each threshold."""
    t = df.where(F.col(x).isNotNull() & F.col(ret).isNotNull()).withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    up = F.col(x) >= F.col("threshold")
    win = (F.col(ret) > 0).cast("double")
    return t.groupBy("threshold").agg(F.count_if(up).alias("n_above"), F.avg(F.when(up, win)).alias("win_above"), F.avg(F.when(up, F.col(ret))).alias("mean_above"), F.avg(F.when(~up, win)).alias("win_below"), F.avg(F.when(~up, F.col(ret))).alias("mean_below"))


def confusion(returns: DataFrame, exposure: DataFrame, day: str, ret: str) -> DataFrame:
    """Avoided losses and missed gains of an exposure table."""
    j = returns.join(exposure, day)
    avoid, loss = F.col("ratio") < 1, F.col(ret) < 0
    out = j.agg(F.count_if(avoid & loss).alias("tp"), F.count_if(~avoid & loss).alias("fn"), F.count_if(avoid & ~loss).alias("fp"), F.count_if(~avoid & ~loss).alias("tn"), F.avg(F.when(avoid & loss, F.col(ret))).alias("avoided_mean"), F.avg(F.when(avoid & ~loss, F.col(ret))).alias("missed_mean"))
    p, r = div(F.col("tp"), F.col("tp") + F.col("fp")), div(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.withColumns({"precision": p, "recall": r, "f1": div(2 * p * r, p + r)})


def snapshot(scores: DataFrame, calendar: DataFrame, exposure: DataFrame, day: str, entity: str, score: str, n: int = 10) -> DataFrame:
    """The n best of the last date with signal and buy date and the exposure of the date."""
    i = calendar_index(calendar, day)
    last = scores.agg(F.max(day).alias(day))
    nxt = i.select((F.col("idx") - 1).alias("idx"), F.col(day).alias("buy_date"))
    best = scores.join(last, day).orderBy(F.desc(score), entity).limit(n)
    out = best.join(i, day).join(nxt, "idx", "left").join(exposure, day, "left")
    return out.select(F.col(day).alias("signal_date"), "buy_date", entity, score, F.coalesce("ratio", F.lit(1.0)).alias("ratio"))


def pick_aggregates(picks: DataFrame, day: str, score: str) -> DataFrame:
    """Extremes, mean, deviation and spread of the picked scores by date."""
    return picks.groupBy(day).agg(F.max(score).alias("max"), F.avg(score).alias("mean"), F.min(score).alias("min"), F.stddev_samp(score).alias("std"), (F.max(score) - F.min(score)).alias("spread"))


def dispersion_table(df: DataFrame, day: str, alias: str, profit: str, rows: int = 10) -> DataFrame:
    """Quartile of the dispersion, rolling correlation with the profit and compounded profit, over one series of batches."""
    s = K.Spec("\u0001one", day)
    edges = df.agg(F.percentile(alias, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("\u0001edges")).withColumn("\u0001one", F.lit(1))
    d = df.withColumn("\u0001one", F.lit(1)).join(F.broadcast(edges), "\u0001one")  # one row
    d = d.withColumns({"quartile": F.size(F.filter("\u0001edges", lambda e: e < F.col(alias))) + 1, "corr": K.corr(s, F.col(alias), F.col(profit), rows, 3), "cumulative": K.cum_prod(s, 1 + F.coalesce(F.col(profit), F.lit(0.0))) - 1})
    return d.drop("\u0001one", "\u0001edges")


def bin_summary(df: DataFrame, by: Sequence[str], x: str, profit: str) -> DataFrame:
    """Number, mean and win rate by bin or month, rank correlation and linear trend of the profit on x."""
    base = df.groupBy(*by).agg(F.avg(profit).alias("mean_profit"), F.avg((F.col(profit) > 0).cast("double")).alias("win_rate"))
    return base.join(correlations(df, by, x, profit), list(by), "left")


def sell_down(held: DataFrame, keep: Column, shares: str = "shares", price: str = "price") -> DataFrame:
    """A rule of one's own, given as the share of a position to keep (null: all of it): what is sold, kept and paid out."""
    k = F.least(F.greatest(F.coalesce(keep, F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    sold = F.col(shares) - F.floor(F.col(shares) * k)
    return held.withColumns({"keep_ratio": k, "sold": sold, "kept": F.col(shares) - sold, "proceeds": sold * F.col(price)})


def total_return(series: DataFrame, day: str, value: str) -> DataFrame:
    """Last over first."""
    return series.agg((F.max_by(value, day) / F.min_by(value, day) - 1).alias("ret"))


def regime_shares(df: DataFrame, regime: str) -> DataFrame:
    """Days of each regime and their share."""
    n = df.groupBy(regime).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row a regime
