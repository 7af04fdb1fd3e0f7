"""Joins, ranks and searches that spread hot keys: against pandas and numpy, with one key of nearly all rows."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelframe.operators import cohorts, joins, order, pit, relational, train, xsection

D = dt.date(2020, 1, 1)


def day(i):
    return D + dt.timedelta(int(i))


def sides(seed, n=3000):
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.9, "hot", rng.choice(["a", "b", "c"], n))
    left = pd.DataFrame({"k": key, "t": rng.integers(0, 900, n), "i": range(n)})
    m = n // 3
    right = pd.DataFrame({"k": np.where(rng.random(m) < 0.9, "hot", rng.choice(["a", "b"], m)), "t": rng.integers(100, 900, m), "v": rng.random(m)}).drop_duplicates(["k", "t"])
    return left, right


@pytest.mark.parametrize("strict", [False, True])
def test_asof_of_a_hot_key(spark, strict):
    left, right = sides(1)
    ls = spark.createDataFrame([(k, day(t), int(i)) for k, t, i in left.itertuples(index=False)], "k string, d date, i long")
    rs = spark.createDataFrame([(k, day(t), float(v)) for k, t, v in right.itertuples(index=False)], "k string, at date, v double")
    out = joins.asof(ls, rs, "k", "d", "at", ["v"], strict)
    got = {r.i: r.v for r in out.collect()}
    want = pd.merge_asof(left.sort_values("t"), right.sort_values("t"), on="t", by="k", allow_exact_matches=not strict)
    assert len(got) == len(left)
    for i, v in zip(want.i, want.v, strict=True):
        assert (got[i] is None and v != v) or got[i] == v
    # no task of the last window holds the hot key's rows: they lie in buckets of time
    buckets = ls.groupBy("k", F.floor(F.unix_date("d") / 64)).count().agg(F.max("count")).first()[0]
    assert buckets < 0.12 * len(left)


def test_asof_on_numbers_and_times(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y")], "k string, u int, v string")
    got = {(r.k, r.t): r.v for r in joins.asof(left, right, "k", "t", "u", ["v"]).collect()}
    assert got == {("a", 5): "y", ("a", 1): None, ("b", 9): None}
    times = lambda *xs: [dt.datetime(2024, 1, 1) + dt.timedelta(hours=h) for h in xs]
    left = spark.createDataFrame([("a", t) for t in times(1, 5, 9000)], "k string, t timestamp")
    right = spark.createDataFrame([("a", t, i) for i, t in enumerate(times(2, 5, 4000))], "k string, u timestamp, v int")
    assert [r.v for r in joins.asof(left, right, "k", "t", "u", ["v"]).orderBy("t").collect()] == [None, 1, 2]


def test_spells_cost_bins(spark):
    rng = np.random.default_rng(2)
    spells = [(f"k{int(rng.integers(4))}", day(a := int(rng.integers(0, 3000))), None if rng.random() < 0.1 else day(a + int(rng.integers(-2, 900)))) for _ in range(25)] + [("none", None, day(3)), ("k0", day(10), day(10))]
    days = [day(i) for i in range(0, 3000, 7)]
    s = spark.createDataFrame(spells, "k string, a date, b date")
    out = joins.expand_intervals(s, spark.createDataFrame([(d,) for d in days], "d date"), "k", "a", "b", "d")
    got = {(r.k, r.d): r.flag for r in out.collect()}
    want = {(k, d): int(any(a is not None and a <= d and (b is None or d <= b) for kk, a, b in spells if kk == k)) for k in {x[0] for x in spells} for d in days}
    assert got == want
    merged = joins.merged_spells(s, "k", "a", "b").collect()
    assert len(merged) == len({(r.k, r.a) for r in merged}) < len(spells)


def test_ranks_and_quantiles_of_a_hot_date(spark):
    rng = np.random.default_rng(3)
    n = 4000
    p = pd.DataFrame({"d": np.where(rng.random(n) < 0.9, 1, rng.integers(2, 5, n)), "x": np.round(rng.normal(0, 1, n), 2), "rank": 7.0})
    p.loc[rng.random(n) < 0.05, "x"] = np.nan
    df = spark.createDataFrame([(int(d), None if x != x else float(x), i, 7.0) for i, (d, x, _) in enumerate(p.itertuples(index=False))], "d int, x double, i long, rank double").repartition(6)
    got = {r.i: r["rank"] for r in order.average_ranks(df, "d", "x").collect()}
    for i, v in enumerate(p.groupby("d").x.rank(pct=True)):
        assert (got[i] is None and v != v) or got[i] == pytest.approx(v)
    shares = [0, 0.01, 0.5, 0.77, 1]
    q = {r.d: r.quantiles for r in order.quantiles(df, "d", "x", shares).collect()}
    for d, g in p.groupby("d"):
        assert q[d] == pytest.approx(g.x.dropna().quantile(shares).tolist())
    a, b = (xsection.winsorize(df, "d", ["x"], spread=s).orderBy("i").toPandas() for s in (True, False))
    pd.testing.assert_frame_equal(a[b.columns], b)
    assert order.value_table(df, "d", "x").count() == p.dropna().groupby("d").x.nunique().sum()


def test_batch_profit_is_summed_by_day(spark):
    buys = spark.createDataFrame([(day(0), 100.0), (day(0), 50.0), (day(10), 80.0)], "b date, cost double")
    sells = spark.createDataFrame([(day(i % 12 + 1), 1.0) for i in range(1200)], "s date, got double")
    out = {r.b: (r.bought, r.sold) for r in cohorts.batch_profit(buys, sells, "b", "s", "cost", "got").collect()}
    assert out == {day(0): (150.0, 1000.0), day(10): (80.0, 200.0)}


def test_versions_as_known(spark):
    v = [("n", day(90), day(100), 1.0), ("n", day(90), day(150), 1.5), ("n", day(180), day(200), 2.0), ("n", day(90), day(210), 9.0), ("n", day(180), day(220), 2.5), ("n", day(180), day(220), None), ("n", day(270), None, 7.0)]
    df = spark.createDataFrame(v, "n string, end date, ann date, x double")
    panel = spark.createDataFrame([("n", day(i)) for i in (99, 100, 149, 150, 199, 200, 215, 220, 400)] + [("m", day(200))], "n string, d date")
    got = {(r.n, r.d): (r.end, r.version_of, r.x) for r in pit.known_versions(panel, df, "n", "d", "end", "ann", ["x"]).collect()}
    assert [got["n", day(i)][2] for i in (99, 100, 149, 150, 199, 200, 215, 220, 400)] == [None, 1.0, 1.0, 1.5, 1.5, 2.0, 2.0, 2.5, 2.5]
    assert got["n", day(215)][:2] == (day(180), day(200)) and got["m", day(200)] == (None, None, None)  # a late word on an old period changes nothing
    spans = {(r.end, r.valid_from): (r.valid_to, r.x) for r in pit.validity(df, "n", "end", "ann").collect()}
    assert spans == {(day(90), day(100)): (day(150), 1.0), (day(90), day(150)): (day(210), 1.5), (day(90), day(210)): (None, 9.0), (day(180), day(200)): (day(220), 2.0), (day(180), day(220)): (None, 2.5)}
    assert {r.end: r.x for r in pit.latest_restatement(df, "n", "end", "ann").collect()} == {day(90): 9.0, day(180): 2.5, day(270): 7.0}


def test_own_columns_keep_their_names(spark):
    df = spark.createDataFrame([(day(0), float(i), f"n{i}", f"p{i}", i) for i in range(12)], "d date, label double, _n string, _p string, _rn int")
    assert set(train.rank_label(df, "d", "label").columns) == {*df.columns, "y"}
    assert train.sample_dates(df, "d", "_n", 5).columns == df.columns
    assert relational.keep_one(df, ["d"], [F.col("label")]).columns == df.columns and relational.every_nth(df, 2, "label").columns == df.columns


# ---- searches --------------------------------------------------------------------------------------


def scored(seed=5, dates=40, names=15):
    rng = np.random.default_rng(seed)
    rows = [(day(d), e, *map(float, rng.normal(0, 1, 3))) for d in range(dates) for e in range(names)]
    return [(d, e, a, b, 0.4 * a - 0.1 * b + 0.5 * z) for d, e, a, b, z in rows]


def test_split_keeps_labels_apart(spark):
    """A feature that tells the label of a date only through labels that overlap: without the gap it looks good on validation dates."""
    df = spark.createDataFrame(scored(), "d date, e int, a double, b double, y double")
    early, late = train.chronological_split(df, "d", 0.2, ahead=3)
    days = sorted({r.d for r in df.select("d").collect()})
    e, v = (sorted({r.d for r in x.select("d").collect()}) for x in (early, late))
    assert v == days[-8:] and e == days[: -8 - 3] and train.chronological_split(df, "d", 0.2)[0].select("d").distinct().count() == 32
    # labels that look 3 dates ahead repeat: date d and d+1 share most of their label, so that a table of names by last label wins unless dates are kept apart
    rng = np.random.default_rng(1)
    noise = rng.normal(0, 1, (60, 2000))
    y = np.array([noise[d : d + 4].sum(0) for d in range(56)])
    seen = {g: y[48 - 1 - g] for g in (0, 3)}  # the last training label with and without the gap
    ic = {g: np.mean([pd.Series(s).rank().corr(pd.Series(y[d]).rank()) for d in range(48, 51)]) for g, s in seen.items()}
    assert ic[0] > 0.3 > abs(ic[3])


def brute(rows, how, ahead, share):
    """The rank correlation that one combination gets: weighted elastic net by proximal gradient steps on standardised dates."""
    p = pd.DataFrame(rows, columns=["d", "e", "a", "b", "y"])
    days = sorted(p.d.unique())
    cut = next(i for i in range(len(days)) if i / (len(days) - 1) >= 1 - share)
    fit = p[p.d < days[cut - ahead]]
    last = [d for d in days if d < days[cut - ahead]]
    age = fit.d.map({d: len(last) - 1 - i for i, d in enumerate(last)})
    fit, age = fit[age < how["window"]], age[age < how["window"]]
    w = np.ones(len(fit)) if how["half"] is None else 2.0 ** (-age.to_numpy() / how["half"])
    x, y = fit[["a", "b"]].to_numpy(), fit.y.to_numpy()
    xc, yc = x - np.average(x, axis=0, weights=w), y - np.average(y, weights=w)
    beta = np.zeros(2)
    h = (xc * w[:, None]).T @ xc / w.sum()
    g = (xc * w[:, None]).T @ yc / w.sum()
    for _ in range(20000):
        z = beta - 0.1 * (h @ beta - g + how["p"] * 0.5 * beta)
        beta = np.sign(z) * np.maximum(np.abs(z) - 0.1 * how["p"] * 0.5, 0)
    late = p[p.d >= days[cut]].assign(s=lambda q: q[["a", "b"]].to_numpy() @ beta)
    return late.groupby("d").apply(lambda q: q.s.rank().corr(q.y.rank()), include_groups=False).mean()


def test_grid_of_windows_and_half_lives(spark):
    rows = scored()
    df = spark.createDataFrame(rows, "d date, e int, a double, b double, y double")

    def fit(d, f, y, p):
        parts, offset = train.grams(d, f, y, 1, "w")
        w = train.descend(parts[0], 0.5, p)
        return train.Linear(tuple(f), 0.0, tuple(map(float, w)), 0.5, p, 0.0)

    grid = {"p": (0.01, 0.2), "window": (5, 40), "half": (4.0, None)}
    found = train.grid_search(df, ["a", "b"], "d", "e", "y", fit, grid, ahead=2, parallelism=4)
    assert len(found) == 8 and [ic for _, ic in found] == sorted((ic for _, ic in found), reverse=True)
    for how, ic in found:
        assert ic == pytest.approx(brute(rows, how, 2, 0.2), abs=2e-3)
    again = train.grid_search(df, ["a", "b"], "d", "e", "y", fit, grid, ahead=2, parallelism=1)
    assert [(h, round(i, 9)) for h, i in again] == [(h, round(i, 9)) for h, i in found]


def test_schedule_carries_what_it_chose(spark):
    df = spark.createDataFrame(scored(), "d date, e int, a double, b double, y double")
    calls = []

    def fit(d, f, y, p=0.5):
        calls.append(p)
        return train.fit_elastic_net(d, f, y, (0.5,), 3, weight="w")

    refits = [day(i) for i in (12, 17, 22, 27, 32)]
    out, used = train.walk_forward(df, ["a", "b"], "d", "e", "y", refits, fit, 8, 2, 5.0, {"p": (0.1, 0.3)}, {"window": (6, 10)}, every=10, second_every=2, lookback=20, parallelism=2)
    assert [c.searched for c in used] == [("grid",), (), ("grid", "window and half-life"), (), ("grid",)]
    assert used[1].params == used[0].params and used[0].window == used[1].window == 8 and used[2].window in (6, 10) and used[3].window == used[2].window
    assert used[0].half == 5.0 and out.select("base").distinct().count() == 5
    assert out.where("d < base").count() == 0 and out.count() == 15 * (40 - 12)
    assert out.stat.corr("score", "y") > 0.4


def test_offsets_do_not_cancel(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (300, 2))
    y = x @ [1.0, -2.0] + 1e9
    df = spark.createDataFrame([(float(a + 1e9), float(b - 1e8), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    model = train.fit_elastic_net(df, ["a", "b"], "y")
    assert np.allclose(model.weights, [1, -2], atol=0.02)


def test_rebuild_decision():
    assert xsection.rebuild_needed(["a", "b"], ["b"]) == (False, []) and xsection.rebuild_needed(["a"], ["b", "a"]) == (True, ["b"])
