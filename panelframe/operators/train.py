"""Training sets and user-level models: windows with embargo, labels, weights, fits with Spark ML."""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelframe.functions.kernels import TINY, div
from panelframe.functions.scalar import half_life
from panelframe.operators import boosting
from panelframe.operators.evaluate import average_rank, rank_ic
from panelframe.operators.xsection import clipped_zscore, zscore
from panelframe.sources.shared import saved


def training_dates(calendar: DataFrame, day: str, at: Iterable, window: int, ahead: int = 6, step: int = 1) -> DataFrame:
    """(base, day) pairs: the window before each base date, without dates whose label reaches beyond it, every step-th."""
    idx = calendar.select(day).distinct().withColumn("\u0001i", F.row_number().over(Window.orderBy(day)))
    base = idx.where(F.col(day).isin(list(at))).select(F.col(day).alias("base"), F.col("\u0001i").alias("\u0001t"))
    age = F.col("\u0001t") - F.col("\u0001i")
    return idx.join(F.broadcast(base), age.between(ahead, window - 1) & (age % step == 0)).select("base", day, age.alias("age"))  # base dates are given one by one


def rank_label(df: DataFrame, day: str, label: str, least: int = 10, out: str = "y") -> DataFrame:
    """Percentile rank of the label in its date, centred; dates with few labels are left out."""
    n = F.count(F.lit(1)).over(Window.partitionBy(day))
    d = df.where(F.col(label).isNotNull()).withColumn("\u0001n", n).where(F.col("\u0001n") >= least)
    return d.withColumn(out, average_rank(label, day) / F.col("\u0001n") - 0.5).drop("\u0001n")


def head_weight(df: DataFrame, day: str, label: str, share: float = 0.1, factor: float = 2.0, out: str = "w") -> DataFrame:
    """Rows at or above the date's upper quantile weigh more."""
    q = df.groupBy(day).agg(F.percentile(label, F.lit(1 - share)).alias("\u0001q"))
    return df.join(q, day).withColumn(out, F.when(F.col(label) >= F.col("\u0001q"), F.lit(factor)).otherwise(F.lit(1.0))).drop("\u0001q")


def top_label(df: DataFrame, day: str, label: str, share: float = 0.05, out: str = "y") -> DataFrame:
    """1 for the upper share of the date."""
    q = df.groupBy(day).agg(F.percentile(label, F.lit(1 - share)).alias("\u0001q"))
    return df.join(q, day).withColumn(out, (F.col(label) >= F.col("\u0001q")).cast("int")).drop("\u0001q")


def balance(df: DataFrame, y: str = "y", out: str = "w") -> DataFrame:
    """Positives weigh as much as all negatives."""
    row = df.agg(F.count_if(F.col(y) == 1), F.count_if(F.col(y) == 0)).first()
    return df.withColumn(out, F.when(F.col(y) == 1, F.lit(row[1] / row[0] if row[0] else 1.0)).otherwise(F.lit(1.0)))


def graded_label(df: DataFrame, day: str, entity: str, label: str, levels: int = 10, out: str = "y") -> DataFrame:
    """Labels clipped to their 10 % and 90 % quantiles, ranked without ties, cut in equal levels; dates below ten rows a level go."""
    q = df.where(F.col(label).isNotNull()).groupBy(day).agg(F.percentile(label, F.array(F.lit(0.1), F.lit(0.9))).alias("\u0001q"), F.count(F.lit(1)).alias("\u0001n"))
    d = df.where(F.col(label).isNotNull()).join(q.where(F.col("\u0001n") >= 10 * levels), day)
    clipped = F.least(F.greatest(F.col(label), F.col("\u0001q")[0]), F.col("\u0001q")[1])
    d = d.withColumn("\u0001c", F.round(clipped, 9))
    place = F.row_number().over(Window.partitionBy(day).orderBy("\u0001c", entity))
    return d.withColumn(out, (F.ceil(place * levels / F.col("\u0001n")) - 1).cast("int")).drop("\u0001q", "\u0001n", "\u0001c")


def groups(df: DataFrame, day: str) -> DataFrame:
    """T08"""
    return df.groupBy(day).count()


def sample_dates(df: DataFrame, day: str, entity: str, most: int = 1000, seed: int = 0) -> DataFrame:
    """At most so many rows a date, those of the least MD5 of entity, date and seed: the same rows on every run and engine."""
    place = F.row_number().over(Window.partitionBy(day).orderBy(F.md5(F.concat_ws("|", F.col(entity).cast("string"), F.col(day).cast("string"), F.lit(str(seed)))), entity))
    return df.withColumn("\u0001p", place).where(F.col("\u0001p") <= most).drop("\u0001p")


def chronological_split(df: DataFrame, day: str, share: float = 0.2, ahead: int = 0) -> tuple[DataFrame, DataFrame]:
    """The last share of the dates for validation. The `ahead` dates before them, whose labels reach into them, are in neither part."""
    days = df.select(day).distinct().withColumn("\u0001n", F.row_number().over(Window.orderBy(day)))  # a calendar
    days = days.withColumn("\u0001p", F.percent_rank().over(Window.orderBy(day)))
    cut, first = days.where(F.col("\u0001p") >= 1 - share).agg(F.min(day), F.min("\u0001n")).first()
    if not ahead:
        return df.where(F.col(day) < F.lit(cut)), df.where(F.col(day) >= F.lit(cut))
    last = days.where(F.col("\u0001n") < (first or 0) - ahead).agg(F.max(day)).first()[0]
    return df.where(F.col(day) <= F.lit(last)), df.where(F.col(day) >= F.lit(cut))


def standardized(df: DataFrame, day: str, features: Sequence[str]) -> DataFrame:
    """X09 on the way to a fit: each feature as its z-score of the date, so that penalties don't act on units; 0 where it is missing or has no spread."""
    return df.withColumns({f: F.coalesce(zscore(F.col(f).cast("double"), day), F.lit(0.0)) for f in features})


def feature_columns(df: DataFrame, factors: Sequence[str]) -> list[str]:
    """The standardised column of a factor, or else the raw one."""
    have = set(df.columns)
    return [f"{f}_standard" if f"{f}_standard" in have else f for f in factors if f in have or f"{f}_standard" in have]


def discover(df: DataFrame, base: Sequence[str], suffixes: Sequence[str] = ("_standard", "_neutral")) -> list[str]:
    """Numeric columns that are neither base columns, labels nor derived ones."""
    return [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint") and c not in base and not c.startswith("label") and not c.endswith(tuple(suffixes))]


def _filled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    x = {f: F.when(F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")) & (F.abs(F.col(f)) != float("inf")), F.col(f).cast("double")).otherwise(F.lit(0.0)) for f in features}
    return VectorAssembler(inputCols=[f"\u0001x_{f}" for f in features], outputCol="features").transform(df.withColumns({f"\u0001x_{f}": c for f, c in x.items()})).drop(*[f"\u0001x_{f}" for f in features])


@dataclass(frozen=True)
class Linear:
    """A linear model: intercept, weights, and the settings that the folds chose."""

    features: tuple[str, ...]
    intercept: float
    weights: tuple[float, ...]
    l1: float
    penalty: float
    error: float


def grams(df: DataFrame, features: Sequence[str], y: str, folds: int, weight: str | None = None) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """By fold (a hash of the row) the weighted sums of products of (1, features, y), all but the 1 less their means, and these means.

    All that a linear fit asks of the rows, in two passes: large offsets would cancel if products were summed first. A task sends a square
    matrix a fold; they are added in two steps. The matrices have the size of the features, not of the rows.
    """
    x = [F.when(F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")) & (F.abs(F.col(f)) != float("inf")), F.col(f).cast("double")).otherwise(F.lit(0.0)).alias(f"x{i}") for i, f in enumerate(features)]
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    d = df.where(F.col(y).isNotNull()).select(F.pmod(F.xxhash64(*features, y), F.lit(folds)).cast("int").alias("fold"), w.alias("w"), *x, F.col(y).cast("double").alias("y"))
    schema, side = "fold int, part int, sums array<double>", len(features) + 2
    means = np.array([v or 0.0 for v in d.agg(*[F.avg(c) for c in d.columns[2:]]).first()])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = {}, TaskContext.get().partitionId() % 64
        for batch in batches:
            m = np.column_stack([np.ones(batch.num_rows), *(batch.column(i + 2).to_numpy(zero_copy_only=False) - means[i] for i in range(side - 1))])
            fold, of = batch.column("fold").to_numpy(zero_copy_only=False), batch.column("w").to_numpy(zero_copy_only=False)
            for k in np.unique(fold).tolist():
                some = m[fold == k]
                total[k] = total.get(k, 0) + (some * of[fold == k][:, None]).T @ some
        keys = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([part] * len(keys), pa.int32()), pa.array([total[k].reshape(-1) for k in keys], pa.list_(pa.float64()))], names=["fold", "part", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, total = None, 0
        for batch in batches:
            for i in range(batch.num_rows):
                first = first or (batch.column("fold")[i].as_py(), batch.column("part")[i].as_py())
                total = total + batch.column("sums")[i].values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([first[0]], pa.int32()), pa.array([first[1]], pa.int32()), pa.array([total], pa.list_(pa.float64()))], names=["fold", "part", "sums"])

    sums = d.mapInArrow(partial, schema).groupBy("fold", "part").applyInArrow(added, schema).groupBy("fold").applyInArrow(added, schema)
    return {r["fold"]: np.array(r["sums"]).reshape(side, side) for r in sums.collect()}, means


def descend(gram: np.ndarray, l1: float, penalty: float, start: np.ndarray | None = None, steps: int = 1000, least: float = 1e-7) -> np.ndarray:
    """Weights that minimise the mean squared error / 2 + penalty * (l1 |w| + (1 - l1) w^2 / 2), intercept apart, by coordinate descent on the sums."""
    n = gram[0, 0]
    mean = gram[0, 1:] / n
    cov = gram[1:, 1:] / n - np.outer(mean, mean)
    a, b = cov[:-1, :-1], cov[:-1, -1]
    w = np.zeros(len(b)) if start is None else start.copy()
    slack = b - a @ w
    for _ in range(steps):
        most = 0.0
        for j in range(len(w)):
            if a[j, j] <= 0:
                continue
            rho = slack[j] + a[j, j] * w[j]
            new = np.sign(rho) * max(abs(rho) - penalty * l1, 0.0) / (a[j, j] + penalty * (1 - l1))
            if new != w[j]:
                slack -= a[:, j] * (new - w[j])
                most = max(most, abs(new - w[j]) * a[j, j] ** 0.5)
                w[j] = new
        if most <= least * max(cov[-1, -1], 1e-30) ** 0.5:
            break
    return w


def fit_elastic_net(df: DataFrame, features: Sequence[str], y: str, l1_ratios: Sequence[float] = (0.1, 0.5, 0.9), penalties: int = 50, folds: int = 3, least: int = 30, weight: str | None = None, sums: tuple[dict[int, np.ndarray], np.ndarray] | None = None) -> Linear | None:
    """The l1 share and penalty with the least squared error over folds, refitted on all; None below `least` rows.

    Penalties fall from the least one that leaves no weight to a thousandth of it. The rows are read twice, whatever the grid's size, or not at all if `sums` has their `grams`. Features should be standardised (`standardized`).
    """
    parts, offset = sums or grams(df, features, y, folds, weight)
    whole = sum(parts.values()) if parts else np.zeros((1, 1))
    n = whole[0, 0]
    if n < least:
        return None
    mean = whole[0, 1:] / n
    reach = np.abs(whole[1:-1, -1] / n - mean[:-1] * mean[-1]).max()

    def error(g: np.ndarray, w: np.ndarray, fit: np.ndarray) -> float:
        at = fit[0, 1:] / fit[0, 0]
        v = np.concatenate([[at[-1] - at[:-1] @ w], w, [-1.0]])
        return float(v @ g @ v)

    best = None
    for l1 in l1_ratios:
        grid, warm, total = np.geomspace(1, 1e-3, penalties) * max(reach / l1, 1e-12), {}, np.zeros(penalties)
        for k, held in parts.items():
            rest = whole - held
            if rest[0, 0] < 2:
                continue
            for i, p in enumerate(grid):
                warm[k] = descend(rest, l1, p, warm.get(k))
                total[i] += error(held, warm[k], rest)
        i = int(total.argmin())
        if best is None or total[i] < best[0]:
            best = total[i], l1, float(grid[i])
    w = descend(whole, best[1], best[2])
    at = offset + mean
    return Linear(tuple(features), float(at[-1] - at[:-1] @ w), tuple(map(float, w)), best[1], best[2], best[0] / n)


def fit_trees(df: DataFrame, features: Sequence[str], y: str, weight: str | None = None, classify: bool = False, rounds: int = 300, rate: float = 0.05, depth: int = 4, seed: int = 1, sample: float = 0.8) -> boosting.Boosted:
    """Boosted trees (panelframe.operators.boosting); graded or ranked labels are fitted pointwise. The fit reads its rows several times: they are saved first."""
    rows = saved(df.where(F.col(y).isNotNull()).select(*dict.fromkeys([*features, y, *([weight] if weight else [])])), "tree-rows")
    return boosting.fit(rows, features, y, weight, classify, rounds, rate, depth, seed, sample)


def fit_linear(df: DataFrame, features: Sequence[str], y: str, l1: float, penalty: float, weight: str | None = None) -> Linear:
    """The elastic net at a given share and penalty, without a search."""
    parts, offset = grams(df, features, y, 1, weight)
    whole = parts[0]
    w, mean = descend(whole, l1, penalty), whole[0, 1:] / whole[0, 0] + offset
    return Linear(tuple(features), float(mean[-1] - mean[:-1] @ w), tuple(map(float, w)), l1, penalty, float("nan"))


def score(model: Model | Linear | boosting.Boosted, df: DataFrame, features: Sequence[str], day: str, entity: str, keep: Sequence[str] = ()) -> DataFrame:
    """(day, entity, the columns to keep, score); the probability of 1 for classifiers."""
    if isinstance(model, Linear):
        return df.select(day, entity, *keep, (F.lit(model.intercept) + linear_score(model.features, model.weights)).alias("score"))
    if isinstance(model, boosting.Boosted):
        return boosting.scored(model, df, [day, entity, *keep])
    out = model.transform(_filled(df, features))
    s = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
    return out.select(day, entity, *keep, s.alias("score"))


def linear_score(features: Sequence[str], weights: Sequence[float]) -> Column:
    """A weighted sum; missing counts as 0."""
    return sum((F.coalesce(F.col(f), F.lit(0.0)) * w for f, w in zip(features, weights, strict=True)), F.lit(0.0))


def ic_weights(df: DataFrame, day: str, factors: Sequence[str], label: str, bound: float = 0.15) -> DataFrame:
    """(factor, weight): mean clipped rank correlation by date, scaled so that the absolute weights sum to 1."""
    long = df.select(day, label, *factors).unpivot([day, label], list(factors), "factor", "value")
    ics = rank_ic(long, [day, "factor"], "value", label)
    mean = ics.groupBy("factor").agg(F.avg(F.least(F.greatest("ic", F.lit(-bound)), F.lit(bound))).alias("m"))
    total = F.sum(F.abs("m")).over(Window.partitionBy())  # one row a factor
    return mean.withColumn("weight", div(F.col("m"), F.when(total > TINY, total))).select("factor", "weight")


def ic_score(df: DataFrame, weights: DataFrame, day: str, entity: str, factors: Sequence[str], least: int = 30) -> DataFrame:
    """Weights times clipped z-scores, summed."""
    z = df.select(day, entity, *[clipped_zscore(F.col(f), day, least=least).alias(f) for f in factors])
    long = z.unpivot([day, entity], list(factors), "factor", "z")
    return long.join(F.broadcast(weights), "factor").groupBy(day, entity).agg(F.sum(F.coalesce("z", F.lit(0.0)) * F.coalesce("weight", F.lit(0.0))).alias("score"))  # weights: a row a factor


def mean_ic(scored: DataFrame, day: str, score_: str, label: str) -> float | None:
    """The objective of searches: mean daily rank correlation."""
    return rank_ic(scored, [day], score_, label).agg(F.avg("ic")).first()[0]


def aged(df: DataFrame, day: str, out: str = "age") -> DataFrame:
    """df with the number of its dates that are later than the row's."""
    days = df.select(day).distinct().withColumn(out, F.row_number().over(Window.orderBy(F.desc(day))) - 1)  # a calendar
    return df.join(F.broadcast(days), day)


def training_rows(df: DataFrame, day: str, window: int | None = None, half: float | None = None, out: str = "w") -> DataFrame:
    """df's last `window` dates, weighted by 2 ** (-age / half) (1 if there is no half-life), times a weight that df has."""
    age = "\u0001age"
    d = aged(df, day, age)
    if window is not None:
        d = d.where(F.col(age) < window)
    w = half_life(F.col(age), half) if half else F.lit(1.0)
    return d.withColumn(out, w * F.col(out) if out in df.columns else w).drop(age)


def grid_search(df: DataFrame, features: Sequence[str], day: str, entity: str, label: str, fit: Callable[..., Model | Linear], grid: dict[str, Sequence], share: float = 0.2, ahead: int = 0, window: int | None = None, half: float | None = None, parallelism: int = 4, shared: Callable[..., object] | None = None) -> list[tuple[dict, float | None]]:
    """Every combination fitted on the early dates, judged by mean daily rank correlation on the late ones; best first (of equals the first of the grid).

    The split keeps `ahead` dates apart, so that no label of the training rows lies in the validation dates. `window` and `half` in the grid choose
    training dates and their weights (column w); all else goes to `fit(rows, features, label, **how)`. Fits share one saved set of rows, `parallelism` of them at a time.
    What `shared(rows, features, label)` gives is made once for each choice of training dates and weights, and given to `fit` as `sums`.
    """
    rows = saved(df.where(F.col(label).isNotNull()), "grid-rows")
    train, valid = chronological_split(rows, day, share, ahead)
    combos = [dict(zip(grid, v, strict=True)) for v in itertools.product(*grid.values())]

    chosen = lambda how: (how.get("window", window), how.get("half", half))

    def prepared(which: tuple) -> tuple[DataFrame, dict]:
        some = training_rows(train, day, *which)
        return some, {"sums": shared(some, features, label)} if shared else {}

    def one(how: dict) -> float | None:
        own = {k: v for k, v in how.items() if k not in ("window", "half")}
        some, more = sets[chosen(how)]
        model = fit(some, features, label, **own, **more)
        if model is None:
            return None
        return mean_ic(score(model, valid, features, day, entity, [label]), day, "score", label)

    with ThreadPool(max(1, min(parallelism, len(combos)))) as pool:  # the driver only waits: Spark runs the fits' jobs side by side
        kinds = list(dict.fromkeys(map(chosen, combos)))
        sets = dict(zip(kinds, pool.map(inheritable_thread_target(df.sparkSession)(prepared), kinds), strict=True))
        found = pool.map(inheritable_thread_target(df.sparkSession)(one), combos)
    return sorted(zip(combos, found, strict=True), key=lambda x: -(x[1] if x[1] is not None and x[1] == x[1] else float("-inf")))


def importances(model: Model | boosting.Boosted, features: Sequence[str]) -> list[tuple[str, float]]:
    """T25"""
    found = model.importances if isinstance(model, boosting.Boosted) else model.featureImportances.toArray()
    return [(f, float(v)) for f, v in zip(features, found, strict=True)]


@dataclass(frozen=True)
class Choice:
    """What a refit used: its base date, the searches made for it, and the settings that hold from then on."""

    base: object
    searched: tuple[str, ...]
    params: tuple[tuple[str, object], ...]
    window: int
    half: float | None


def walk_forward(
    df: DataFrame, features: Sequence[str], day: str, entity: str, label: str, refits: Sequence, fit: Callable[..., Model | Linear | None], window: int, ahead: int = 6,
    half: float | None = None, grid: dict[str, Sequence] | None = None, second: dict[str, Sequence] | None = None, every: int = 20, second_every: int = 3, lookback: int = 120, share: float = 0.2, parallelism: int = 4, shared: Callable[..., object] | None = None,
) -> tuple[DataFrame, list[Choice]]:
    """A model for each refit date from the window before it, scoring the dates up to the next one; and what each used.

    With a grid, a search over the last `lookback` dates whose labels are known precedes the first refit and each that is `every` dates or more after
    the last search; each `second_every`-th search is followed by one over windows and half-lives (`second`). What they choose holds until the next search.
    Each block of scores is saved: lineage doesn't grow with the refits. Only the fits are a loop.
    """
    calendar = [r[0] for r in df.select(day).distinct().orderBy(day).collect()]  # dates
    place = {d: i for i, d in enumerate(calendar)}
    dates, out, choices, params, last, searches = sorted(refits), None, [], {}, None, 0
    for i, base in enumerate(dates):
        at = place.get(base, bisect.bisect_left(calendar, base))
        until = calendar[max(0, at - ahead)]
        known = df.where(F.col(day) <= F.lit(until)) if at >= ahead else df.limit(0)
        made: list[str] = []
        if grid and at - ahead > 0 and (last is None or at - last >= every):
            recent = known.where(F.col(day) > F.lit(calendar[max(0, at - lookback)]))
            found = grid_search(recent, features, day, entity, label, fit, grid, share, ahead, None, half, parallelism, shared)
            params, last, searches = dict(found[0][0]), at, searches + 1
            made.append("grid")
            if second and searches % second_every == 0:
                kept = params
                found = grid_search(recent, features, day, entity, label, lambda *a, kept=kept, **k: fit(*a, **kept, **k), second, share, ahead, window, half, parallelism, shared)
                window, half = found[0][0].get("window", window), found[0][0].get("half", half)
                made.append("window and half-life")
        first = calendar[max(0, at - window + 1)]
        model = fit(training_rows(known.where(F.col(day) >= F.lit(first)), day, None, half), features, label, **params)
        choices.append(Choice(base, tuple(made), tuple(params.items()), window, half))
        if model is None:
            continue
        use = df.where(F.col(day) >= F.lit(base))
        if i + 1 < len(dates):
            use = use.where(F.col(day) < F.lit(dates[i + 1]))
        scored = score(model, use, features, day, entity, [label]).withColumn("base", F.lit(base))
        scored = saved(scored, "walk-forward")
        out = scored if out is None else out.unionByName(scored)
    return out, choices
