"""Boosted trees on histograms: rows lie in blocks of binned features, a level of a tree is one pass over them.

The trees are those of Spark ML's GBTRegressor and GBTClassifier (variance impurity, gradients of squared and of log loss, the first
tree at full weight, a share of the rows a round), which rebuild two objects a row each round. Here a block of rows is a few arrays:
each pass adds up sums by (node, feature, bin) in every task, and the driver gets matrices of the tree's size, one a task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of a feature, as in Spark ML.
BINS = 32
#: Rows of a block.
BLOCK = 1 << 16
#: Rounds after which scores are computed from the binned rows anew: lineage doesn't grow with the rounds.
ANEW = 50


@dataclass(frozen=True)
class Tree:
    """Of each level the features and the last bins that go left (BINS: all do, the node isn't split), and the values of the leaves."""

    features: tuple[tuple[int, ...], ...]
    cuts: tuple[tuple[int, ...], ...]
    leaves: tuple[float, ...] = ()


@dataclass(frozen=True)
class Boosted:
    features: tuple[str, ...]
    splits: tuple[tuple[float, ...], ...]
    trees: tuple[Tree, ...]
    weights: tuple[float, ...]
    classify: bool
    importances: tuple[float, ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Of rows of features (one column each): the value, or the probability of 1 for classifiers."""
        bins = binned(x, self.splits)
        out = np.zeros(len(x))
        for tree, w in zip(self.trees, self.weights, strict=True):
            out += w * np.array(tree.leaves)[nodes(bins, tree)]
        return 1 / (1 + np.exp(-2 * out)) if self.classify else out


def number(name: str) -> Column:
    """A feature as a finite number; 0 if it is none."""
    c = F.col(name).cast("double")
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), c).otherwise(F.lit(0.0))


def _matrix(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    return np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names])


def binned(x: np.ndarray, splits: Sequence[Sequence[float]]) -> np.ndarray:
    """One row a feature: how many of its splits are below the value."""
    return np.array([np.searchsorted(np.array(s), x[:, i], "left") for i, s in enumerate(splits)], np.uint8)


def nodes(bins: np.ndarray, tree: Tree) -> np.ndarray:
    """The rows' places in the level below the tree's last one."""
    at = np.zeros(bins.shape[1], np.uint8)
    for features, cuts in zip(tree.features, tree.cuts, strict=True):
        right = np.zeros(len(at), bool)
        for node, (f, cut) in enumerate(zip(features, cuts, strict=True)):
            if cut < BINS:
                right |= (at == node) & (bins[f] > cut)
        at = 2 * at + right
    return at


def candidates(x: DataFrame) -> list[tuple[float, ...]]:
    """Where each column can be split, from all rows: between its values if there are at most BINS of them, else at its quantiles."""
    names = x.columns

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(0)] * len(names)
        for batch in batches:
            for i, n in enumerate(names):
                if len(seen[i]) <= BINS:
                    seen[i] = np.union1d(seen[i], batch.column(n).to_numpy(zero_copy_only=False))[: BINS + 1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(names), dtype=np.int32), [len(s) for s in seen])), pa.array(np.concatenate(seen))], names=["i", "v"])

    values = x.mapInArrow(some, "i int, v double").groupBy("i").agg(F.array_sort(F.collect_set("v")))  # at most BINS + 1 a task and column
    few = {i: v for i, v in values.collect()}
    many = [i for i, v in few.items() if len(v) > BINS]
    if many:
        shares = [k / BINS for k in range(1, BINS)]
        at = x.agg(*[F.percentile_approx(names[i], shares, 10000) for i in many]).first()
        few |= {i: None for i in many}
    out = []
    for i in range(len(names)):
        v = few.get(i, [])
        out.append(tuple(sorted(set(at[many.index(i)]))) if v is None else tuple((a + b) / 2 for a, b in zip(v, v[1:], strict=False)))
    return out


def _blocks(rows: DataFrame, names: Sequence[str], splits: Sequence[Sequence[float]]) -> RDD:
    """(seed of its own, bins, labels, weights) of each block of rows."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, n = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            bins, y, w = (np.concatenate(p, axis=-1) for p in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([made]), *(pa.array([a.tobytes()], pa.binary()) for a in (bins, y, w))], names=["part", "place", "bins", "y", "w"])

        for batch in batches:
            if not all(np.isfinite(batch.column(n).to_numpy(zero_copy_only=False)).all() for n in ("y", "w")):
                raise ValueError("labels and weights must be finite numbers")
            held.append((binned(_matrix(batch, names), splits), batch.column("y").to_numpy(zero_copy_only=False), batch.column("w").to_numpy(zero_copy_only=False)))
            n += batch.num_rows
            if n >= BLOCK:
                yield block()
                made, held, n = made + 1, [], 0
        if n:
            yield block()

    width = len(names)
    read = lambda r: ((r.part, r.place), np.frombuffer(bytes(r.bins), np.uint8).reshape(width, -1), np.frombuffer(bytes(r.y)), np.frombuffer(bytes(r.w)))
    return rows.mapInArrow(packed, "part long, place long, bins binary, y binary, w binary").rdd.map(read)


def _pull(y: np.ndarray, at: np.ndarray, classify: bool, first: bool) -> np.ndarray:
    """What a tree is fitted to: the labels at first, then the loss's negative gradient."""
    if first:
        return y
    return 4 * y / (1 + np.exp(2 * y * at)) if classify else 2 * (y - at)


def _sums(state: RDD, tree: Tree, number_: int, width: int, sample: float, seed: int, classify: bool) -> np.ndarray:
    """By (node, feature, bin) of the tree's next level: weights, and weights times what is fitted."""
    level = len(tree.features)
    size = (1 << level) * BINS

    def added(blocks: Iterator[tuple]) -> Iterator[np.ndarray]:
        total = np.zeros((2, width, size))
        for key, bins, y, w, at in blocks:
            s = w * (np.random.default_rng([seed, number_, *key]).random(len(w)) < sample) if sample < 1 else w
            st = s * _pull(y, at, classify, number_ == 0)
            base = nodes(bins, tree).astype(np.intp) * BINS
            for f in range(width):
                where = base + bins[f]
                total[0, f] += np.bincount(where, s, size)
                total[1, f] += np.bincount(where, st, size)
        yield total

    total = sum(state.mapPartitions(added).collect(), np.zeros((2, width, size)))
    return total.reshape(2, width, 1 << level, BINS).swapaxes(1, 2)


def _split(sums: np.ndarray) -> tuple[list[int], list[int], list[float], list[tuple[int, float]]]:
    """Of each node the feature and bin that leave the least squared error (BINS if none leaves less), the means of its sides, and (feature, gain)."""
    features, cuts, means, gains = [], [], [], []
    for w, s in zip(*sums, strict=True):
        left, sleft = w.cumsum(1)[:, :-1], s.cumsum(1)[:, :-1]
        all_, sall = w[0].sum(), s[0].sum()
        right, sright = all_ - left, sall - sleft
        ok = (left > 1e-9) & (right > 1e-9 * max(all_, 1.0))
        gain = np.where(ok, np.square(sleft) / np.where(ok, left, 1) + np.square(sright) / np.where(ok, right, 1), -np.inf)
        f, cut = np.unravel_index(gain.argmax(), gain.shape)
        own = sall * sall / all_ if all_ > 0 else 0.0
        mean = sall / all_ if all_ > 0 else 0.0
        if gain[f, cut] - own > 1e-12 * max(abs(own), 1e-300):
            means += [sleft[f, cut] / left[f, cut], sright[f, cut] / right[f, cut]]
            gains.append((int(f), float(gain[f, cut] - own)))
        else:
            f, cut = 0, BINS
            means += [mean, mean]
        features.append(int(f))
        cuts.append(int(cut))
    return features, cuts, means, gains


def fit(rows: DataFrame, features: Sequence[str], y: str, weight: str | None, classify: bool, rounds: int, rate: float, depth: int, seed: int, sample: float) -> Boosted:
    """Boosted trees of the rows, which are read a few times: save them first. Labels of classifiers are 0 and 1."""
    width, names = len(features), [f"x{i}" for i in range(len(features))]
    x = [number(f).alias(n) for f, n in zip(features, names, strict=True)]
    label = F.col(y).cast("double")
    d = rows.select(*x, (2 * label - 1 if classify else label).alias("y"), (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("w"))
    splits = candidates(d.select(*names))
    base = _blocks(d, names, splits)
    base = base.coalesce(2 * base.context.defaultParallelism).persist(StorageLevel.MEMORY_AND_DISK)  # a matrix a task reaches the driver
    trees: list[Tree] = []
    weights: list[float] = []
    importance = np.zeros(width)

    def grown(some: Sequence[tuple[Tree, float]]):
        def more(block: tuple) -> tuple:
            key, bins, y, w, *at = block
            at = at[0].copy() if at else np.zeros(len(y))
            for tree, share in some:
                at += share * np.array(tree.leaves)[nodes(bins, tree)]
            return key, bins, y, w, at

        return more

    kept: list[RDD] = []
    try:
        for i in range(rounds):
            state = (base.map(grown(list(zip(trees, weights, strict=True)))) if i % ANEW == 0 else kept[-1].map(grown([(trees[-1], weights[-1])]))).persist(StorageLevel.MEMORY_AND_DISK)
            kept.append(state)
            tree = Tree((), ())
            for level in range(depth):
                sums = _sums(state, tree, i, width, sample, seed, classify)
                fs, cuts, means, gains = _split(sums)
                for f, gain in gains:
                    importance[f] += gain
                tree = Tree((*tree.features, tuple(fs)), (*tree.cuts, tuple(cuts)), tuple(means))
            for old in kept[:-1]:
                old.unpersist()
            kept = kept[-1:]
            trees.append(tree)
            weights.append(rate if i else 1.0)
    finally:
        for r in (*kept, base):
            r.unpersist()
    total = importance.sum()
    return Boosted(tuple(features), tuple(splits), tuple(trees), tuple(weights), classify, tuple((importance / total if total else importance).tolist()))


def scored(model: Boosted, df: DataFrame, keep: Sequence[str], out: str = "score") -> DataFrame:
    """The columns to keep and the model's score."""
    names = [f"\u0001x{i}" for i in range(len(model.features))]
    d = df.select(*keep, *[number(f).alias(n) for f, n in zip(model.features, names, strict=True)])
    schema = d.select(*keep, F.lit(0.0).alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(model.score(_matrix(batch, names)))], names=[*keep, out])

    return d.mapInArrow(run, schema)
