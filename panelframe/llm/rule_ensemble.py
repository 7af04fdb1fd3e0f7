"""Operator 5: a quality classifier as a sparse ensemble of rules.

Statistics of the whole text feed a forest of shallow trees; every path from a root to
a node is a conjunctive rule (a statistic above or below a threshold, and so on). A
logistic regression with lasso penalty over the rules' truth values keeps a few of
them, and rules and weights compile into one Spark column expression over the statistics:
scoring needs no model object.

The fit takes at most `most_rows` labelled rows, those of the least hashes of their ids (a
documented bound): a threshold from their count leaves a twentieth more, and only these are put in order; scoring covers every row. Null and empty texts have statistics 0 and
get a score like any other. Without labels of both classes the score is the share of
label 1 (0.5 without any). Labels of ids that occur several times count each time; an
id with a null label or none is not learnt from. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelframe.llm.shared import bounded_batches, narrow, saved
from panelframe.llm.stats import counts_of

#: Statistics: name, numerator and denominator among the counts (1: the number itself).
STATISTICS = (
    ("words", "n_words", None),
    ("word_length", "word_chars", "n_words"),
    ("symbols", "n_symbols", "n_words"),
    ("capitals", "n_upper", "n_chars_"),
    ("small_letters", "n_lower", "n_chars_"),
    ("digits", "n_digits", "n_chars_"),
    ("marks", "n_marks", "n_words"),
    ("stops", "n_stops", "n_words"),
    ("line_words", "n_words", "n_lines"),
    ("dup_lines", "n_dup_lines", "n_lines"),
    ("repeat_words", "n_repeat_words", "n_words"),
    ("distinct_words", "n_distinct", "n_words"),
    ("adjacent_words", "n_adjacent", "n_words"),
)
NAMES = tuple(x[0] for x in STATISTICS)


def statistics(counts: Column) -> list[Column]:
    out = []
    for name, over, under in STATISTICS:
        x = counts[over].cast("double")
        out.append((x if under is None else x / F.greatest(counts[under], F.lit(1))).alias(name))
    return out


def with_statistics(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the statistics of the text, computed once."""
    bounded_batches(df.sparkSession)
    docs = narrow(df, doc_id=doc_id, text=text).select("doc_id", F.col("text").cast("string").alias("text"))
    return saved(docs.withColumn("counts", counts_of("text")).select("doc_id", *statistics(F.col("counts"))), "rule-statistics")


@dataclass(frozen=True, order=True)
class Condition:
    feature: int
    above: bool
    threshold: float

    def column(self, names: Sequence[str]) -> Column:
        c = F.col(names[self.feature])
        return c > self.threshold if self.above else c <= self.threshold


Rule = tuple[Condition, ...]
_IF = re.compile(r"(If|Else) \(feature (\d+) (<=|>) ([-+0-9.eE]+)\)")


def paths(tree: str) -> list[Rule]:
    """The conjunctions of all paths of a tree, given as Spark prints it."""
    out, path = [], []
    for line in tree.splitlines():
        m = _IF.search(line)
        if not m:
            continue
        depth = len(line) - len(line.lstrip())
        path = [x for x in path if x[0] < depth]
        path.append((depth, Condition(int(m[2]), m[3] == ">", float(m[4]))))
        out.append(_tight([c for _, c in path]))
    return out


def _tight(conditions: list[Condition]) -> Rule:
    """One bound of each side for a feature: the tightest."""
    best: dict[tuple[int, bool], float] = {}
    for c in conditions:
        key = c.feature, c.above
        best[key] = c.threshold if key not in best else max(best[key], c.threshold) if c.above else min(best[key], c.threshold)
    return tuple(sorted(Condition(f, a, t) for (f, a), t in best.items()))


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self, names: Sequence[str] = NAMES) -> Column:
        """The probability of label 1 as an expression over the statistics."""
        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            hit = rule[0].column(names)
            for c in rule[1:]:
                hit = hit & c.column(names)
            z = z + F.when(hit, F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-z))


def fit(rows: DataFrame, label: str = "label", most_rows: int = 20_000, trees: int = 24, depth: int = 3, penalty: float = 0.002, seed: int = 5) -> Ensemble:
    """rows: the statistics and a label 0 or 1, and doc_id."""
    picked = rows.where(F.col(label).isin(0, 1)).withColumn("\u0001hash", F.xxhash64("doc_id", F.lit(seed)))
    picked = _least(picked, most_rows).orderBy("\u0001hash", *NAMES).limit(most_rows)
    picked = saved(picked.select(*NAMES, F.col(label).cast("double").alias("label")).repartition(4), "rule-training")
    n, ones = picked.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if ones in (0, n):
        share = min(max(ones / n if n else 0.5, 1e-6), 1 - 1e-6)
        return Ensemble(math.log(share / (1 - share)), ())
    vector = picked.select("*", array_to_vector(F.array(*NAMES)).alias("features"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.7, featureSubsetStrategy="0.5", minInstancesPerNode=5).fit(vector)
    rules = sorted({r for t in forest.trees for r in paths(t.toDebugString)})
    if not rules:
        return Ensemble(math.log(ones / (n - ones)), ())

    def truth(rule: Rule) -> Column:
        hit = rule[0].column(NAMES)
        for c in rule[1:]:
            hit = hit & c.column(NAMES)
        return hit.cast("double")

    design = picked.select("label", array_to_vector(F.array(*[truth(r) for r in rules])).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60).fit(design)
    weights = lasso.coefficients.toArray()
    return Ensemble(float(lasso.intercept), tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6))


def _least(rows: DataFrame, most: int) -> DataFrame:
    """The rows whose hash is below a threshold that leaves about most and a twentieth, and some more for small numbers."""
    n, wanted = rows.count(), most + most // 20 + 8 * math.isqrt(most)
    return rows if n <= wanted else rows.where(F.col("\u0001hash") <= int(2**64 * wanted / n) - 2**63)


def held_out(doc_id: str = "doc_id", modulus: int = 5) -> Column:
    """Rows that are never learnt from: crc32 of the id as text divides by the modulus; null ids too."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == 0, F.lit(True))
