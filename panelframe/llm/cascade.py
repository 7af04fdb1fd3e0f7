"""Operator 6: a short-circuit cascade of quality rules.

Each rule's cost and selectivity are estimated on a sample (a share of the rows,
chosen by hash). The least of several runs is a rule's time, after a run that warms up and without what an empty
job takes; the counts that some rules share are timed apart and charged once, to the first of these rules that is
chosen. One job counts which rules reject together, so that every step of the order knows what the
rules before it left: the next rule is the one with most rejections, among the rows that are left, per second that these rows take.
The cascade evaluates a later rule only for what the
earlier ones left: as one CASE expression (verdict) or as a chain of filters
(keep). The order changes what is paid for, never which rows are rejected; the
rule named for a row rejected by several is the first of the order.

Null and empty texts have no words and are rejected by few_words. Ties in the
order keep the order given. An empty sample leaves the order as given.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelframe.llm.shared import bounded_batches, free_name, saved
from panelframe.llm.stats import counts_of


@dataclass(frozen=True)
class Rule:
    """reject(text, counts) is true for what goes; counted: whether it reads counts."""

    name: str
    reject: Callable[[Column, Column], Column]
    counted: bool = False


def _few_words(text: Column, c: Column) -> Column:
    return c["n_words"] < 10


def _repeats(text: Column, c: Column) -> Column:
    return 100 * c["n_repeat_words"] > 20 * c["n_words"]


def _stutter(text: Column, c: Column) -> Column:
    return 10 * c["n_adjacent"] > 3 * c["n_words"]


def _same_lines(text: Column, c: Column) -> Column:
    return 2 * c["n_dup_lines"] > c["n_lines"]


def _number(text: Column, others: str) -> Column:
    """How many characters are left without the runs of others: regexp_count would make a string of every match."""
    return F.length(F.regexp_replace(text, F.lit(others), F.lit("")))


def _symbols(text: Column, c: Column) -> Column:
    return 50 * _number(text, r"[^#*$%&|<>]+") > F.length(text)


def _capitals(text: Column, c: Column) -> Column:
    return _number(text, r"\P{Lu}+") > _number(text, r"\P{Ll}+")


def _no_letter(text: Column, c: Column) -> Column:
    return ~text.rlike(r"\p{L}")


#: The two rules of the base and five more, cheapest guess first.
RULES = (
    Rule("no_letter", _no_letter),
    Rule("symbols", _symbols),
    Rule("capitals", _capitals),
    Rule("few_words", _few_words, counted=True),
    Rule("repeats", _repeats, counted=True),
    Rule("stutter", _stutter, counted=True),
    Rule("same_lines", _same_lines, counted=True),
)


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    seconds: float
    rows: int
    rejected: int


@dataclass(frozen=True)
class Estimates:
    """Of each rule; seconds for the counts; how many rows each set of rules (bits in the order given) rejects."""

    rules: tuple[Estimate, ...]
    counts_seconds: float
    together: dict[int, int]


def _condition(rule: Rule, text: Column, counted: Column) -> Column:
    return F.coalesce(rule.reject(text, counted), F.lit(False))


def _seconds(df: DataFrame, what: Column, repeats: int) -> float:
    """The least time of several runs of a job that evaluates a boolean for every row, after one that warms up."""
    took = []
    for _ in range(repeats + 1):
        began = time.perf_counter()
        df.agg(F.count_if(what)).first()
        took.append(time.perf_counter() - began)
    return min(took[1:])


def estimate(df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", share: float = 1 / 64, counts: str | None = None, repeats: int = 2) -> Estimates:
    """Cost and selectivity of the rules on the rows whose text's hash falls in the share.

    counts names a struct column with the counts if df has it already; they then cost nothing more.
    """
    bounded_batches(df.sparkSession)
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    picked = df.where(F.pmod(F.xxhash64(F.lit("cascade"), t), F.lit(1 << 20)) < int(share * (1 << 20)))
    sample = saved(picked.select(t.alias("text"), (F.col(f"`{counts}`") if counts else counts_of(t)).alias("counts")), "cascade-sample")
    hits = [_condition(r, F.col("text"), F.col("counts")) for r in rules]
    bits = sum((F.when(h, F.lit(1 << i)).otherwise(0) for i, h in enumerate(hits)), F.lit(0))
    together = {r["bits"]: r["n"] for r in sample.groupBy(bits.alias("bits")).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 2 ** rules rows
    n = sum(together.values())
    bare = _seconds(sample, F.col("text").isNotNull(), repeats)
    own = [max(_seconds(sample, h, repeats) - bare, 1e-6) for h in hits]
    shared = 0.0 if counts or not any(r.counted for r in rules) else max(_seconds(sample, counts_of(F.col("text"))["n_words"] >= 0, repeats) - bare, 0.0)
    return Estimates(tuple(Estimate(r, s, n, sum(k for b, k in together.items() if b >> i & 1)) for i, (r, s) in enumerate(zip(rules, own, strict=True))), shared, together)


def ordered(found: Estimates) -> list[Rule]:
    """Step by step the rule with most rejections per second among the rows that the rules before it left."""
    left, places, out, paid = dict(found.together), list(range(len(found.rules))), [], False
    total = max(sum(left.values()), 1)
    while places:
        rows = sum(left.values()) / total

        def gain(i: int, rows=rows, left=left, paid=paid) -> float:
            e = found.rules[i]
            cost = e.seconds + (found.counts_seconds if e.rule.counted and not paid else 0.0)
            return sum(n for bits, n in left.items() if bits >> i & 1) / max(cost * rows, 1e-9)

        best = max(places, key=gain)  # the first of equals
        places.remove(best)
        out.append(found.rules[best].rule)
        paid |= found.rules[best].rule.counted
        left = {bits: n for bits, n in left.items() if not bits >> best & 1}
    return out


def verdict(df: DataFrame, rules: Sequence[Rule], text: str = "text", counts: str = "counts", out: str = "rejected_by") -> DataFrame:
    """Adds the name of the first rule that rejects the row, null if none does; df has the counts.

    A CASE expression evaluates its branches in turn and stops at the first that holds.
    """
    t, chosen = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), None
    for rule in rules:
        hit = _condition(rule, t, F.col(f"`{counts}`"))
        chosen = F.when(hit, F.lit(rule.name)) if chosen is None else chosen.when(hit, F.lit(rule.name))
    return df.withColumn(out, F.lit(None).cast("string") if chosen is None else chosen)


def keep(df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", share: float = 1 / 64) -> DataFrame:
    """The rows that no rule rejects, with df's columns; the counts are made only for what the rules before left."""
    columns, c = df.columns, free_name(df, "counts")
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    for rule in ordered(estimate(df, rules, text, share)):
        if rule.counted and c not in df.columns:
            df = df.withColumn(c, counts_of(t))
        df = df.where(~_condition(rule, t, F.col(f"`{c}`") if rule.counted else F.lit(None)))
    return df.select(*[F.col(f"`{x}`") for x in columns])
