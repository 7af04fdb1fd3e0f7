import math
import re

from pyspark.sql import functions as F

from panelframe.llm import cascade, rule_ensemble
from panelframe.llm.stats import counts_of

CLEAN = "This is an ordinary sentence of more than ten words, written with care. And here is another one."
ROWS = [
    (1, CLEAN), (2, "few words"), (3, None), (4, ""), (5, "&&& " * 30 + CLEAN), (6, CLEAN.upper()), (7, "a b c d e f g h " * 20), (8, "no no yes yes go go on on we we do do ok ok"),
    (9, "12 34 56 78 90 12 34 56 78 90 11"), (10, CLEAN + " " + "word" * 100_000),
]


def test_verdicts_do_not_depend_on_order(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("counts_", F.lit(0))
    seen = []
    for rules in (cascade.RULES, cascade.RULES[::-1]):
        out = cascade.verdict(df.withColumn("counts", counts_of("text")), rules)
        seen.append({r.doc_id for r in out.where("rejected_by is null").collect()})
    kept = cascade.keep(df, share=1.0)
    assert kept.columns == df.columns
    assert seen == [{1, 10}, {1, 10}] and {r.doc_id for r in kept.collect()} == {1, 10}


def test_order_is_by_rejections_per_second_of_what_is_left():
    e = [cascade.Estimate(r, s, 100, n) for r, s, n in zip(cascade.RULES[:3], (1.0, 0.1, 2.0), (10, 5, 50), strict=True)]
    order = lambda rules, counts, together: [r.name for r in cascade.ordered(cascade.Estimates(tuple(rules), counts, together))]
    names = [r.name for r in cascade.RULES]
    assert order(e, 0.0, {0: 35, 1: 10, 2: 5, 4: 50}) == [names[i] for i in (1, 2, 0)]
    # the second rejects nothing that the third leaves, so that the first comes before it
    assert order(e, 0.0, {0: 45, 1: 4, 4: 40, 6: 5, 5: 6}) == [names[i] for i in (1, 2, 0)]
    assert order(e, 0.0, {0: 40, 1: 10, 4: 45, 6: 5}) == [names[i] for i in (1, 2, 0)]
    assert order(e[:1] + e[2:], 0.0, {0: 40, 1: 1, 3: 9, 2: 50}) == [names[i] for i in (2, 0)]
    # counts are paid for once: by the first rule that reads them
    c = [cascade.Estimate(r, 0.1, 100, n) for r, n in zip(cascade.RULES[2:5], (5, 20, 10), strict=True)]
    assert order(c, 0.0, {0: 65, 1: 5, 2: 20, 4: 10}) == [names[i] for i in (3, 4, 2)]
    assert order(c, 10.0, {0: 65, 1: 5, 2: 20, 4: 10}) == [names[i] for i in (2, 3, 4)]


def test_estimates_cover_the_sample(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    found = cascade.estimate(df, share=1.0)
    e = {x.rule.name: x for x in found.rules}
    assert e["few_words"].rows == len(ROWS) == sum(found.together.values()) and e["few_words"].rejected == 3 and e["symbols"].rejected >= 1
    assert cascade.keep(df.limit(0)).count() == 0


def test_paths_are_conjunctions():
    tree = """DecisionTreeModel
  If (feature 0 <= 1.5)
   If (feature 1 <= 2.0)
    Predict: 0.0
   Else (feature 1 > 2.0)
    Predict: 1.0
  Else (feature 0 > 1.5)
   If (feature 0 <= 3.0)
    Predict: 0.0
   Else (feature 0 > 3.0)
    Predict: 1.0
"""
    c = rule_ensemble.Condition
    assert rule_ensemble.paths(tree) == [(c(0, False, 1.5),), (c(0, False, 1.5), c(1, False, 2.0)), (c(0, False, 1.5), c(1, True, 2.0)), (c(0, True, 1.5),), (c(0, False, 3.0), c(0, True, 1.5)), (c(0, True, 3.0),)]


def labelled():
    good = [(i, f"{CLEAN} Number {i} differs from the rest of them, as it should.", 1) for i in range(120)]
    bad = [(1000 + i, f"buy$$$ now### {i} &&& " * (5 + i % 7), 0) for i in range(60)]
    return good + bad


def test_held_out_accuracy(spark):
    rows = labelled()
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, label int")
    stats = rule_ensemble.with_statistics(df)
    model = rule_ensemble.fit(stats.where(~rule_ensemble.held_out()).join(labels, "doc_id"), trees=6)
    assert model.rules
    out = stats.select("doc_id", rule_ensemble.held_out().alias("h"), model.column().alias("score")).join(labels, "doc_id", "left").collect()
    assert len(out) == len(rows) + 2 and all(0 <= r.score <= 1 for r in out)
    test = [r for r in out if r.h and r.label is not None]
    assert test and all((r.score >= 0.3) == (r.label == 1) for r in test)


def test_score_by_walking_the_rules(spark):
    """The compiled column against the rules walked one by one, the statistics against plain Python, the rules against the forest."""
    rows = labelled() + [(6000, "Odd\n\nlines. Odd\n!? 12 &&", 1), (6001, None, 0), (6002, "x " * 500, 0)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, label int")
    stats = rule_ensemble.with_statistics(df)
    model = rule_ensemble.fit(stats.join(labels, "doc_id"), trees=5)
    got = {r.doc_id: r for r in stats.select("*", model.column().alias("score")).collect()}
    texts = {i: t or "" for i, t, _ in rows}
    for i, r in got.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[i])
        n = max(len(words), 1)
        assert r.words == len(words) and r.distinct_words == len(set(words)) / n and r.word_length == sum(map(len, words)) / n
        assert r.adjacent_words == sum(a == b for a, b in zip(words, words[1:], strict=False)) / n and r.symbols == sum(c in "#*$%&|<>" for c in texts[i]) / n
        z = model.intercept
        for rule, weight in model.rules:
            hit = True
            for c in rule:
                x = r[rule_ensemble.NAMES[c.feature]]
                hit = hit and (x > c.threshold if c.above else x <= c.threshold)
            z += weight * hit
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9
    assert all(len({(c.feature, c.above) for c in rule}) == len(rule) for rule, _ in model.rules)


def test_fit_takes_the_least_hashes(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.xxhash64("id", F.lit(5)).alias("\u0001hash"))
    some = rule_ensemble._least(df, 500)
    assert 500 <= some.count() < 1000
    assert {r.doc_id for r in some.orderBy("\u0001hash").limit(500).collect()} == {r.doc_id for r in df.orderBy("\u0001hash").limit(500).collect()}
    assert rule_ensemble._least(df, 5000).count() == 5000


def test_one_class_only(spark):
    df = spark.createDataFrame([(1, CLEAN), (2, "x")], "doc_id long, text string")
    stats = rule_ensemble.with_statistics(df)
    assert stats.select(rule_ensemble.fit(stats.withColumn("label", F.lit(1))).column().alias("s")).first().s > 0.9
    none = rule_ensemble.fit(stats.withColumn("label", F.lit(None).cast("int")))
    assert abs(stats.select(none.column().alias("s")).first().s - 0.5) < 1e-9
