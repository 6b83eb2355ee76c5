import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import metrics, votes

SCHEMA = "id string, prompt string, model string, vote boolean"


@pytest.fixture(scope="module")
def verdict_rows():
    rng = random.Random(5)
    return [
        (f"i{i}", p, m, rng.choice([True, True, False, None]))
        for i in range(60)
        for p in ("p0", "p1", "p2")
        for m in ("m0", "m1", "m2", "m3")
        if rng.random() < 0.9
    ]


def number(vote):
    return 0.5 if vote is None else float(vote)


def rule(group, strict):
    n = [number(v) for v in group]
    if strict and 0.5 in n:
        return (None, None, None)
    una = True if min(n) == 1 else False if max(n) == 0 else None
    return (sum(n) > len(n) / 2, una, sum(n) / len(n))


@pytest.mark.parametrize("strict", [False, True])
def test_prompt_votes(spark, verdict_rows, strict):
    groups = defaultdict(list)
    for i, p, _m, v in verdict_rows:
        groups[i, p].append(v)
    df = votes.prompt_votes(spark.createDataFrame(verdict_rows, SCHEMA).repartition(7), strict)
    got = {(r.id, r.prompt): tuple(r)[2:] for r in df.collect()}
    assert got == {k: rule(g, strict) for k, g in groups.items()}


def test_edges(spark):
    rows = [
        ("tie", "p", "a", True), ("tie", "p", "b", False),
        ("none", "p", "a", None), ("one", "p", "a", True),
    ]
    expected = spark.createDataFrame(
        [(k, "p") for k in ("tie", "none", "one", "nobody")], "id string, prompt string"
    )
    df = votes.prompt_votes(spark.createDataFrame(rows, SCHEMA), expected=expected)
    assert {r.id: tuple(r)[2:] for r in df.collect()} == {
        "tie": (False, None, 0.5),
        "none": (False, None, 0.5),
        "one": (True, True, 1.0),
        "nobody": (None, True, None),
    }


VOTES = "id string, prompt string, majority_vote boolean, unanimous_vote boolean, percentage_vote double"


def test_merge(spark):
    rows = [
        ("a", "p", True, True, 1.0), ("a", "q", True, None, 0.75),
        ("b", "p", False, False, 0.0), ("b", "q", False, False, 0.0),
        ("c", "p", None, None, None), ("c", "q", None, None, None),
        ("d", "p", True, True, 1.0), ("d", "q", None, None, None),
    ]
    df = spark.createDataFrame(rows, VOTES)
    merged = {r.id: tuple(r)[1:] for r in votes.merge_prompts(df).collect()}
    assert merged == {
        "a": (True, None, 0.875, True, True),
        "b": (False, False, 0.0, False, False),
        "c": (None, None, None, None, None),
        "d": (True, None, 1.0, True, True),
    }
    compat = {
        r.id: tuple(r)[1:] for r in votes.merge_prompts_grouped(df, compat=True).collect()
    }
    assert compat["b"] == (False, True, 0.0, False)  # rejected by all, yet unanimous
    assert compat["d"] == (True, True, 1.0, True)
    strict = {
        r.id: tuple(r)[1:] for r in votes.merge_prompts_grouped(df, strict=True).collect()
    }
    assert strict["a"] == (True, None, 0.875, True)
    assert strict["d"] == (None, None, None, None)


def test_renaming_models_changes_nothing(spark, verdict_rows):
    df = spark.createDataFrame(verdict_rows, SCHEMA)
    renamed = df.withColumn("model", F.concat(F.lit("x"), F.reverse("model")))
    a, b = (sorted(map(tuple, votes.prompt_votes(d).collect()), key=repr) for d in (df, renamed))
    assert a == b


def test_missing_counts(spark, verdict_rows):
    df = spark.createDataFrame(verdict_rows, SCHEMA)
    got = {(r.model, r.prompt): (r.missing, r.cells) for r in votes.missing_counts(df).collect()}
    assert got[None, None] == (sum(r[3] is None for r in verdict_rows), len(verdict_rows))
    assert len(got) == 1 + 4 + 3


def test_confusion_rates(spark):
    rows = [
        ("1", False), ("2", False), ("3", True), ("4", True), ("5", None), ("6", None), ("7", False),
    ]
    truth = [("1", False), ("2", True), ("3", True), ("4", False), ("5", False), ("6", True), ("7", None)]
    scored = metrics.vote_metrics(
        spark.createDataFrame(rows, "id string, v boolean"),
        spark.createDataFrame(truth, "id string, matches_original boolean"),
        ["v"],
    ).first()
    assert [scored[c] for c in metrics.COUNTS] == [1, 2, 1, 1, 1, 1]
    assert scored.accuracy == 2 / 6 and scored.precision == 1 / 3 and scored.recall == 1 / 3
    assert scored.no_prediction == 2 / 6


def test_rates_without_positives(spark):
    df = spark.createDataFrame([(0, 0, 0, 0, 0, 2)], ", ".join(f"{c} long" for c in metrics.COUNTS))
    row = metrics.rates(df).first()
    assert (row.accuracy, row.precision, row.recall, row.f1_score) == (0, 0, 0, 0)
    assert row.no_prediction is None


def test_loss_inversion(spark):
    rows = [("a", 1.0), ("a", 3.0), ("a", None), ("a", float("nan")), ("b", None)]
    df = spark.createDataFrame(rows, "method string, loss double")
    got = sorted(
        ((r.method, r.score) for r in metrics.invert_losses(df).collect()), key=repr
    )
    assert got == [("a", 0.0), ("a", 1.0), ("a", 1.0), ("a", 2.0), ("b", None)]


def test_match_rate(spark):
    rows = [("x", True), ("x", False), ("y", True), ("y", None)]
    df = spark.createDataFrame(rows, "dataset string, matches_original boolean")
    got = {r.dataset: (r.matches, r.total_rows, r.percentage) for r in metrics.match_rate(df).collect()}
    assert got == {"x": (1, 2, 50.0), "y": (1, 2, 50.0), None: (2, 4, 50.0)}


def test_best_and_mean_run(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 0.75), (2, 0.75)], "run int, score double")
    row = metrics.best_and_mean_run(df).first()
    assert (row.best_run, row.best_score) == (1, 0.75)
    assert row.mean_score == pytest.approx(2 / 3)


def test_custom_votes(spark, verdict_rows):
    import pandas as pd
    from pyspark.sql import types as T

    def any_no(votes: pd.Series) -> bool:
        return bool((votes == False).any())  # noqa: E712

    df = spark.createDataFrame(verdict_rows, SCHEMA)
    own = F.pandas_udf(any_no, T.BooleanType())
    a = {(r.id, r.prompt): r.veto for r in votes.custom_votes(df, own, "veto").collect()}
    built_in = lambda v: F.coalesce(F.bool_or(~v), F.lit(False))
    b = {(r.id, r.prompt): r.veto for r in votes.custom_votes(df, built_in, "veto").collect()}
    assert a == b and any(a.values()) and not all(a.values())


def test_a_hot_item(spark):
    rows = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("id"),
        F.lit("p").alias("prompt"), F.col("id").cast("string").alias("model"),
        (F.col("id") % 2 == 0).alias("vote"),
    )
    hot = votes.prompt_votes(rows.repartition(8)).where("id = 'hot'").first()
    assert (hot.majority_vote, hot.unanimous_vote, hot.percentage_vote) == (False, None, 0.5)


def test_answerable_pairs(spark):
    from tallyframe.operators import agreement

    rows = [("1", "a", None), ("1", "b", False), ("2", "a", True), ("2", "b", False), ("3", "a", False)]
    df = spark.createDataFrame(rows, "id string, annotator string, unanswerable boolean").withColumns(
        {"entries": F.array(), "other_texts": F.array()}
    )
    pairs = agreement.annotator_pairs(df, "a", "b")
    assert sorted(r.id for r in pairs.collect()) == ["1", "2"]
    assert [r.id for r in agreement.answerable_pairs(pairs).collect()] == ["1"]
