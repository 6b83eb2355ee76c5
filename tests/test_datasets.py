from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyframe.functions.prompts import MessageTemplate
from tallyframe.operators import agreement, features, learned, relational, sampling
from tallyframe.operators.relational import attach_statistics
from tallyframe.plans import QUERIES, Tables
from tallyframe.sources.registry import Prompt


def test_most_uncertain(spark):
    rows = [("a", 0.5), ("b", 0.45), ("c", 0.55001), ("d", 0.9), ("e", 0.5), ("f", None), ("g", 0.45)]
    scores = spark.createDataFrame(rows, "id string, score double")
    done = spark.createDataFrame([("a",)], "id string")
    got = [tuple(r) for r in sampling.most_uncertain(scores, done, 4).collect()]
    assert got == [("e", 0.5, 0.0), ("b", 0.45, 0.05), ("g", 0.45, 0.05), ("c", 0.55, 0.05)]


def test_split_and_filters(spark):
    items = spark.createDataFrame(
        [("1", "x", "a b"), ("2", "", "a"), ("3", None, "a b c")], "id string, label string, context string"
    )
    moved = spark.createDataFrame([("1",), ("1",), ("9",)], "id string")
    split = {r.id: r.moved for r in relational.split_by_ids(items, moved).collect()}
    assert split == {"1": True, "2": False, "3": False}
    kept, counts = relational.apply_filters(
        items, [relational.drop_empty_labels, lambda df: relational.over_long(df, "context", 2)[0]]
    )
    assert [r.id for r in kept.collect()] == ["1"]
    assert sorted(map(tuple, counts.collect())) == [(1, 2), (2, 1)]
    assert [tuple(r) for r in relational.over_long(items, "context", 2)[1].collect()] == [("3", 3)]
    assert relational.keep_columns(items, ["id"]).columns == ["id"]


def test_rerun_set(spark):
    items = spark.createDataFrame([("1",), ("2",), ("3",)], "id string")
    outputs = spark.createDataFrame(
        [("1", "<answer>x</answer>"), ("2", "oops"), ("3", None), ("9", "")], "id string, output string"
    )
    rerun, orphans = relational.invalid_rerun_set(items, outputs, F.lit("answer"))
    assert sorted(r.id for r in rerun.collect()) == ["2", "3"]
    assert [r.id for r in orphans.collect()] == ["9"]


def test_contracts(spark):
    left = spark.createDataFrame([("1",), ("1",), ("2",), (None,)], "id string")
    right = spark.createDataFrame([("2",), ("3",)], "id string")
    assert relational.contract_report(left, right).first().asDict() == {
        "left_rows": 4, "left_null_ids": 1, "left_repeated_ids": 1, "left_only_ids": 1,
        "right_rows": 2, "right_null_ids": 0, "right_repeated_ids": 0, "right_only_ids": 1,
    }
    with pytest.raises(ValueError, match="missing columns"):
        relational.require_columns(left, ["id", "label"])
    with pytest.raises(ValueError, match="already present"):
        relational.require_columns(left, ["id"], absent=["id"])
    rows = spark.createDataFrame([("m0",), ("m0",)], "model string")
    assert [r.model for r in relational.missing_members(rows, "model", ["m0", "m1"]).collect()] == ["m1"]


def test_statistics_of_every_row(spark):
    rows = spark.range(100).withColumn("k", F.col("id") % 7)
    stats = rows.groupBy("k").agg(F.max("id").alias("top"))
    found = attach_statistics(rows, stats, ["k"]).collect()
    assert len(found) == 100 and all(r.top % 7 == r.k and r.top > 92 for r in found)


def test_null_texts_and_nan_scores(spark):
    rows = spark.createDataFrame([("1", "a b c", 0.7), ("2", None, float("nan")), ("3", "", None)], "id string, text string, score double")
    kept, skipped = relational.over_long(rows, "text", 2)
    assert sorted(r.id for r in kept.collect()) == ["2", "3"] and [r.id for r in skipped.collect()] == ["1"]
    assert [r.id for r in relational.confident(rows, "score", 0.6).collect()] == ["1"]


def test_hash_columns_do_not_depend_on_partitions(spark):
    ids = spark.range(2000).select(F.col("id").cast("string").alias("id"))
    one = {r.id: (r.part, r.baseline_random) for r in
           sampling.random_baseline(sampling.hash_split(ids, 10)).collect()}
    two = {r.id: (r.part, r.baseline_random) for r in
           sampling.random_baseline(sampling.hash_split(ids.repartition(9), 10)).collect()}
    assert one == two
    assert 120 < sum(p == "validation" for p, _ in one.values()) < 280
    assert 800 < sum(b for _, b in one.values()) < 1200


def test_finetune_rows(spark):
    items = spark.createDataFrame(
        [("1", "c1", "q1", "l1"), ("2", "c2", "q2", "l2"), ("3", "c3", "q3", "l3")],
        "id string, context string, question string, label string",
    )
    scores = spark.createDataFrame([("1", 0.9), ("2", 0.5), ("3", 0.8)], "id string, score double")
    verdicts = spark.createDataFrame(
        [("1", "a", True), ("1", "b", True), ("2", "b", True), ("3", "a", False), ("3", "c", True)],
        "id string, model string, vote boolean",
    )
    outputs = spark.createDataFrame(
        [(i, m, f"{i}{m}") for i in "123" for m in "abc"], "id string, model string, output string"
    )
    template = MessageTemplate("user", "{c}:{q}", {"c": "context", "q": "question"})
    rows = sampling.finetune_rows(
        items, template, scores, "score", 0.5, (verdicts, outputs, ["b", "a", "c"])
    )
    assert sorted(map(tuple, rows.collect())) == [("1", "c1:q1", "1b"), ("3", "c3:q3", "3c")]
    plain = sampling.finetune_rows(items, template, scores, "score", 0.85)
    assert [tuple(r) for r in plain.collect()] == [("1", "c1:q1", "l1")]
    chat = sampling.finetune_chats(plain).first().messages
    assert [tuple(m) for m in chat] == [("user", "c1:q1"), ("assistant", "l1")]


def test_feature_rules(spark):
    prompts = [Prompt("a", (), "answer"), Prompt("y", (), "yes_no")]
    labels = spark.createDataFrame([("1", "x ; y"), ("2", ""), ("3", None)], "id string, label string")
    outputs = spark.createDataFrame(
        [
            ("1", "a", "m", "<answer>x ; y</answer>"), ("1", "y", "m", "###yes"),
            ("2", "a", "m", None), ("2", "y", "m", None),
            ("3", "a", "m", "no tag"), ("3", "y", "m", "no tag"),
        ],
        "id string, prompt string, model string, output string",
    )
    def matrix(method):
        names = features.feature_names(prompts, ["m"], method)
        rows = features.feature_rows(outputs, prompts, labels, method)
        return names, {r.id: tuple(r)[1:] for r in features.feature_matrix(rows, names).collect()}

    # a missing output reads "unanswerable": right for an empty label, "no" for a check
    assert matrix("bool") == (["m_a", "m_y"], {"1": (1, 1), "2": (1, 0), "3": (0.5, 0.5)})
    assert matrix("precision_recall") == (
        ["m_a_precision", "m_a_recall", "m_y"],
        {"1": (1, 1, 1), "2": (1, 1, 0), "3": (0.5, 0.5, 0.5)},
    )


@pytest.fixture(scope="module")
def separable(spark):
    noise = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)) / 250
    df = spark.range(400).select(
        F.col("id").cast("string").alias("id"), (F.col("id") % 3 > 0).cast("double").alias("y"),
        F.col("id").alias("n"),
    )
    return df.withColumn("f0", F.col("y") * 0.6 + noise).withColumn("f1", noise).drop("n").cache()


def test_forest_and_storage(spark, separable, tmp_path):
    space = {"numTrees": [5], "maxDepth": [3, 5], "minInstancesPerNode": [1], "featureSubsetStrategy": ["all"]}
    model, runs = learned.train_forest(separable, ["f0", "f1"], rounds=2, tries=2, folds=2, space=space)
    assert len(runs) == 2 and max(f1 for _, f1 in runs) > 0.9
    path = learned.model_path(str(tmp_path), "random_forest", "g", "p", "bool", "1")
    learned.save_model(model, path)
    a = {r.id: r.score for r in learned.score(model, separable).collect()}
    b = {r.id: r.score for r in learned.score(learned.load_model(path), separable).collect()}
    assert a == b and len(a) == 400
    scored = learned.score(model, separable).join(separable.select("id", "y"), "id")
    report = learned.training_report(scored).first()
    baseline = learned.training_report(
        sampling.random_baseline(separable).select("y", F.col("baseline_random").cast("double").alias("score"))
    ).first()
    assert report.accuracy > 0.9 and report.negative_f1 > baseline.negative_f1


def test_perceptron(spark, separable):
    model, runs = learned.train_perceptron(separable, ["f0", "f1"], rounds=1, tries=2, max_iter=40)
    scored = learned.score(model, separable).join(separable.select("id", "y"), "id")
    assert learned.training_report(scored).first().negative_f1 > 0.9 and len(runs) == 1


def test_review_precedence(spark):
    from tallyframe.functions.matching import ENTRY_TYPE

    relabeled = spark.createDataFrame(
        [(i, [("a", "a", [], "label")], False) for i in "1234"],
        f"id string, entries {ENTRY_TYPE}, unanswerable boolean",
    )
    items = spark.createDataFrame(
        [("1", "a", "q"), ("2", "b", "q"), ("3", "b", "q"), ("4", "b", "q")],
        "id string, label string, question string",
    )
    reviews = spark.createDataFrame(
        [("1", "n", 1), ("2", "n", 1), ("2", "y", 2), ("2", "b", 3), ("4", "y", 1)],
        "id string, decision string, ts int",
    )
    prior = relabeled.where("id = '4'").selectExpr(
        "*", "'old' AS original_label", "'old' AS question", "false AS matches_original", "true AS manual_review"
    )
    rows = agreement.evaluate_relabeling(relabeled, items, prior, reviews)
    got = {r.id: (r.original_label, r.matches_original, r.manual_review) for r in rows.collect()}
    assert got == {
        "1": ("a", True, None), "2": ("b", True, True), "3": ("b", False, None), "4": ("old", False, True),
    }
    redone = agreement.evaluate_relabeling(relabeled, items, prior, reviews, redo=True)
    assert {r.id: r.matches_original for r in redone.collect()}["4"] is True
    assert agreement.matched_share(rows).first().asDict() == {"matches": 2, "total_rows": 4, "share": 0.5}


def test_survival_in_one_pass(spark):
    df = spark.createDataFrame([("1", "x", 5), ("2", "", 5), ("3", "x", None), ("4", "x", 9), (None, "x", 1), ("5", "x", 1)], "id string, label string, n int")
    ids = spark.createDataFrame([("1",), ("1",), ("4",), (None,)], "id string")
    steps = [F.col("label") != "", F.col("n") < 9, relational.InSet(ids), relational.InSet(ids.where("id = '4'"), wanted=False)]
    marked = relational.survival(df, steps)
    assert {r.id: r.survived for r in marked.collect()} == {"1": 4, "2": 0, "3": 1, "4": 1, None: 2, "5": 2}
    assert [tuple(r) for r in relational.survivors(marked, 4).collect()] == [("1", "x", 5)]
    counts = relational.step_counts(marked, 4)
    assert sorted(map(tuple, counts.collect())) == [(1, 5), (2, 3), (3, 1), (4, 1)]
    assert sorted(map(tuple, relational.step_counts(marked.limit(0), 2).collect())) == [(1, 0), (2, 0)]


def test_counts_read_the_documents_once(spark):
    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("driver tables not here")
    plan = QUERIES["filter_chain_counts"](Tables(spark, folder))._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in line and "text#" in line for line in plan.splitlines()) == 1


def test_all_annotator_pairs(spark):
    entry = [("x", "x", [], "label")]
    schema = (
        "id string, annotator string, entries array<struct<key:string,label:string,alternatives:array<string>,type:string>>, "
        "other_texts array<string>, unanswerable boolean"
    )
    rows = [("1", who, entry, None, who == "c") for who in "cab"] + [("2", "a", entry, None, None), ("2", None, entry, None, None), ("3", "b", entry, None, None)]
    pairs = agreement.all_annotator_pairs(spark.createDataFrame(rows, schema))
    scores = {(r.annotator_a, r.annotator_b): (r.id, r.iou, r.entity_iou) for r in agreement.pair_scores(pairs).collect()}
    assert scores == {("a", "b"): ("1", 1.0, 1.0), ("a", "c"): ("1", 1.0, None), ("b", "c"): ("1", 1.0, None)}
    kept = agreement.pair_scores(pairs, skip_unanswerable=False).collect()
    assert {r.entity_iou for r in kept} == {1.0}
    assert "Join" not in pairs._jdf.queryExecution().optimizedPlan().toString()
