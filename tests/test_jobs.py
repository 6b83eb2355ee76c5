"""A small project from raw outputs to evaluation, through the stored tables."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallyframe.functions.matching import ENTRY_TYPE
from tallyframe.functions.prompts import MessageTemplate
from tallyframe.operators import generation
from tallyframe.plans import jobs
from tallyframe.sources import dealt
from tallyframe.sources.registry import Model, Prompt, PromptRecord

MODELS = [Model("a", ("all", "pair")), Model("b", ("all", "pair")), Model("c", ("all",))]
PROMPTS = [Prompt("check", ("main",), "yes_no"), Prompt("answer", ("main", "answers"), "answer")]
TEMPLATE = MessageTemplate("user", "{c}? {q}", {"c": "context", "q": "question"})


@pytest.fixture(scope="module")
def ws(spark, tmp_path_factory):
    ws = jobs.Workspace(spark, str(tmp_path_factory.mktemp("project")), MODELS, PROMPTS)
    items = spark.range(60).select(
        F.col("id").cast("string").alias("id"),
        F.concat(F.lit("ctx "), "id").alias("context"), F.lit("who").alias("question"),
        F.concat(F.lit("l"), "id").alias("label"),
    )
    ws.store("items", items, "train")
    right = F.col("id") % 3 > 0  # every third label is wrong
    for k, model in enumerate("abc"):
        agrees = F.when(F.col("id") % 7 == k, ~right).otherwise(right)
        rows = spark.range(60)
        yes = rows.select(
            F.col("id").cast("string").alias("id"), F.lit("check").alias("prompt"), F.lit(model).alias("model"),
            F.when(F.col("id") % 11 == k, "?").when(agrees, "###yes").otherwise("### no").alias("output"),
        )
        said = F.when(agrees, F.concat(F.lit("l"), "id")).otherwise("zz")
        answer = rows.select(
            F.col("id").cast("string").alias("id"), F.lit("answer").alias("prompt"), F.lit(model).alias("model"),
            F.concat(F.lit("<answer>"), said, F.lit("</answer>")).alias("output"),
        )
        ws.store("outputs", yes.unionByName(answer), "train", "prompt", "model")
    relabeled = spark.range(50).select(
        F.col("id").cast("string").alias("id"),
        F.array(
            F.struct(
                F.concat(F.when(right, "l").otherwise("w"), "id").alias("key"),
                F.concat(F.when(right, "l").otherwise("w"), "id").alias("label"),
                F.array().cast("array<string>").alias("alternatives"), F.lit("label").alias("type"),
            )
        ).cast(ENTRY_TYPE).alias("entries"),
        F.lit(None).cast("array<struct<text:string,begin:int,end:int,label:string>>").alias("other_labels"),
        F.lit(False).alias("unanswerable"), F.lit(False).alias("erronous_question"),
        F.explode(F.array(F.lit("ann"), F.lit("bob"))).alias("annotator"),
    )
    ws.store("relabeled", relabeled, "train", "annotator")
    share = jobs.evaluate_relabeled(ws, "train", "ann", first=True).first()
    assert (share.matches, share.total_rows) == (33, 50)
    jobs.aggregate_votes(ws, "train", "all", "main")
    return ws


def test_scores_are_stored_per_name(ws):
    jobs.aggregate_votes(ws, "train", "pair", "main", strict=True)
    names = {r.score_name: r["count"] for r in ws.read("scores", "train").groupBy("score_name").count().collect()}
    assert names["percentage_vote_main-all"] == 60
    assert names["percentage_vote_main-pair_no_nan"] == 60
    assert ws.read("verdicts", "train").count() == 60 * 6
    with pytest.raises(ValueError, match="no outputs"):
        jobs.aggregate_votes(
            jobs.Workspace(ws.spark, ws.root, [*MODELS, Model("d", ("all",))], PROMPTS), "train", "all", "main"
        )


def test_evaluations(ws):
    jobs.add_random_baseline(ws, "train")
    losses = ws.read("items", "train").select(
        "id", F.lit("loss").alias("method"), F.when(F.col("id") != "3", F.col("id").cast("double")).alias("loss")
    )
    jobs.add_loss_baselines(ws, "train", losses)
    names = ["percentage_vote_main-all", "baseline_random", "baseline_loss"]
    areas = {r.curve: r.auc_pr for r in jobs.evaluate_auc_pr(ws, "train", names, complete=True).collect()}
    assert set(areas) == set(names) and areas[names[0]] > areas["baseline_random"]
    ranking = {r.curve: r.max_f1 for r in jobs.evaluate_f1_ranking(ws, "train", names).collect()}
    assert ranking[names[0]] > 0.8
    half = {r.curve: r.f1_score for r in jobs.evaluate_f1_at(ws, "train", names).collect()}
    assert set(half) == set(names)


def test_search_and_counts(ws):
    found = jobs.search_ensembles(ws, "train", "pair,all", "main")
    assert found["votes"].count() == 7 * 3 * 2 and found["auc_pr"].count() == 21
    assert found["best_threshold"].count() == found["at_half"].count() == 21
    assert {r.metric for r in found["best"].collect()} == {"f1_score", "accuracy", "precision", "recall"}
    total = jobs.count_missing(ws, "train", "all", "main").where("model IS NULL AND prompt IS NULL").first()
    assert (total.cells, total.missing) == (360, sum(1 for k in range(3) for i in range(60) if i % 11 == k))
    assert jobs.correctness(ws).where("dataset IS NULL").first().total_rows >= 50


def test_learned_scores(ws):
    space = {"numTrees": [5], "maxDepth": [3], "minInstancesPerNode": [1], "featureSubsetStrategy": ["all"]}
    runs = jobs.train_classifier(
        ws, "train", "random_forest", "all", "main", "bool", "r1", tries=1, folds=2, space=space
    )
    assert len(runs) == 1
    summary = jobs.training_summary(ws, "train").first()
    assert (summary.kind, summary.best_run, summary.best_score) == ("random_forest", runs[0][0], runs[0][1])
    jobs.score_with_classifier(ws, "train", "random_forest", "all", "main", "bool", "r1")
    name = "random_forest_all_main_bool_r1"
    assert ws.read("scores", "train").where(F.col("score_name") == name).count() == 60
    jobs.sample_uncertain(ws, "train", name, 4, "al_1")
    sampled = {r.id for r in ws.read("al_samples", "train").collect()}
    assert len(sampled) == 4 and not sampled & {str(i) for i in range(50)}


def test_moving_sampled_rows(ws):
    ws.store("al_samples", ws.spark.createDataFrame([("1", 0.5, 0.0, "x")], "id string, score double, distance double, run_id string"), "train", "run_id")
    jobs.move_sampled(ws, "train", "rest", "sampled")
    assert [r.id for r in ws.read("relabel_evaluation", "sampled").collect()] == ["1"]
    assert ws.read("relabel_evaluation", "rest").count() == 49


def test_moving_in_place(ws):
    evaluated = ws.read("relabel_evaluation", "train")
    ids = [r.id for r in evaluated.orderBy("id").limit(12).collect()]
    for name, moved in (("own", ids[:3]), ("all", ids)):
        ws.store("relabel_evaluation", evaluated.where(F.col("id").isin(ids)), name)
        ws.store("al_samples", ws.spark.createDataFrame([(i, 0.5, 0.0, "x") for i in moved], "id string, score double, distance double, run_id string"), name, "run_id")
        jobs.move_sampled(ws, name, name, f"{name}_sampled")
        left = {r.id for r in ws.read("relabel_evaluation", name).collect()}
        gone = {r.id for r in ws.read("relabel_evaluation", f"{name}_sampled").collect()}
        assert gone == set(moved) and left == set(ids) - gone
    assert ws.recover() == 0


def test_broken_off_replacement_is_finished(ws, monkeypatch):
    rows = ws.read("relabel_evaluation", "train").limit(5)
    ws.store("relabel_evaluation", rows, "broken")
    kept = {r.id for r in ws.read("relabel_evaluation", "broken").collect()}
    with monkeypatch.context() as patch:
        patch.setattr(jobs.Workspace, "_switch", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            ws.store("relabel_evaluation", ws.read("relabel_evaluation", "broken").limit(2), "broken", staged=True)
    assert {r.id for r in ws.read("relabel_evaluation", "broken").collect()} == kept
    assert ws.recover() == 1
    assert ws.read("relabel_evaluation", "broken").count() == 2


def test_generator_that_always_raises(ws):
    def factory():
        def fail(texts, retry):
            raise ValueError("no model")

        return fail

    with pytest.raises(RuntimeError, match="raised for all 60"):
        jobs.run_generation(ws, "train", PROMPTS[0], "dead", [TEMPLATE], factory)


def test_quality_and_agreement(ws):
    rows = {r.model: r for r in jobs.prediction_quality(ws, "train", "all", PROMPTS[1]).collect()}
    right = sum((i % 3 > 0) != (i % 7 == 0) for i in range(60))
    assert rows["a"].exact_match == pytest.approx(right / 60)
    again = {r.model: r for r in jobs.prediction_quality(ws, "train", "all", PROMPTS[1], "ann").collect()}
    assert again["a"].n == 50
    row = jobs.compare_annotators(ws, "train", "ann", "bob").first()
    assert (row.n_items, row.mean_iou, row.mean_entity_iou, row.unanswerable_agreement) == (50, 1.0, 1.0, 1.0)


def test_finetuning(ws):
    jobs.build_finetuning(ws, "train", TEMPLATE, PROMPTS[1], "percentage_vote_main-all", 0.9, "b")
    rows = {r.id: (r.input, r.output) for r in ws.read("finetune", "train").collect()}
    assert rows["5"] == ("ctx 5? who", "<answer>l5</answer>") and "3" not in rows


def test_generation_and_failed_reruns(ws):
    def factory():
        return lambda texts, retry: ["###yes" if "CTX 1" in t else "hm" for t in texts]

    def later():
        return lambda texts, retry: ["### no" for _ in texts]

    shout = [lambda df: df.withColumn("context", F.upper("context"))]
    drop = [lambda df: df.where("id != '19'")]
    skipped = jobs.run_generation(
        ws, "train", PROMPTS[0], "new", [TEMPLATE], factory, shout, drop, max_words=5
    )
    assert skipped.count() == 0
    mine = lambda: {
        r.id: r.output for r in ws.read("outputs", "train").where("model = 'new'").collect()
    }
    first = mine()
    assert len(first) == 60 and first["1"] == "###yes" and first["2"] is None and first["19"] is None
    jobs.run_generation(ws, "train", PROMPTS[0], "new", [TEMPLATE], later, filters=drop, only_failed=True)
    second = mine()
    assert len(second) == 60 and second["1"] == "###yes" and second["2"] == "### no"
    assert second["19"] is None
    skipped = jobs.run_generation(
        ws, "train", PROMPTS[0], "none", [TEMPLATE], factory, max_words=2
    )
    assert skipped.count() == 60
    assert ws.read("outputs", "train").where("model = 'none' AND output IS NULL").count() == 60


def test_texts_stored_in_buckets_are_not_shuffled(ws, tmp_path):
    stored = jobs.Workspace(ws.spark, str(tmp_path / "buckets"), MODELS, PROMPTS, buckets=3)
    for table, partition in (("items", ()), ("outputs", ("prompt", "model"))):
        stored.store(table, ws.read(table, "train"), "train", *partition)
    for table, partition in (("verdicts", ("prompt", "model")), ("scores", ("score_name",))):
        stored.store(table, ws.read(table, "train"), "train", *partition)
    arguments = ("train", TEMPLATE, PROMPTS[1], "percentage_vote_main-all", 0.9, "b")
    rows = jobs.finetuning_rows(stored, *arguments)
    before = ws.spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for threshold in ("-1", before):
            ws.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            rows = jobs.finetuning_rows(stored, *arguments)
            plan = rows._jdf.queryExecution().explainString(
                ws.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
            )
            moved = [part for part in plan.split("\n\n") if "Exchange" in part.split("\n")[0] and "output#" in part]
            assert not moved and (threshold == before or "Bucketed: true" in plan)
            assert sorted(rows.collect()) == sorted(jobs.finetuning_rows(ws, *arguments).collect())
    finally:
        ws.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_buckets_keep_other_partitions_and_are_found_again(ws, tmp_path):
    root = str(tmp_path / "again")
    stored = jobs.Workspace(ws.spark, root, MODELS, PROMPTS, buckets=2)
    rows = ws.read("outputs", "train")
    stored.store("outputs", rows, "train", "prompt", "model")
    stored.store("outputs", rows.withColumn("output", F.lit("new")).where("model = 'a'"), "train", "prompt", "model")
    other = jobs.Workspace(ws.spark, root, MODELS, PROMPTS, buckets=2)
    ws.spark.sql(f"DROP TABLE {other._registered('outputs')}")  # as in a session of its own
    for found in (other.by_id("outputs", "train"), other.read("outputs", "train")):
        assert found.count() == rows.count()
        assert found.where("output = 'new'").select("model").distinct().collect() == [("a",)]


def test_generation_goes_on_after_a_break(ws, tmp_path):
    calls = ws.spark.sparkContext.accumulator(0)

    def factory(broken):
        def answer(text):
            calls.add(1)
            if broken and "ctx 7?" in text:
                raise generation.Interrupted("gone")
            return "###yes" if "retry" in text or "1?" not in text else "no verdict"

        return lambda texts, retry: [answer(text + " retry" * retry) for text in texts]

    project = jobs.Workspace(ws.spark, str(tmp_path / "p"), MODELS, PROMPTS)
    project.store("items", ws.read("items", "train"), "train")
    ask = lambda broken: jobs.run_generation(
        project, "train", PROMPTS[0], "a", [TEMPLATE], lambda: factory(broken), run="first"
    )
    with pytest.raises(Exception, match="gone"):
        ask(True)
    stored = generation.StoredRounds(ws.spark, f"{project.root}/_generation/train/check/a/first")
    kept = stored.round(1).count()
    assert 0 < kept < 60
    before = calls.value
    ask(False)
    outputs = project.read("outputs", "train").collect()
    assert len(outputs) == 60 and {r.output for r in outputs} == {"###yes"}
    retried = sum(str(i).endswith("1") for i in range(60))
    assert calls.value - before == 60 - kept + retried  # nothing committed was asked again
    assert not stored._committed(1)


def test_later_items_are_asked_beside_committed_ones(spark, tmp_path):
    stored = generation.StoredRounds(spark, str(tmp_path / "r"), parts=2)
    make = lambda ids: spark.createDataFrame(
        [(i, [("user", f"q{i}")]) for i in ids], "id string, messages array<struct<role:string,content:string>>"
    )
    ask = lambda ids, text: sorted(
        (r.id, r.output) for r in generation.generate_resumably(
            make(ids), lambda: lambda texts, retry: [text] * len(texts), lambda output: F.lit(True), stored
        ).collect()
    )
    assert ask(["a", "b", "b"], "one") == [("a", "one"), ("b", "one"), ("b", "one")]
    assert ask(["b", "b", "c", "d"], "two") == [("b", "one"), ("b", "one"), ("c", "two"), ("d", "two")]


def test_prompts_are_found_by_name(ws, tmp_path):
    project = jobs.Workspace(ws.spark, str(tmp_path / "named"), MODELS, PROMPTS)
    project.store("items", ws.read("items", "train").withColumn("label", F.expr("if(id = '3', '', label)")), "train")
    records = [
        PromptRecord("check", ("main",), "yes_no", (MessageTemplate("system", "s {x}"), TEMPLATE), ("drop_empty_labels",)),
        PromptRecord("other", (), "answer", (TEMPLATE,)),
    ]
    project.save_prompts(records)
    assert [project.prompt(r.name) for r in records] == records
    with pytest.raises(ValueError, match="no prompt gone"):
        project.prompt("gone")
    with pytest.raises(ValueError, match="unheard"):
        project.save_prompts([PromptRecord("x", (), "answer", (), ("unheard",))])
    asked = ws.spark.sparkContext.accumulator(0)

    def factory():
        def answer(texts, retry):
            asked.add(sum("s {x}" in text and "who" in text for text in texts))
            return ["###yes"] * len(texts)

        return answer

    jobs.run_generation(project, "train", "check", "a", None, factory)
    rows = {r.id: r.output for r in project.read("outputs", "train").collect()}
    assert asked.value == 59 and rows.pop("3") is None and set(rows.values()) == {"###yes"}
    jobs.build_finetuning(project, "train", None, "check")
    tuned = {r.id: r.input for r in project.read("finetune", "train").collect()}
    assert len(tuned) == 59 and tuned["7"] == "ctx 7? who"


def test_stored_texts_are_packed_and_not_sorted_by_partition(ws, tmp_path):
    rows = ws.read("outputs", "train").where("model IN ('a', 'b')").orderBy("id", "model", "prompt").coalesce(1)
    for name, buckets in (("plain", None), ("dealt", 2)):
        stored = jobs.Workspace(ws.spark, str(tmp_path / name), MODELS, PROMPTS, buckets)
        before = ws.spark.conf.get(jobs.WRITERS)
        stored.store("outputs", rows, "train", "prompt", "model")
        assert ws.spark.conf.get(jobs.WRITERS) == before
        files = list((tmp_path / name / "outputs").rglob("*.parquet"))
        kinds = {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files}
        assert kinds == {"ZSTD"} and (buckets or len(files) == 4)
        got = stored.read("outputs", "train")
        assert sorted(got.select(rows.columns).collect()) == sorted(rows.collect())


def test_alike_texts_of_an_id_are_stored_and_dealt_out_once(ws, tmp_path):
    stored = jobs.Workspace(ws.spark, str(tmp_path / "alike"), MODELS, PROMPTS, buckets=2)
    digits = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: F.sha2(F.concat("id", k.cast("string")), 256)), "")
    names = F.explode(F.array(*[F.struct(F.lit(p).alias("prompt"), F.lit(m).alias("model")) for p in ("check", "answer") for m in "abcdefgh"]))
    rows = ws.spark.range(200).select(F.col("id").cast("string").alias("id"), digits.alias("text"), names.alias("n")).select(
        "id", "n.prompt", "n.model", F.concat("n.model", "text").alias("output")
    )
    before = ws.spark.conf.get(jobs.CLEANUP)
    stored.store("outputs", rows, "train", "prompt", "model")
    assert ws.spark.conf.get(jobs.CLEANUP) == before
    # 1.3 MB of digits, half of it once packed, and 16 times as many in all outputs
    assert sum(f.stat().st_size for f in (tmp_path / "alike" / "outputs").rglob("*.parquet")) < 1.5e6
    got = stored.by_id("outputs", "train").select(rows.columns)
    assert got.exceptAll(rows).isEmpty() and got.count() == rows.count()


def test_rows_are_dealt_out_as_by_repartition(spark, monkeypatch):
    monkeypatch.setattr(dealt, "GATHERED", 1)
    rows = spark.range(500).select(
        F.when(F.col("id") % 50 > 0, F.col("id").cast("string")).alias("id"),
        F.when(F.col("id") % 3 > 0, F.repeat(F.lit("\u00e9"), F.col("id").cast("int"))).alias("text"),
        F.array(F.struct(F.col("id").alias("a"))).alias("list"),
    )
    place = lambda df: sorted(map(str, df.withColumn("p", F.spark_partition_id()).collect()))
    assert place(dealt.dealt_out(rows, 7, "id")) == place(rows.repartition(7, "id"))
    assert dealt.dealt_out(rows.limit(0), 7, "id").count() == 0


def test_later_calls_replace_what_they_store(ws, tmp_path, monkeypatch):
    root = tmp_path / "calls"
    stored = jobs.Workspace(ws.spark, str(root), MODELS, PROMPTS, buckets=2)
    rows = ws.read("outputs", "train").where("model IN ('a', 'b')")
    now = lambda text, where: stored.store(
        "outputs", rows.where(where).withColumn("output", F.lit(text)), "7", "prompt", "model"
    )
    texts = lambda found: sorted((r.prompt, r.model, r.output, r.n) for r in found.groupBy("prompt", "model", "output").agg(F.count("*").alias("n")).collect())
    stored.store("outputs", rows, "other", "prompt", "model")
    now("first", "true")
    now("second", "model = 'a' AND prompt = 'check'")
    now("third", "model = 'a' AND prompt = 'check' AND CAST(id AS INT) < 9")
    want = [("answer", "a", "first", 60), ("answer", "b", "first", 60), ("check", "a", "third", 9), ("check", "b", "first", 60)]
    for again in (False, True):
        if again:  # a call that broke off before it was noted, and a session of its own
            ws.spark.sql(f"DROP TABLE {stored._registered('outputs')}")
            with monkeypatch.context() as patched:
                patched.setattr(jobs.Workspace, "_replace", lambda *_: 1 / 0)
                with pytest.raises(ZeroDivisionError):
                    now("broken off", "true")
        for found in (stored.by_id("outputs", "7"), stored.read("outputs", "7")):
            assert set(found.columns) == {"id", "prompt", "model", "output"} and texts(found) == want
        assert stored.read("outputs", "other").count() == 240
    assert len(list((root / "outputs" / "dataset=7").glob("store_call=*"))) == 3  # the second went
    assert texts(stored.outputs("7", ["a"], PROMPTS)) == [want[0], want[2]]
    with pytest.raises(ValueError, match="'c'"):
        stored.outputs("7", ["a", "c"], PROMPTS)
    stored.store("outputs", stored.read("outputs", "7").where("model = 'b'").withColumn("output", F.lit("own")), "7", "prompt", "model", staged=True)
    assert texts(stored.read("outputs", "7"))[1::2] == [("answer", "b", "own", 60), ("check", "b", "own", 60)]
    with pytest.raises(ValueError, match="buckets"):
        jobs.Workspace(ws.spark, str(root), MODELS, PROMPTS).store("outputs", rows, "7", "prompt", "model")
    stored.drop("outputs", "7")
    with pytest.raises(ValueError, match="no outputs"):
        stored.outputs("7", ["a"], PROMPTS)


def test_buckets_in_a_folder_for_each_partition_are_kept_up(ws, tmp_path, monkeypatch):
    stored = jobs.Workspace(ws.spark, str(tmp_path / "older"), MODELS, PROMPTS, buckets=2)
    rows = ws.read("outputs", "train")
    with monkeypatch.context() as patched:
        patched.setattr(jobs.Workspace, "_by_call", lambda *_: False)
        stored.store("outputs", rows, "train", "prompt", "model")
    stored.store("outputs", rows.where("model = 'a'").withColumn("output", F.lit("new")), "train", "prompt", "model")
    for found in (stored.by_id("outputs", "train"), stored.read("outputs", "train")):
        assert found.count() == rows.count()
        assert found.where("output = 'new'").select("model").distinct().collect() == [("a",)]
    assert stored.outputs("train", ["a", "b"], PROMPTS).count() == rows.where("model IN ('a', 'b')").count()
