from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import functions as F

from tallyframe.operators import votes
from tallyframe.operators.votes import prompt_votes
from tallyframe.plans.catalog import QUERIES, Tables
from tallyframe.session import ensure_checkpoint_dir
from tallyframe.sources import registry
from tallyframe.streaming.votes import ITEM_STREAM, VoteTable, read_stream, start_votes

PROMPTS = [registry.Prompt("p", (), "yes_no"), registry.Prompt("q", (), "answer")]
MODELS = ["m", "m0", "m1", "m2", "m3"]
OUTPUT = "id string, prompt string, model string, output string, ts bigint"


class Arrivals:
    """Waves of output and item files, and the votes after each."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.table = spark, str(folder), VoteTable(f"{folder}/tables")
        for name, schema in (("in", OUTPUT), ("items", ITEM_STREAM)):
            spark.createDataFrame([], schema).write.json(f"{folder}/{name}")

    def wave(self, outputs=(), items=()):
        if outputs:
            rows = self.spark.createDataFrame(list(outputs), OUTPUT)
            rows.withColumn("ts", F.timestamp_seconds("ts")).write.mode("append").json(f"{self.folder}/in")
        if items:
            self.spark.createDataFrame(list(items), ITEM_STREAM).write.mode("append").json(f"{self.folder}/items")
        self.query = start_votes(
            read_stream(self.spark, f"{self.folder}/in"),
            read_stream(self.spark, f"{self.folder}/items", ITEM_STREAM),
            PROMPTS, MODELS, self.table, f"{self.folder}/state",
        )
        self.query.awaitTermination()
        return self.votes()

    def votes(self):
        columns = ["id", "prompt", "majority_vote", "unanimous_vote", "percentage_vote"]
        return sorted(map(tuple, self.table.votes(self.spark).select(columns).collect()))


def test_stream_equals_batch(spark, tmp_path):
    rows = [(str(i % 20), "p", f"m{i // 20}", "###yes" if i % 3 == 0 else "###no", 1000 + i) for i in range(80)]
    items = [(str(i), "x") for i in range(20)]
    fixed = [("3", "p", f"m{k}", "### yes", 9000) for k in range(4)]
    late = [("4", "p", "m0", "oops", 1)]
    stranger = [("999", "p", "m0", "###yes", 5)]
    arrivals = Arrivals(spark, tmp_path)
    arrivals.wave(rows[:60], items)
    arrivals.wave(rows[60:] + fixed)
    got = arrivals.wave(late + stranger)
    newest = {r[:3]: r[3] for r in sorted(rows + fixed, key=lambda r: r[4])}
    outputs = spark.createDataFrame([(*k, v) for k, v in newest.items()], "id string, prompt string, model string, output string")
    batch = votes.prompt_votes(votes.verdicts(outputs, PROMPTS, spark.createDataFrame(items, ITEM_STREAM)))
    columns = ["id", "prompt", "majority_vote", "unanimous_vote", "percentage_vote"]
    assert got == sorted(map(tuple, batch.select(columns).collect()))
    assert ("3", "p", True, True, 1.0) in got
    arrivals.table.compact(spark)
    assert arrivals.votes() == got
    again = arrivals.wave([("5", "p", "m0", "###yes", 9999)])
    assert len(again) == 20 and [r for r in again if r[0] != "5"] == [r for r in got if r[0] != "5"]


def test_ties_missing_times_and_late_items(spark, tmp_path):
    tie = [("a", "p", "m", "###yes", 5), ("a", "p", "m", "###no", 5)]
    results = []
    for number, order in enumerate((tie, tie[::-1])):
        arrivals = Arrivals(spark, tmp_path / str(number))
        assert arrivals.wave(order[:1]) == []  # its item has not come
        assert arrivals.wave(order[1:]) == []
        results.append(arrivals.wave([("b", "p", "m", "###yes", None), ("c", "q", "m", "<answer>x</answer>", 1)], [("a", "l"), ("b", "l")]))
    assert results[0] == results[1] == [("a", "p", True, True, 1.0), ("b", "p", True, True, 1.0)]
    assert arrivals.wave(items=[("c", "x")])[2] == ("c", "q", True, True, 1.0)
    assert arrivals.wave([("b", "p", "m", "###no", 0)])[1] == ("b", "p", False, False, 0.0)
    assert arrivals.wave([("b", "p", "m", "###yes", None)])[1] == ("b", "p", False, False, 0.0)


def test_a_batch_reads_and_writes_its_own_keys(spark, tmp_path):
    arrivals = Arrivals(spark, tmp_path)
    arrivals.wave([(str(i), "p", "m", "###yes", 1) for i in range(50)], [(str(i), "l") for i in range(50)])
    arrivals.wave([("7", "p", "m", "###no", 2)])
    changes = spark.read.parquet(arrivals.table.changes)
    assert {r.id for r in changes.where("batch = 1").collect()} == {"7"}


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    table = VoteTable(str(tmp_path))
    assert table.votes(spark).count() == 0
    answers = spark.createDataFrame([("a", "p", "m", "yes_no", "yes", "l")], "id string, prompt string, model string, family string, answer string, label string")
    for _ in range(2):
        table.add(answers, 0)
    assert [tuple(r) for r in table.votes(spark).collect()] == [("a", "p", True, True, 1.0)]


def test_a_late_answer_rewrites_one_row_of_the_state(spark, tmp_path):
    arrivals = Arrivals(spark, tmp_path)
    rows = [(str(i), "p", f"m{k}", "###yes", 5) for i in range(40) for k in range(4)]
    arrivals.wave(rows, [(str(i), "l") for i in range(40)])
    got = arrivals.wave([("7", "p", "m2", "###no", 2), ("9", "p", "m2", "###no", 9)])
    written = [p["stateOperators"][0]["numRowsUpdated"] for p in arrivals.query.recentProgress if p["numInputRows"]]
    assert written == [2]  # of 80 rows of the state
    assert ("7", "p", True, True, 1.0) in got and ("9", "p", True, None, 0.75) in got


def test_unlisted_models_are_left_out(spark, tmp_path):
    got = Arrivals(spark, tmp_path).wave([("a", "p", "other", "###no", 1), ("a", "p", "m", "###yes", 1)], [("a", "l")])
    assert got == [("a", "p", True, True, 1.0)]


def test_unfinished_folders_are_not_read(spark, tmp_path):
    table = VoteTable(str(tmp_path))
    answers = spark.createDataFrame([("a", "p", "m", "yes_no", "yes", "l")], "id string, prompt string, model string, family string, answer string, label string")
    table.add(answers, 0)
    table.compact(spark)
    table.add(answers.selectExpr("id", "prompt", "model", "family", "'no' AS answer", "label"), 1)
    before = table.votes(spark).collect()
    table.compact(spark)
    (tmp_path / "whole" / "upto=1" / "_SUCCESS").unlink()  # as if it were being written
    (tmp_path / "whole" / "upto=1" / "part-bad.parquet").write_bytes(b"half")
    assert table.votes(spark).collect() == before
    table.compact(spark)
    assert table.votes(spark).collect() == before


def test_files_that_arrive_are_compressed(spark, tmp_path):
    rows = [(k, f"text {k} " * 50, "en", "web", 350) for k in range(24)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    ensure_checkpoint_dir(spark)
    root = Path(urlparse(spark.sparkContext.getCheckpointDir()).path)
    before = set(root.glob("stream-*"))
    votes = QUERIES["stream_votes"](Tables(spark, str(tmp_path)))
    wanted = prompt_votes(Tables(spark, str(tmp_path)).verdicts).withColumn("percentage_vote", F.round("percentage_vote", 9))
    assert sorted(votes.collect()) == sorted(wanted.select(votes.columns).collect())
    (own,) = set(root.glob("stream-*")) - before
    files = [f.name for f in (own / "in").glob("part-*")]
    assert files and all(name.endswith(".json.gz") for name in files)
