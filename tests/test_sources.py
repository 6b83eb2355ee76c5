import json

import pytest
from pyspark.sql import functions as F

from tallyframe import schemas
from tallyframe.functions.prompts import MessageTemplate
from tallyframe.operators import flatten, votes
from tallyframe.sources import registry, tables


def test_json_lines_round_trip(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [("1", None, "0123"), ("2", "", "text")]
    df = spark.createDataFrame(rows, "id string, label string, m string")
    tables.write_json_lines(df, path)
    text = "".join(r.value for r in spark.read.text(path).collect())
    assert '"label":null' in text
    back = tables.read_json_lines(spark, path, schemas.wide_outputs(["m", "absent"]))
    assert sorted(map(tuple, back.collect())) == [("1", None, "0123", None), ("2", "", "text", None)]
    with pytest.raises(Exception, match="already exists"):
        tables.write_json_lines(df, path)


def test_wide_outputs_to_rows(spark, tmp_path):
    path = tmp_path / "w.json"
    path.write_text('{"id": "1", "label": "x", "m0": "a"}\n{"id": "2", "label": "", "m1": "b", "m0": null}\n')
    rows = tables.read_outputs(spark, str(path), "p", ["m0", "m1"])
    assert sorted(((r.id, r.prompt, r.model, r.output) for r in rows.collect()), key=repr) == [
        ("1", "p", "m0", "a"), ("1", "p", "m1", None), ("2", "p", "m0", None), ("2", "p", "m1", "b"),
    ]


def test_folder_scan_keeps_names(spark, tmp_path):
    (tmp_path / "al_10.json").write_text('[\n{"id": "a", "score": 0.5, "distance_from_0.5": 0.0},\n{"id": "b", "score": 0.4, "distance_from_0.5": 0.1}]')
    (tmp_path / "warm.start.json").write_text('[{"id": "c", "score": 0.6, "distance_from_0.5": 0.1}]')
    (tmp_path / "notes.txt").write_text("no json")
    df = tables.read_json_folder(spark, str(tmp_path), schemas.SAMPLES, "run", arrays=True)
    assert sorted((r.run, r.id) for r in df.collect()) == [("al_10", "a"), ("al_10", "b"), ("warm.start", "c")]
    assert sorted(r.run for r in tables.list_datasets(df, "run").collect()) == ["al_10", "warm.start"]


def test_sample_file(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5, 0.0)], schemas.SAMPLES)
    tables.write_samples(df, str(tmp_path / "s"))
    files = list((tmp_path / "s").glob("*.json"))
    assert [json.loads(f.read_text()) for f in files] == [{"id": "a", "score": 0.5, "distance_from_0.5": 0.0}]


def test_relabeled_file(spark, tmp_path):
    record = {
        "id": "1", "unanswerable": False, "erronous_question": True,
        "label": {"b": {"label": "b", "alternative_labels": ["c"], "type": "label"},
                  "a": {"label": "a", "alternative_labels": [], "type": "label_candidate"}},
        "other_labels": [{"text": "t", "begin": 1, "end": 2, "label": "x"}],
    }
    path = tmp_path / "r.json"
    path.write_text(json.dumps([record], indent=2))
    row = tables.read_relabeled(spark, str(path), "ann").first()
    assert [(e.key, e.alternatives, e.type) for e in row.entries] == [
        ("b", ["c"], "label"), ("a", [], "label_candidate"),
    ]
    assert (row.annotator, row.other_texts, row.erronous_question) == ("ann", ["t"], True)


@pytest.fixture()
def source_file(tmp_path):
    documents = [
        {"index": 7, "paras": ["P one .", "P two"], "questions": [
            ["Who ?", [{"answer": "a b .", "from": 0, "end": 3, "para": 0},
                       {"answer": "c", "from": 1, "end": 2, "para": 1}]],
            ["None ?", []],
            ["Partial ?", [{"answer": "x", "from": 0, "end": 1}]],
        ], "origin": "web"},
    ]
    path = tmp_path / "source.json"
    path.write_text(json.dumps(documents))
    return str(path)


def test_source_documents_to_items(spark, source_file):
    documents = tables.read_source_documents(
        spark, source_file, schemas.SOURCE_DOCUMENTS + ", origin string"
    ).withColumn("row", F.lit(0))
    rows = {r.id: r for r in flatten.flatten_questions(documents).collect()}
    assert set(rows) == {"0_0", "0_1", "0_2"}
    assert rows["0_0"].context == "P one .\nP two" and rows["0_0"].origin == "web"
    assert rows["0_0"].label == "a b. ; c"
    assert [(p["from"], p.end, p.para, p.target.answer) for p in rows["0_0"].position_labels] == [
        (0, 3, 0, "a b ."), (1, 2, 1, "c"),
    ]
    assert (rows["0_1"].label, rows["0_1"].position_labels) == ("", [])
    assert (rows["0_2"].label, rows["0_2"].position_labels) == ("x", None)


def test_annotation_text_files(spark, source_file, tmp_path):
    documents = tables.read_source_documents(spark, source_file).withColumn("row", F.lit(3))
    target = tmp_path / "texts"
    tables.write_annotation_texts(documents, str(tmp_path / "table"))
    rows = {r.id: r[1] for r in spark.read.parquet(str(tmp_path / "table")).collect()}
    assert set(rows) == {"3_0", "3_1", "3_2"} and rows["3_0"].startswith("P one .\nP two\n")
    tables.write_annotation_texts(documents, str(target), single_files=True)
    files = {p.parent.name: p.read_text() for p in target.glob("id=*/*.txt")}
    assert files["id=3_0"].rstrip("\n") == "P one .\nP two\n" + "=" * 50 + "\n\n\n.Who ?"
    assert set(files) == {"id=3_0", "id=3_1", "id=3_2"}


KEY = ["id", "prompt", "model"]


def test_column_replacement(spark):
    schema = "id string, prompt string, model string, vote boolean"
    old = spark.createDataFrame([("1", "p", "a", True), ("2", "p", "a", True), ("1", "p", "b", None)], schema)
    new = spark.createDataFrame([("1", "p", "a", False), ("2", "p", "a", None)], schema)
    out = tables.replace_column(old, new, KEY, ["prompt", "model"])
    assert sorted(map(tuple, out.collect())) == [
        ("1", "p", "a", False), ("1", "p", "b", None), ("2", "p", "a", None),
    ]
    added = tables.replace_column(old, new.withColumn("model", F.lit("c")), KEY, ["prompt", "model"])
    assert added.count() == 5
    with pytest.raises(ValueError, match="other"):
        tables.replace_column(old, new.limit(1), KEY, ["prompt", "model"])


def test_registry(spark, tmp_path):
    prompts = [
        registry.Prompt("p1", ("main", "x"), "answer"), registry.Prompt("p0", ("main",), "yes_no"),
        registry.Prompt("p2", ("other",), "yes_no"),
    ]
    table = registry.registry_table(spark, prompts)
    assert sorted(map(tuple, registry.members_of(table, ["main", "x"]).collect())) == [
        ("p0", "yes_no"), ("p1", "answer"),
    ]
    assert registry.names_in(prompts, ["x", "main"]) == ["p0", "p1"]
    with pytest.raises(ValueError):
        registry.names_in(prompts, ["nobody"])
    assert {r.prompt: r.family for r in registry.prompts_table(spark, prompts).collect()}["p1"] == "answer"
    models = registry.registry_table(spark, [registry.Model("m", ("g",))])
    assert models.first().family is None
    (tmp_path / "a.txt").write_text("Hello\n")
    (tmp_path / "b.txt").write_text("Q: {q}")
    loaded = registry.load_templates(
        spark, [(str(tmp_path / "b.txt"), "user", {"q": "question"}), (str(tmp_path / "a.txt"), "assistant", None)]
    )
    assert loaded == [
        MessageTemplate("user", "Q: {q}", {"q": "question"}), MessageTemplate("assistant", "Hello\n"),
    ]
    rows = registry.templates_table(spark, {"p": loaded}).orderBy("seq").collect()
    assert [(r.role, r.variables) for r in rows] == [("user", {"q": "question"}), ("assistant", None)]


def test_verdicts_from_wide_file(spark, tmp_path):
    """File to votes: the whole way a stored output table takes."""
    lines = [
        {"id": "1", "label": "a ; b", "m0": "<answer>b;a</answer>", "m1": "<answer>c</answer>"},
        {"id": "2", "label": "", "m0": None, "m1": "<answer></answer>"},
    ]
    path = tmp_path / "p.json"
    path.write_text("\n".join(json.dumps(x) for x in lines))
    outputs = tables.read_outputs(spark, str(path), "p", ["m0", "m1"])
    prompts = [registry.Prompt("p", (), "answer")]
    labels = outputs.select("id", "label").distinct()
    rows = votes.prompt_votes(votes.verdicts(outputs, prompts, labels))
    assert {r.id: (r.majority_vote, r.unanimous_vote, r.percentage_vote) for r in rows.collect()} == {
        "1": (False, None, 0.5), "2": (True, None, 0.75),
    }


def test_broken_lines_and_files_are_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "1", "n": 2}\n{"id": "2", "n": \n{"id": "3"}\n')
    (tmp_path / "b.json").write_text("")
    checked = tables.read_json_checked(spark, str(tmp_path), "id string, n int")
    assert sorted((r.id or "", r.n, r.broken_record) for r in checked.collect()) == [
        ("", None, '{"id": "2", "n": '), ("1", 2, None), ("3", None, None),
    ]
    assert tables.sound_records(checked).columns == ["id", "n"] and tables.sound_records(checked).count() == 2
    report = {r.file.rsplit("/", 1)[1]: (r.records, r.broken) for r in tables.file_report(checked).collect()}
    assert report == {"a.json": (2, 1)}  # the other one is empty


def test_truncated_array_costs_its_own_file_only(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), None if i % 3 else i) for i in range(20)], "id string, n int")
    tables.write_json_arrays(rows, f"{tmp_path}/arrays", files=3)
    (tmp_path / "arrays" / "part=9").mkdir()
    (tmp_path / "arrays" / "part=9" / "cut.txt").write_text('[{"id": "x", "n": 1}, {"id": "y"')
    checked = tables.read_json_checked(spark, f"{tmp_path}/arrays/*", "id string, n int", arrays=True)
    assert sorted(tables.sound_records(checked).collect()) == sorted(rows.collect())
    report = tables.file_report(checked).collect()
    assert len(report) == 4 and [r.broken for r in report if r.file.endswith("cut.txt")] == [1]


def test_folder_names_as_keys(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b"), (2, "c=d/e"), (3, "a b")], "n int, source string")
    rows.write.partitionBy("source").json(f"{tmp_path}/out")
    read = tables.read_json_folder(spark, f"{tmp_path}/out", "n int", folders=True)
    assert sorted(map(tuple, read.collect())) == [(1, "a b"), (2, "c=d/e"), (3, "a b")]


def test_output_files_are_compressed_and_dealt_out_once(spark, tmp_path):
    text = F.concat(F.lit("thinking "), F.repeat(F.md5(F.col("id").cast("string")), 50), "model")
    cells = spark.range(40).select(
        F.col("id").cast("string").alias("id"),
        F.explode(F.array(F.lit("p"), F.lit("q"))).alias("prompt"),
    ).select("*", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("model"))
    rows = cells.withColumn("output", F.when(F.expr("id % 7 > 0 OR model = 'a'"), text))
    labels = rows.where("id % 10 > 0").select("id", F.lit("x").alias("label")).distinct()
    tables.write_outputs(rows, labels, ["a", "b"], f"{tmp_path}/out")
    back = [tables.read_outputs(spark, f"{tmp_path}/out/prompt={p}", p, ["a", "b"]) for p in "pq"]
    columns = ["id", "prompt", "model", "output"]
    got = back[0].unionByName(back[1]).select(columns).collect()
    assert sorted(map(str, got)) == sorted(map(str, rows.where("id % 10 > 0").select(columns).collect()))
    files = [f for f in (tmp_path / "out").rglob("part-*") if f.is_file()]
    whole = sum(len(r.output or "") for r in got)
    assert all(f.name.endswith(".gz") for f in files) and sum(f.stat().st_size for f in files) < whole / 4
