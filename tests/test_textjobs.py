import json
import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from tallyframe.operators import generation, textjobs
from tallyframe.functions import parsing


def reduced(spark, rows):
    df = spark.createDataFrame(rows, "id string, context string, label string")
    return {r.id: r for r in textjobs.reduce_contexts(df).collect()}


def numbered(n, **named):
    """Sentences ``S0.`` to ``S<n-1>.`` with some of them replaced, joined by a space."""
    return " ".join(named.get(f"s{i}", f"S{i}.") for i in range(n))


def run(first, last):
    return " ".join(f"S{i}." for i in range(first, last + 1))


def test_reduction_by_hand(spark):
    far = numbered(60, s40="A red tea cup!")
    ends = numbered(30, s0="Blue whale here.", s29="Whale blue here.")
    rows = [
        ("none", "Nothing here. At all.", "zz qq"),
        ("empty label", far, ""),
        ("short", "One. Two tea cups. Three.", "tea cups"),
        # ten leading sentences with five after them, and five on both sides of the hit
        ("far", far, "red tea cup"),
        ("part", far, "some red tea thing"),  # "red tea" is a long enough part with a blank
        ("word", far, "teacup"),  # parts of a word do not count
        ("two", ends, "whale blue;Blue whale"),
        ("null", None, "x"),
    ]
    got = reduced(spark, rows)
    kept = f"{run(0, 14)} [...] {run(35, 39)} A red tea cup! {run(41, 45)}"
    assert got["far"].context == got["part"].context == kept
    assert (got["far"].n_sentences, got["far"].n_kept) == (60, 27)
    for name in ("none", "empty label", "short", "word"):
        assert got[name].context == dict((r[0], r[1]) for r in rows)[name]
        assert got[name].reduction == 0.0
    # " blue" is a part with a blank, so the last sentence is a hit as well
    assert got["two"].context == f"Blue whale here. {run(1, 14)} [...] {run(24, 28)} Whale blue here."
    assert got["null"].context is None


def test_reduction_keeps_order_and_all_hits(spark):
    rng = random.Random(6)
    rows, wanted = [], {}
    for i in range(120):
        sentences = [f"Filler {i} {k}." for k in range(rng.randint(12, 70))]
        wanted[str(i)] = sorted(rng.sample(range(len(sentences)), rng.randint(1, 3)))
        for k in wanted[str(i)]:
            sentences[k] = f"Here {k} the green frog sits."
        rows.append((str(i), rng.choice([" ", "  "]).join(sentences), "green frog ; absent thing"))
    got = reduced(spark, rows)
    for name, context, _ in rows:
        parts = [p for p in re.split(r"(?<=\.) +", got[name].context.replace("[...] ", ""))]
        whole = re.split(r"(?<=\.) +", context)
        places = [whole.index(p) for p in parts]
        assert places == sorted(set(places))  # a subsequence of the sentences
        assert set(wanted[name]) <= set(places) and set(range(10)) <= set(places)
        assert all(min(abs(k - w) for w in [*wanted[name], *range(10)]) <= 5 for k in places)


def test_token_tags(spark):
    rows = [
        ("1", "New York is new. New York!", "New York ; new"),
        ("2", "aaaa b", "aa"),
        ("3", "", "x"),
        ("4", "xNew York city", "New York"),
        ("5", "one 😀 two", "two; ;"),
    ]
    df = spark.createDataFrame(rows, "id string, context string, label string")
    got = {r.id: [tuple(t) for t in r.tokens] for r in textjobs.bio_tags(df).collect()}
    assert got["1"] == [
        ("New", 0, 3, 1), ("York", 4, 8, 2), ("is", 9, 11, 0), ("new.", 12, 16, 1),
        ("New", 17, 20, 1), ("York!", 21, 26, 2),
    ]
    assert got["2"] == [("aaaa", 0, 4, 2), ("b", 5, 6, 0)]
    assert got["3"] == []
    assert got["4"] == [("xNew", 0, 4, 2), ("York", 5, 9, 2), ("city", 10, 14, 0)]
    assert got["5"] == [("one", 0, 3, 0), ("😀", 4, 5, 0), ("two", 6, 9, 1)]


SCHEMA = {
    "type": "object",
    "properties": {
        "s": {"type": "string"}, "n": {"type": "number"}, "i": {"type": "integer"},
        "b": {"type": "boolean"}, "any": {},
        "o": {"type": "object", "properties": {"x": {"type": "string"}, "p": {"type": "object", "properties": {"q": {"type": "null"}}}}},
        "l": {"type": "array", "items": {"type": "object", "properties": {"k": {"type": "integer"}}}},
        "plain": {"type": "array", "items": {"type": "string"}},
    },
}


def audited(spark, records):
    rows = [(str(i), json.dumps(r)) for i, r in enumerate(records)]
    out = textjobs.audit_json(spark.createDataFrame(rows, "id string, output string"), SCHEMA)
    found = {}
    for r in out.collect():
        found.setdefault(int(r.id), []).append(tuple(r)[1:])
    return found


def test_json_audit_by_hand(spark):
    flat = [("s", "string"), ("n", "number"), ("i", "integer"), ("b", "boolean"), ("any", "unknown"),
            ("o", "object"), ("l", "array"), ("plain", "array")]
    missing = {key: (key, kind, "missing", kind, 1) for key, kind in flat}
    seen = lambda key, status="existing": (key, dict(flat)[key], status, dict(flat)[key], 1)
    records = [
        {},
        {"s": "t", "n": 2.5, "i": 3, "b": True, "any": None, "plain": ["a"]},
        {"s": 1, "n": "x", "i": 2.5, "b": 0, "o": [], "l": {}},
        {"o": {"x": 1, "p": {"q": None}}},
        {"l": [{"k": 1}, {"k": "z"}, {}]},
    ]
    found = audited(spark, records)
    assert sorted(found[0]) == sorted(missing.values())
    assert set(found[1]) == {*map(seen, ["s", "n", "i", "b", "any", "plain"]), missing["o"], missing["l"]}
    assert set(found[2]) == {
        *[seen(k, "type mismatch") for k in ("s", "n", "i", "b", "o", "l")], missing["any"], missing["plain"],
    }
    assert {f for f in found[3] if f[0].startswith("o")} == {
        seen("o"), ("o.x", "string", "type mismatch", "object.string", 2),
        ("o.p", "object", "existing", "object.object", 2),
        ("o.p.q", "null", "existing", "object.object.null", 3),
    }
    assert {f for f in found[4] if f[0].startswith("l")} == {
        seen("l"),
        ("l[0].k", "integer", "existing", "array.object.integer", 2),
        ("l[1].k", "integer", "type mismatch", "array.object.integer", 2),
        ("l[2].k", "integer", "missing", "array.object.integer", 2),
    }


def test_json_audit_finds_each_key_once_per_parent(spark):
    rng = random.Random(10)
    value = {
        "s": lambda: "t", "n": lambda: 1.5, "i": lambda: 7, "b": lambda: False, "any": lambda: [1],
        "o": lambda: {"x": "y"}, "plain": lambda: ["a", "b"],
        "l": lambda: [{"k": 1}] * rng.randint(0, 3),
    }
    records = [{k: make() for k, make in value.items() if rng.random() < 0.6} for _ in range(100)]
    for i, rows in audited(spark, records).items():
        record, top = records[i], [r for r in rows if r[4] == 1]
        assert sorted(r[0] for r in top) == sorted(value)
        assert {r[0] for r in top if r[2] == "existing"} == set(record)
        assert not any(r[2] == "type mismatch" for r in rows)
        below = [r[0] for r in rows if r[4] == 2]
        expected = [f"l[{k}].k" for k in range(len(record.get("l", [])))]
        assert sorted(below) == sorted(expected + (["o.x", "o.p"] if "o" in record else []))


def test_json_completion():
    cases = {
        '{"a": 1': '{"a": 1}',
        '{"a": [1, {"b": "x': '{"a": [1, {"b": "x"}]}',
        '{"a": 1,': '{"a": 1}',
        '{"a": "br } ace"': '{"a": "br } ace"}',
        '{"a": "q\\" [': '{"a": "q\\" ["}',
        '{"a": 1}': '{"a": 1}',
        '{"a": "x\\\\"': '{"a": "x\\\\"}',
    }
    assert {k: textjobs.complete_json_text(k) for k in cases} == cases


def test_invalid_json_gives_one_row(spark):
    rows = [("1", "{nope"), ("2", None), ("3", '{"s": "a')]
    out = textjobs.audit_json(
        spark.createDataFrame(rows, "id string, output string"), {"properties": {"s": {"type": "string"}}}
    )
    assert sorted((r.id, r.path, r.status) for r in out.collect()) == [
        ("1", None, "invalid"), ("2", None, "invalid"), ("3", "s", "existing"),
    ]


def test_retry_actions(evaluate):
    rows = [("x", True, 1), ("x", True, 3), ("a b c", False, 1), ("a a a a", False, 2), ("a b", False, 3), ("", False, 1)]
    got = evaluate(
        rows, "o string, v boolean, n int",
        generation.retry_action(F.col("o"), F.col("v"), F.col("n")),
    )
    assert got == ["valid", "valid", "append", "retry", "invalid", "append"]


def test_generation_rounds(spark):
    def factory():
        def run(texts, retry):
            if any("crash" in t for t in texts) and not retry:
                raise RuntimeError("out of memory")
            return [
                "<answer>ok</answer>" if "good" in t or "crash" in t
                else "<answer>late</answer>" if "Please Format" in t and "bad" not in t
                else "w w w w w" if "loop" in t else "hm"
                for t in texts
            ]
        return run

    names = ["good", "late", "bad", "loop", "crash"]
    items = spark.createDataFrame(
        [(n, [("user", n)]) for n in names], "id string, messages array<struct<role:string,content:string>>"
    )
    out = generation.generate_with_retries(items, factory, parsing.is_valid_answer, batch_size=1)
    assert {r.id: (r.output, r.attempts) for r in out.collect()} == {
        "good": ("<answer>ok</answer>", 1),
        "late": ("<answer>late</answer>", 2),
        "bad": (None, 3),
        "loop": (None, 3),  # a repetitive output starts over from the original messages
        "crash": ("<answer>ok</answer>", 2),  # the failed batch counted as an empty output
    }


def test_retry_messages_start_from_the_original(spark):
    df = spark.createDataFrame(
        [([("user", "q")], "out", "append"), ([("user", "q")], "out", "retry")],
        "m array<struct<role:string,content:string>>, o string, a string",
    )
    got = [
        [tuple(m) for m in r[0]]
        for r in df.select(generation.retry_messages(F.col("m"), F.col("o"), F.col("a"))).collect()
    ]
    assert got == [
        [("user", "q"), ("assistant", "out"),
         ("user", "Please Format your response as specified in the prompt!")],
        [("user", "q")],
    ]


def test_few_rows_at_a_time_become_python_objects():
    texts, labels = pa.array(["A cat. A dog."] * 200), pa.array(["dog", None] * 100)
    parts = list(textjobs._reduced.func(iter([(texts, labels)])))
    assert [len(p) for p in parts] == [64, 64, 64, 8]
    assert parts[0][0].as_py() == {"context": "A cat. A dog.", "n_sentences": 2, "n_kept": 2}
    assert parts[0][1].as_py() == {"context": "A cat. A dog.", "n_sentences": None, "n_kept": None}
    batch = pa.RecordBatch.from_arrays([pa.array(map(str, range(200))), texts, labels], ["id", "context", "label"])
    tagged = list(textjobs._tag_batches(iter([batch, batch.slice(0, 0)])))
    assert [b.num_rows for b in tagged] == [64, 64, 64, 8]
    assert [t["tag"] for t in tagged[0].column("tokens")[0].as_py()] == [0, 0, 0, 1]
