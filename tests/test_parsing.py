from pyspark.sql import functions as F

from tallyframe.constants import PYTHON_BLANKS
from tallyframe.functions import parsing, prompts, text


def test_answers(evaluate):
    cases = {
        "x <answer>a</answer> y <answer>b ; c</answer>": "b ; c",
        "<answer></answer>": "",
        "no tag": None,
        None: None,
        "(answer)q<|eot_id|>": "q",
        "(Answer)Q<|eot_id|>": "Q",
        "(answer>z<|eot_id|>": "z",
        "(answer)one(answer)": "one",
        "(answer>two<\\/answer>": "two",
        "<Solution><Answer>s</Solution>": "s",
        "<answer>a\nb</answer>": None,
        "<answer>a\rb</answer>": "a\rb",
        "<answer>a b</answer>": "a b",
        "<answer>Unknown</answer>": None,
        "<answer>unknown</answer>": "unknown",
        "<answer>a</answer> then <answer>Not specified here</answer>": None,
        "<answer>None</answer> then <answer>b</answer>": "b",
        "(answer)a<|eot_id|> b<|eot_id|>": "a<|eot_id|> b",
    }
    got = evaluate([(k,) for k in cases], "s string", parsing.parse_answer(F.col("s")))
    assert dict(zip(cases, got)) == cases


def test_answer_validity_ignores_the_markers(evaluate):
    rows = [("<answer>Unknown</answer>",), ("nothing",), (None,), ("<answer>a\n</answer>",)]
    assert evaluate(rows, "s string", parsing.is_valid_answer(F.col("s"))) == [
        True, False, False, False,
    ]


def test_yes_no(evaluate):
    cases = {
        "###yes": "yes",
        "### no": "no",
        "###\n\tyes": "yes",
        "### no": "no",
        "###\x1cno": "no",
        "###Yes": None,
        "###no then ### yes": "yes",
        None: None,
        "##yes": None,
    }
    got = evaluate([(k,) for k in cases], "s string", parsing.parse_yes_no(F.col("s")))
    assert dict(zip(cases, got)) == cases
    valid = evaluate([(k,) for k in cases], "s string", parsing.is_valid_yes_no(F.col("s")))
    assert valid == [v is not None for v in cases.values()]
    strict = evaluate([(k,) for k in cases], "s string", parsing.strict_yes_no(F.col("s")))
    assert strict == [True, None, None, None, None, None, False, None, None]


def test_yes_no_against_label(evaluate):
    rows = [("yes", "yes"), ("no", "yes"), ("maybe", "yes"), (None, "yes")]
    got = evaluate(
        rows, "p string, l string", parsing.yes_no_equals_label(F.col("p"), F.col("l"))
    )
    assert got == [True, False, None, None]


def test_exact_match(evaluate):
    rows = [
        ("b ; a", "a ; b"), ("a ; a", "a"), ("", ""), (None, "a"), ("a;b", " b ;a "), ("a;", "a"),
    ]
    got = evaluate(rows, "p string, l string", parsing.exact_match(F.col("p"), F.col("l")))
    assert got == [True, False, True, None, True, False]


def test_blanks_are_pythons(evaluate):
    rows = [(f"{c}a{c}b{c}",) for c in PYTHON_BLANKS] + [("​a​",)]
    assert evaluate(rows, "s string", text.strip(F.col("s"))) == [r[0].strip() for r in rows]
    assert evaluate(rows, "s string", text.words(F.col("s"))) == [r[0].split() for r in rows]


def test_csv_and_points(evaluate):
    rows = [("a, b ,c",), ("",), (None,), ("a,",)]
    assert evaluate(rows, "s string", text.split_csv(F.col("s"))) == [
        ["a", "b", "c"], [], None, ["a", ""],
    ]
    assert evaluate([("x . y .",)], "s string", text.blank_points(F.col("s"))) == ["x. y."]


def test_repetition(evaluate):
    rows = [("a a a a",), ("a b c",), ("",), ("a a a b b b c c c c",), ("a b c a b c a b c a",)]
    assert evaluate(rows, "s string", text.is_repetitive(F.col("s"))) == [
        True, False, False, False, False,
    ]


def test_transform_columns_skips_missing(spark):
    df = spark.createDataFrame([("<answer>x</answer>", "###no")], "a string, b string")
    out = parsing.transform_columns(df, ["a", "zz"], parsing.raw_answer)
    out = parsing.transform_columns(out, ["b"], parsing.strict_yes_no, "_decision")
    assert out.columns == ["a", "b", "a_parsed", "b_decision"]
    assert out.first()[2:] == ("x", False)


def test_raw_answer_keeps_markers(evaluate):
    assert evaluate([("<answer>None</answer>",)], "s string", parsing.raw_answer(F.col("s"))) == [
        "None"
    ]


def test_word_precision_recall(evaluate):
    rows = [("a b b", "B c"), ("", "x"), ("x", None), ("  ", "x"), ("q", "q")]
    got = evaluate(
        rows, "p string, l string", parsing.word_precision_recall(F.col("p"), F.col("l"))
    )
    assert [None if g is None else tuple(g) for g in got] == [
        (0.5, 0.5), None, None, (0.0, 0.0), (1.0, 1.0),
    ]


def test_empty_labels(evaluate):
    rows = [("",), (None,), ("a;b",)]
    assert evaluate(rows, "s string", parsing.replace_empty_label(F.col("s"))) == [
        "Not specified in the given Context", None, "a;b",
    ]
    assert evaluate(rows, "s string", parsing.feature_label(F.col("s"))) == [
        "unanswerable", "unanswerable", "a b",
    ]


def test_messages(spark):
    df = spark.createDataFrame([("{question}", None, 3)], "context string, question string, n int")
    templates = [
        prompts.MessageTemplate("system", "raw {context} {{x}}"),
        prompts.MessageTemplate(
            "user", "{c}|{q}|{n}|{{x}}|{c}", {"c": "context", "q": "question", "n": "n"}
        ),
    ]
    messages = df.select(prompts.render_messages(templates).alias("m")).first().m
    assert [tuple(m) for m in messages] == [
        ("system", "raw {context} {{x}}"),
        ("user", "{question}|None|3|{x}|{question}"),
    ]
    chat = df.select(prompts.chat_text(prompts.render_messages(templates[1:]))).first()[0]
    assert chat == "<|user|>\n{question}|None|3|{x}|{question}\n<|assistant|>\n"


def test_own_family(spark, monkeypatch):
    monkeypatch.setattr(parsing, "FAMILIES", dict(parsing.FAMILIES))
    parsing.register_family(
        "length",
        parsing.PromptFamily(
            lambda c: c.isNotNull(), lambda c: F.length(c).cast("string"), lambda p, label: p > label
        ),
    )
    df = spark.createDataFrame(
        [("length", "abcdef", "a"), ("yes_no", "###yes", "a"), ("other", "###yes", "a")],
        "family string, output string, label string",
    )
    parsed = parsing.parse_output(F.col("family"), F.col("output"))
    got = df.select(
        parsing.is_valid_output(F.col("family"), F.col("output")).alias("v"), parsed.alias("p")
    ).collect()
    assert [tuple(r) for r in got] == [(True, "6"), (True, "yes"), (False, None)]
