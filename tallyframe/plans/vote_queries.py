"""Queries: parsing, verdicts, votes and their metrics."""

from pyspark.sql import functions as F

from tallyframe.functions import parsing
from tallyframe.operators import metrics, relational, votes
from tallyframe.plans.catalog import (
    ANSWER_PROMPTS,
    CHECK_PROMPTS,
    MODELS,
    PROMPT_NAMES,
    PROMPTS,
    query,
    rounded,
)
from tallyframe.sources.registry import family_of

RATES = ("accuracy", "precision", "recall", "f1_score", "no_prediction")
MERGED = [
    "majority_vote",
    "unanimous_vote",
    "model_unanimous_prompt_majority_vote",
    "model_majority_prompt_unanimous_vote",
]


def vote_sql(source: str, strict: bool = False) -> str:
    rule = "count(vote) = count(*)" if strict else "TRUE"
    return f"""SELECT id, prompt,
     CASE WHEN {rule} THEN (count(*) FILTER (WHERE vote)) > (count(*) FILTER (WHERE NOT vote)) END AS majority_vote,
     CASE WHEN NOT ({rule}) THEN NULL WHEN (count(*) FILTER (WHERE vote)) = count(*) THEN TRUE
          WHEN (count(*) FILTER (WHERE NOT vote)) = count(*) THEN FALSE END AS unanimous_vote,
     CASE WHEN {rule} THEN
      round(avg(CASE WHEN vote IS NULL THEN 0.5E0 WHEN vote THEN 1.0E0 ELSE 0.0E0 END), 9) END AS percentage_vote
     FROM {source} GROUP BY id, prompt"""


@query(vote_sql("fx_pred"))
def prompt_votes(t):
    return rounded(votes.prompt_votes(t.verdicts), "percentage_vote")


@query(vote_sql("fx_pred", strict=True))
def prompt_votes_strict(t):
    return rounded(votes.prompt_votes(t.verdicts, strict=True), "percentage_vote")


@query(
    """, voted AS (SELECT * FROM fx_pred WHERE id IN (SELECT id FROM fx_truth)),
    tally AS (SELECT id, prompt, count(*) AS n, (count(*) FILTER (WHERE vote)) AS t, (count(*) FILTER (WHERE NOT vote)) AS f
     FROM voted GROUP BY id, prompt)
    SELECT e.id, e.prompt, t > f AS majority_vote,
     CASE WHEN n IS NULL OR t = n THEN TRUE WHEN f = n THEN FALSE END AS unanimous_vote,
     round((t + 0.5E0 * (n - t - f)) / n, 9) AS percentage_vote
    FROM (SELECT DISTINCT id, prompt FROM fx_pred) e LEFT JOIN tally USING (id, prompt)"""
)
def votes_without_voters(t):
    """Items nobody voted on keep a row: NULL, TRUE and NULL."""
    voted = relational.restrict_to(t.verdicts, t.truth)
    expected = t.items.select(
        "id", F.explode(F.array(*[F.lit(p) for p in PROMPT_NAMES])).alias("prompt")
    )
    return rounded(votes.prompt_votes(voted, expected=expected), "percentage_vote")


@query(vote_sql("fx_line_votes"))
def line_votes(t):
    return rounded(votes.prompt_votes(t.line_votes), "percentage_vote")


@query(
    "SELECT id, majority_vote, unanimous_vote, round(percentage_vote, 9) AS percentage_vote, "
    "model_unanimous_prompt_majority_vote, model_majority_prompt_unanimous_vote FROM fx_merged"
)
def merged_votes(t):
    return rounded(votes.merge_prompts(votes.prompt_votes(t.verdicts)), "percentage_vote")


@query(
    """SELECT id,
     CASE WHEN count(majority_vote) = count(*) THEN (count(*) FILTER (WHERE majority_vote)) * 2 > count(*) END AS majority_vote,
     CASE WHEN count(unanimous_vote) < count(*) THEN NULL
          WHEN (count(*) FILTER (WHERE unanimous_vote)) = count(*) THEN TRUE
          WHEN (count(*) FILTER (WHERE NOT unanimous_vote)) = count(*) THEN FALSE END AS unanimous_vote,
     CASE WHEN count(percentage_vote) = count(*) THEN round(avg(percentage_vote), 9) END AS percentage_vote,
     CASE WHEN count(majority_vote) = count(*) THEN (count(*) FILTER (WHERE majority_vote)) = count(*) END
      AS model_majority_prompt_unanimous_vote
    FROM ("""
    + vote_sql("fx_pred", strict=True)
    + ") GROUP BY id"
)
def merged_votes_strict(t):
    rows = votes.prompt_votes(t.verdicts, strict=True)
    return rounded(votes.merge_prompts_grouped(rows, strict=True), "percentage_vote")


@query(
    """SELECT id,
     CASE WHEN count(majority_vote) > 0 THEN (count(*) FILTER (WHERE majority_vote)) * 2 > count(majority_vote) END AS majority_vote,
     CASE WHEN (count(*) FILTER (WHERE percentage_vote <> 0 AND unanimous_vote)) = (count(*) FILTER (WHERE percentage_vote <> 0)) THEN TRUE
          WHEN (count(*) FILTER (WHERE percentage_vote <> 0 AND NOT unanimous_vote)) = (count(*) FILTER (WHERE percentage_vote <> 0)) THEN FALSE
     END AS unanimous_vote,
     round(avg(percentage_vote), 9) AS percentage_vote,
     CASE WHEN count(majority_vote) > 0 THEN (count(*) FILTER (WHERE majority_vote)) = count(majority_vote) END
      AS model_majority_prompt_unanimous_vote
    FROM fx_votes GROUP BY id"""
)
def merged_votes_compat(t):
    rows = votes.prompt_votes(t.verdicts)
    return rounded(votes.merge_prompts_grouped(rows, compat=True), "percentage_vote")


@query("SELECT id, prompt, model, answer FROM fx_answers")
def parse_answers(t):
    return votes.parse_outputs(t.outputs, ANSWER_PROMPTS).drop("family")


# The seven forms of an answer tag, then texts that hold no answer.
ANSWER_FORMS = [
    "<answer>{}</answer>", "(answer>{}<\\/answer>", "(answer){}(answer)", "(answer){}<|eot_id|>",
    "(Answer){}<|eot_id|>", "(answer>{}<|eot_id|>", "<Solution><Answer>{}</Solution>",
    "<answer>Unknown</answer>", "<answer>None of {}</answer>",
    "<answer>No Information provided</answer>", "(answer)Not specified here<|eot_id|>", "{}",
]


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 12 < 7 THEN lang || ' ; ' || source END AS answer
    FROM documents"""
)
def parse_answer_forms(t):
    """Every document's text ends in one of the forms of an answer tag, or in none."""
    said = F.concat_ws(" ; ", "lang", "source")
    output = F.lit(None).cast("string")
    for k, form in enumerate(ANSWER_FORMS):
        before, _, after = form.partition("{}")
        parts = [F.lit(before), said, F.lit(after)] if "{}" in form else [F.lit(form)]
        output = F.when(F.col("doc_id") % len(ANSWER_FORMS) == k, F.concat(*parts)).otherwise(output)
    return t["documents"].select(
        F.col("doc_id").cast("string").alias("id"),
        parsing.parse_answer(F.concat("text", F.lit("\n"), output)).alias("answer"),
    )


@query("SELECT id, prompt, model, answer FROM fx_yes_no")
def parse_yes_no(t):
    return votes.parse_outputs(t.outputs, CHECK_PROMPTS).drop("family")


@query(
    """SELECT prompt, model, (count(*) FILTER (WHERE CASE WHEN prompt LIKE 'answer%'
      THEN regexp_matches(output, '<answer>[^\\n]*?</answer>')
      ELSE regexp_matches(output, '###\\s*(yes|no)') END)) AS n_valid, count(*) AS n
    FROM fx_out GROUP BY prompt, model"""
)
def output_validity(t):
    valid = parsing.is_valid_output(family_of(PROMPTS, F.col("prompt")), F.col("output"))
    return (
        t.outputs.groupBy("prompt", "model")
        .agg(F.count_if(valid).alias("n_valid"), F.count(F.lit(1)).alias("n"))
    )


@query("SELECT id, prompt, model, vote FROM fx_verdicts")
def verdicts(t):
    return votes.verdicts(t.outputs, PROMPTS, t.items)


@query(
    """SELECT y.id, prompt, model, answer,
     CASE WHEN answer IN ('yes', 'no') THEN answer = CASE WHEN matches_original THEN 'yes' ELSE 'no' END END AS agrees
    FROM fx_yes_no y JOIN fx_truth l ON l.id = y.id"""
)
def yes_no_against_label(t):
    label = F.when(F.col("matches_original"), "yes").otherwise("no")
    answers = votes.parse_outputs(t.outputs, CHECK_PROMPTS)
    return answers.join(t.truth, "id").select(
        "id", "prompt", "model", "answer",
        parsing.yes_no_equals_label(F.col("answer"), label).alias("agrees"),
    )


@query(
    """, wide AS (SELECT doc_id, text || chr(10) || '###' || CASE WHEN doc_id % 2 = 0 THEN 'yes' ELSE ' no' END AS m0,
      CASE WHEN doc_id % 3 > 0 THEN text || ' <answer>' || lang || '</answer>' END AS m1 FROM documents)
    SELECT doc_id, regexp_extract_all(m0, '###(yes|no)', 1)[-1] = 'yes' AS m0_decision,
     regexp_extract_all(m1, '###(yes|no)', 1)[-1] = 'yes' AS m1_decision,
     regexp_extract_all(m0, '<answer>([^\\n]*?)</answer>', 1)[-1] AS m0_parsed,
     regexp_extract_all(m1, '<answer>([^\\n]*?)</answer>', 1)[-1] AS m1_parsed FROM wide"""
)
def multi_column_parse(t):
    """Both column parsers over a wide table; a listed column it lacks is skipped."""
    text, n = F.col("text"), F.col("doc_id")
    wide = t["documents"].select(
        "doc_id",
        F.concat(text, F.lit("\n###"), F.when(n % 2 == 0, "yes").otherwise(" no")).alias("m0"),
        F.when(
            n % 3 > 0, F.concat(text, F.lit(" <answer>"), "lang", F.lit("</answer>"))
        ).alias("m1"),
    )
    columns = ["m0", "m1", "absent"]
    wide = parsing.transform_columns(wide, columns, parsing.strict_yes_no, "_decision")
    return parsing.transform_columns(wide, columns, parsing.raw_answer).drop("m0", "m1")


def confusion_sql(vote: str, n: str = "1") -> str:
    wrong = "coalesce(NOT matches_original, FALSE)"

    def total(condition: str, name: str) -> str:
        return f"CAST(coalesce(sum(CASE WHEN {condition} THEN {n} END), 0) AS BIGINT) AS {name}"

    return ",\n".join(
        [
            total(f"NOT {vote} AND {wrong}", "tp"),
            total(f"NOT {vote} AND NOT {wrong}", "fp"),
            total(f"{vote} AND NOT {wrong}", "tn"),
            total(f"{vote} AND {wrong}", "fn"),
            total(f"{vote} IS NULL AND {wrong}", "none_fn"),
            total(f"{vote} IS NULL AND NOT {wrong}", "none_fp"),
        ]
    )


RATE_SQL = """
 round(coalesce((tp + tn) / nullif(tp + tn + fp + fn + none_fn, 0), 0E0), 9) AS accuracy,
 round(coalesce(tp / nullif(tp + fp, 0), 0E0), 9) AS "precision",
 round(coalesce(tp / nullif(tp + fn + none_fn, 0), 0E0), 9) AS recall,
 round(coalesce(2E0 * tp / nullif(2 * tp + fp + fn + none_fn, 0), 0E0), 9) AS f1_score,
 round((none_fp + none_fn) / nullif(tp + tn + fp + fn + none_fn, 0), 9) AS no_prediction
"""


@query(
    f""", joined AS (SELECT m.*, l.matches_original FROM fx_merged m JOIN fx_truth l ON l.id = m.id),
    long AS ({" UNION ALL ".join(f"SELECT '{c}' AS c, {c} AS vote, matches_original FROM joined" for c in MERGED)}),
    counts AS (SELECT c, {confusion_sql("vote")} FROM long GROUP BY c)
    SELECT c AS "column", tp, fp, tn, fn, none_fn, none_fp, {RATE_SQL} FROM counts"""
)
def vote_metrics(t):
    merged = votes.merge_prompts(votes.prompt_votes(t.verdicts))
    return rounded(metrics.vote_metrics(merged, t.truth, MERGED), *RATES)


@query(
    f""", v AS ({vote_sql("fx_verdicts")}),
    joined AS (SELECT prompt, majority_vote AS vote, matches_original FROM v JOIN fx_truth l ON l.id = v.id),
    counts AS (SELECT prompt, {confusion_sql("vote")} FROM joined GROUP BY prompt)
    SELECT prompt, 'majority_vote' AS "column", tp, fp, tn, fn, none_fn, none_fp, {RATE_SQL} FROM counts"""
)
def text_to_metrics(t):
    """End to end: raw texts, parsed, judged, voted and measured per prompt."""
    rows = votes.prompt_votes(votes.verdicts(t.outputs, PROMPTS, t.items))
    return rounded(metrics.vote_metrics(rows, t.truth, ["majority_vote"], ["prompt"]), *RATES)


@query(
    """SELECT model, prompt, (count(*) FILTER (WHERE vote IS NULL)) AS missing, count(*) AS cells
    FROM fx_pred GROUP BY GROUPING SETS ((model), (prompt), ())"""
)
def null_counts(t):
    return votes.missing_counts(t.verdicts)


@query(
    """, wide AS (SELECT id, prompt, any_value(vote) FILTER (model = 'm0') AS m0,
      any_value(vote) FILTER (model = 'm1') AS m1, any_value(vote) FILTER (model = 'm2') AS m2,
      any_value(vote) FILTER (model = 'm3') AS m3 FROM fx_pred GROUP BY id, prompt)
    SELECT id, prompt, m0, m1, m2, m3 FROM wide"""
)
def wide_verdicts(t):
    """Long verdicts to one column per model, back to rows, and wide again."""
    wide = votes.verdicts_to_wide(t.verdicts, MODELS)
    return votes.verdicts_to_wide(votes.wide_to_verdicts(wide, MODELS, ["id", "prompt"]), MODELS)


@query(
    """SELECT source AS dataset, (count(*) FILTER (WHERE matches_original)) AS matches, count(*) AS total_rows,
     round(100E0 * (count(*) FILTER (WHERE matches_original)) / count(*), 9) AS percentage
    FROM fx_truth l JOIN documents d ON CAST(d.doc_id AS VARCHAR) = l.id GROUP BY ROLLUP (source)"""
)
def match_rate(t):
    named = t["documents"].select(F.col("doc_id").cast("string").alias("id"), "source")
    rows = t.truth.join(named, "id").withColumnRenamed("source", "dataset")
    return rounded(metrics.match_rate(rows), "percentage")


