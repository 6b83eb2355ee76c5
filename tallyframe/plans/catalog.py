"""Registry of the queries over the driver tables, each with its SQL where SQL can say it."""

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.prompts import MessageTemplate
from tallyframe.sources.registry import Prompt
from tallyframe.sources.tables import spread

MODELS = ["m0", "m1", "m2", "m3"]
PROMPTS = [
    Prompt("yes_no_a", ("main", "checks"), "yes_no"),
    Prompt("yes_no_b", ("main", "checks"), "yes_no"),
    Prompt("answer_a", ("main", "answers"), "answer"),
    Prompt("answer_b", ("main", "answers"), "answer"),
]
PROMPT_NAMES = [p.name for p in PROMPTS]
ANSWER_PROMPTS = [p for p in PROMPTS if p.family == "answer"]
CHECK_PROMPTS = [p for p in PROMPTS if p.family == "yes_no"]

QUESTION_TEMPLATE = MessageTemplate(
    "user",
    "Context:\n{context}\n\nQuestion: {question}\nGive the answer as {{text}}.",
    {"context": "context", "question": "question"},
)
CHECK_TEMPLATES = [
    MessageTemplate("system", "Check labels. Reply in {braces}."),
    MessageTemplate(
        "user", "{question} -> {label}\n\n{context}",
        {"context": "context", "question": "question", "label": "label"},
    ),
]


TEXT_TABLES = ("documents", "conversations")


class Tables:
    """The given tables, and the audit tables Spark derives from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getitem__(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(table) if name in TEXT_TABLES else table

    @cached_property
    def items(self) -> DataFrame:
        """Every document as an item; its label is ``lang ; source``, empty for every tenth."""
        return self["documents"].select(
            F.col("doc_id").cast("string").alias("id"),
            F.col("doc_id").alias("index"),
            F.col("text").alias("context"),
            F.concat(F.lit("Which language and source has item "), F.col("doc_id"), F.lit("?")).alias(
                "question"
            ),
            _label().alias("label"),
        )

    @cached_property
    def truth(self) -> DataFrame:
        return self["labels"].select(
            F.col("doc_id").cast("string").alias("id"),
            (F.col("quality") == 1).alias("matches_original"),
            (F.col("toxic") == 1).alias("unanswerable"),
        )

    def _cells(self) -> DataFrame:
        """Documents x prompts x models with their verdict, by two narrow explodes."""
        choice = lambda names, key: F.explode(
            F.array(
                *[F.struct(F.lit(n).alias(key), F.lit(k).alias("k")) for k, n in enumerate(names)]
            )
        )
        cells = (
            self["documents"]
            .withColumn("p", choice(PROMPT_NAMES, "prompt"))
            .withColumn("m", choice(MODELS, "model"))
        )
        r = (F.col("doc_id") * 7 + F.col("m.k") * 3 + F.col("p.k") * 5) % 11
        return cells.select(
            "doc_id", "text", "lang", "source",
            F.col("doc_id").cast("string").alias("id"),
            F.col("p.prompt").alias("prompt"),
            F.col("m.model").alias("model"),
            F.when(r == 10, None).otherwise(r < 6).alias("vote"),
        )

    @cached_property
    def verdicts(self) -> DataFrame:
        return self._cells().select("id", "prompt", "model", "vote")

    @cached_property
    def outputs(self) -> DataFrame:
        """Raw model texts: the whole document, then a tag that says the verdict."""
        vote, label = F.col("vote"), _label()
        swapped = F.when(label == "", "").otherwise(F.concat_ws(" ; ", "source", "lang"))
        answer = F.concat(
            F.lit("thinking <answer>draft</answer> about "), "text", F.lit("\n<answer>"),
            F.when(vote, swapped).otherwise(F.concat("lang", F.lit(" ; c"))),
            F.lit("</answer>"),
        )
        yes_no = F.concat(
            F.lit("first ###no then "), "text", F.lit("\n###"),
            F.when(vote, " yes").otherwise("no"),
        )
        return self._cells().select(
            "id", "prompt", "model",
            F.when(vote.isNull(), F.concat("text", F.lit("\nno verdict")))
            .when(F.startswith("prompt", F.lit("answer")), answer)
            .otherwise(yes_no)
            .alias("output"),
        )

    @cached_property
    def scores(self) -> DataFrame:
        """Percentage vote per item and prompt, the prompt being the curve."""
        half = F.when(F.col("vote").isNull(), 0.5).when(F.col("vote"), 1.0).otherwise(0.0)
        return (
            self.verdicts.groupBy("id", F.col("prompt").alias("curve"))
            .agg(F.avg(half).alias("score"))
        )

    @cached_property
    def line_votes(self) -> DataFrame:
        flag = F.col("l_returnflag")
        return self["lineitem"].select(
            F.col("l_orderkey").cast("string").alias("id"),
            F.col("l_linestatus").alias("prompt"),
            F.col("l_linenumber").alias("model"),
            F.when(flag == "A", True).when(flag == "R", False).alias("vote"),
        )


def _label():
    return F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.concat_ws(" ; ", "lang", "source"))


# The same derived tables for the SQL check.
SQL_VIEWS = """
WITH RECURSIVE fx_items AS (
 SELECT CAST(doc_id AS VARCHAR) AS id, doc_id AS "index", text AS context,
  'Which language and source has item ' || doc_id || '?' AS question,
  CASE WHEN doc_id % 10 = 0 THEN '' ELSE lang || ' ; ' || source END AS label
 FROM documents),
fx_truth AS (
 SELECT CAST(doc_id AS VARCHAR) AS id, quality = 1 AS matches_original, toxic = 1 AS unanswerable
 FROM labels),
fx_cells AS (
 SELECT CAST(d.doc_id AS VARCHAR) AS id, d.doc_id, d.text, d.lang, d.source, p.prompt, m.model,
  CASE WHEN (d.doc_id * 7 + m.k * 3 + p.k * 5) % 11 = 10 THEN NULL
       ELSE (d.doc_id * 7 + m.k * 3 + p.k * 5) % 11 < 6 END AS vote
 FROM documents d
 CROSS JOIN (VALUES ('m0',0),('m1',1),('m2',2),('m3',3)) AS m(model,k)
 CROSS JOIN (VALUES ('yes_no_a',0),('yes_no_b',1),('answer_a',2),('answer_b',3)) AS p(prompt,k)),
fx_pred AS (SELECT id, prompt, model, vote FROM fx_cells),
fx_out AS (
 SELECT id, prompt, model, CASE
  WHEN vote IS NULL THEN text || chr(10) || 'no verdict'
  WHEN prompt LIKE 'answer%' THEN 'thinking <answer>draft</answer> about ' || text || chr(10)
   || '<answer>' || CASE WHEN vote THEN CASE WHEN doc_id % 10 = 0 THEN '' ELSE source || ' ; ' || lang END
     ELSE lang || ' ; c' END || '</answer>'
  ELSE 'first ###no then ' || text || chr(10) || '###' || CASE WHEN vote THEN ' yes' ELSE 'no' END
  END AS output
 FROM fx_cells),
fx_answers AS (
 SELECT id, prompt, model,
  CASE WHEN NOT regexp_matches(a, 'Unknown|None|No Information provided|Not specified') THEN a END AS answer
 FROM (SELECT id, prompt, model, regexp_extract_all(output, '<answer>([^\\n]*?)</answer>', 1)[-1] AS a
       FROM fx_out WHERE prompt LIKE 'answer%')),
fx_yes_no AS (
 SELECT id, prompt, model, regexp_extract_all(output, '###\\s*(yes|no)', 1)[-1] AS answer
 FROM fx_out WHERE prompt LIKE 'yes_no%'),
fx_verdicts AS (
 SELECT y.id, prompt, model, lower(answer) = 'yes' AS vote FROM fx_yes_no y JOIN fx_items i ON i.id = y.id
 UNION ALL
 SELECT a.id, prompt, model,
  list_sort(list_transform(string_split(answer, ';'), lambda x: trim(x)))
  = list_sort(list_transform(string_split(label, ';'), lambda x: trim(x))) AS vote
 FROM fx_answers a JOIN fx_items i ON i.id = a.id),
fx_score AS (
 SELECT id, prompt AS curve,
  avg(CASE WHEN vote IS NULL THEN 0.5E0 WHEN vote THEN 1.0E0 ELSE 0.0E0 END) AS score
 FROM fx_pred GROUP BY id, prompt),
fx_line_votes AS (
 SELECT CAST(l_orderkey AS VARCHAR) AS id, l_linestatus AS prompt, l_linenumber AS model,
  CASE l_returnflag WHEN 'A' THEN TRUE WHEN 'R' THEN FALSE END AS vote FROM lineitem),
fx_votes AS (
 SELECT id, prompt, (count(*) FILTER (WHERE vote)) > (count(*) FILTER (WHERE NOT vote)) AS majority_vote,
  CASE WHEN (count(*) FILTER (WHERE vote)) = count(*) THEN TRUE WHEN (count(*) FILTER (WHERE NOT vote)) = count(*) THEN FALSE END AS unanimous_vote,
  avg(CASE WHEN vote IS NULL THEN 0.5E0 WHEN vote THEN 1.0E0 ELSE 0.0E0 END) AS percentage_vote
 FROM fx_pred GROUP BY id, prompt),
fx_merged AS (
 SELECT id,
  CASE WHEN count(majority_vote) > 0 THEN (count(*) FILTER (WHERE majority_vote)) * 2 > count(majority_vote) END AS majority_vote,
  CASE WHEN (count(*) FILTER (WHERE unanimous_vote)) = count(*) THEN TRUE
       WHEN (count(*) FILTER (WHERE NOT unanimous_vote)) = count(*) THEN FALSE END AS unanimous_vote,
  avg(percentage_vote) AS percentage_vote,
  CASE WHEN count(unanimous_vote) > 0 THEN (count(*) FILTER (WHERE unanimous_vote)) * 2 > count(unanimous_vote) END
   AS model_unanimous_prompt_majority_vote,
  CASE WHEN count(majority_vote) > 0 THEN (count(*) FILTER (WHERE majority_vote)) = count(majority_vote) END
   AS model_majority_prompt_unanimous_vote
 FROM fx_votes GROUP BY id)
"""

Query = Callable[[Tables], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name; ``sql`` may use the derived tables."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            text = sql.strip()
            glue = "" if text.startswith(",") else "\n"
            ORACLES[fn.__name__] = SQL_VIEWS.strip() + glue + text
        return fn

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    """Round derived doubles, so that summation order does not show."""
    return df.withColumns({c: F.round(c, digits) for c in columns})
