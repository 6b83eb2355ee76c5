"""Queries: item texts, prompts, reruns and row-level text jobs."""

import uuid

from pyspark.sql import functions as F

from tallyframe.constants import FORMAT_REMINDER, RETRY_LIMIT
from tallyframe.functions import parsing, prompts, text
from tallyframe.operators import flatten, generation, relational, textjobs
from tallyframe.plans.catalog import CHECK_TEMPLATES, MODELS, PROMPTS, query, rounded
from tallyframe.plans.vote_queries import vote_sql
from tallyframe.session import ensure_checkpoint_dir
from tallyframe.sources.registry import family_of
from tallyframe.sources.tables import spread
from tallyframe.streaming.votes import ITEM_STREAM, VoteTable, read_stream, start_votes

WORDS = "list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


@query("SELECT id, label FROM fx_items WHERE label <> ''")
def answerable_filter(t):
    return relational.drop_empty_labels(t.items).select("id", "label")


@query(
    "SELECT id, CASE WHEN label = '' THEN 'Not specified in the given Context' ELSE label END AS label FROM fx_items"
)
def replace_empty_label(t):
    return t.items.select("id", parsing.replace_empty_label(F.col("label")).alias("label"))


FILTER_SQL = f""", s1 AS (SELECT id, label, context FROM fx_items WHERE label <> ''),
 s2 AS (SELECT id, label FROM s1 WHERE len({WORDS.format(x="context")}) <= 600),
 s3 AS (SELECT id, label FROM s2 WHERE id IN (SELECT id FROM fx_truth))"""


def _survival(t):
    """Items with the last of three filters they survive, read once."""
    steps = [
        ~F.col("label").eqNullSafe(""),
        relational.within_words("context", 600),
        relational.InSet(t.truth),
    ]
    return relational.survival(t.items.select("id", "label", "context"), steps), len(steps)


@query(FILTER_SQL + "SELECT id, label FROM s3")
def filter_chain(t):
    return relational.survivors(*_survival(t)).select("id", "label")


@query(
    FILTER_SQL
    + """SELECT 1 AS step, count(*) AS rows FROM s1 UNION ALL SELECT 2, count(*) FROM s2
    UNION ALL SELECT 3, count(*) FROM s3"""
)
def filter_chain_counts(t):
    return relational.step_counts(*_survival(t))


@query(
    f"""SELECT id, len({WORDS.format(x="context")})::INT AS n_words FROM fx_items WHERE len({WORDS.format(x="context")}) > 600"""
)
def over_long_inputs(t):
    return relational.over_long(t.items, "context", 600)[1]


@query(
    f"""SELECT id, CASE WHEN n > 600 THEN 'skipped' ELSE 'kept' END AS side FROM (SELECT id,
     CASE WHEN "index" % 4 = 0 THEN 0 WHEN "index" % 4 = 1 THEN 0 ELSE len({WORDS.format(x="context")}) END AS n FROM fx_items)"""
)
def over_long_nulls(t):
    """Every item is on one side of the limit, those without a text or with an empty one too."""
    k = F.col("index") % 4
    context = F.when(k == 0, F.lit(None)).when(k == 1, "").otherwise(F.col("context"))
    kept, skipped = relational.over_long(t.items.withColumn("context", context), "context", 600)
    return kept.select("id", F.lit("kept").alias("side")).unionByName(
        skipped.select("id", F.lit("skipped").alias("side"))
    )


INVALID_SQL = """, invalid AS (SELECT DISTINCT id FROM fx_out WHERE prompt = 'answer_a' AND model = 'm1'
 AND NOT regexp_matches(output, '<answer>[^\\n]*?</answer>'))"""


def _rerun(t, items):
    outputs = t.outputs.where("prompt = 'answer_a' AND model = 'm1'")
    return relational.invalid_rerun_set(items, outputs, F.lit("answer"))


@query(INVALID_SQL + "SELECT id, label FROM fx_items WHERE id IN (SELECT id FROM invalid)")
def invalid_rerun_set(t):
    return _rerun(t, t.items)[0].select("id", "label")


@query(
    INVALID_SQL
    + "SELECT id FROM invalid WHERE id NOT IN (SELECT id FROM fx_items WHERE label <> '')"
)
def invalid_orphans(t):
    """Invalid outputs whose item is no longer in the (filtered) item table."""
    return _rerun(t, relational.drop_empty_labels(t.items))[1]


@query(
    """SELECT id, 'system' AS first_role, 2 AS n, 'Check labels. Reply in {braces}.' || '|' || question || ' -> ' || label
     || chr(10) || chr(10) || context AS contents FROM fx_items"""
)
def render_messages(t):
    messages = prompts.render_messages(CHECK_TEMPLATES)
    return t.items.select("id", messages.alias("m")).select(
        "id", F.col("m")[0]["role"].alias("first_role"), F.size("m").alias("n"),
        F.array_join(F.col("m.content"), "|").alias("contents"),
    )


@query(
    """SELECT conv_id, turn, '<|system|>' || chr(10) || 'Speak as ' || role || '.' || chr(10) || '<|user|>' || chr(10) || text
     || chr(10) || '<|assistant|>' || chr(10) AS prompt_text FROM conversations"""
)
def chat_text(t):
    """Messages of each turn as one prompt text that opens the reply."""
    templates = [
        prompts.MessageTemplate("system", "Speak as {who}.", {"who": "role"}),
        prompts.MessageTemplate("user", "{words}", {"words": "text"}),
    ]
    return t["conversations"].select(
        "conv_id", "turn",
        prompts.chat_text(prompts.render_messages(templates)).alias("prompt_text"),
    )


@query(
    f"""SELECT doc_id, len(list_distinct(w)) < 0.3E0 * len(w) AS repetitive
    FROM (SELECT doc_id, {WORDS.format(x="text")} AS w FROM documents)"""
)
def repetition_flag(t):
    return t["documents"].select("doc_id", text.is_repetitive(F.col("text")).alias("repetitive"))


@query(
    f""", o AS (SELECT id, prompt, model, output, CAST(id AS BIGINT) % {RETRY_LIMIT} + 1 AS attempt,
      CASE WHEN prompt LIKE 'answer%' THEN regexp_matches(output, '<answer>[^\\n]*?</answer>')
      ELSE regexp_matches(output, '###\\s*(yes|no)') END AS valid FROM fx_out)
    SELECT id, prompt, model, CASE WHEN valid THEN 'valid' WHEN attempt >= 3 THEN 'invalid'
     WHEN len(list_distinct({WORDS.format(x="output")})) < 0.3E0 * len({WORDS.format(x="output")}) THEN 'retry'
     ELSE 'append' END AS action FROM o"""
)
def retry_plan(t):
    valid = parsing.is_valid_output(family_of(PROMPTS, F.col("prompt")), F.col("output"))
    attempt = F.col("id").cast("long") % RETRY_LIMIT + 1
    return t.outputs.select(
        "id", "prompt", "model",
        generation.retry_action(F.col("output"), valid, attempt).alias("action"),
    )


def _answers(documents, id_column="doc_id"):
    """Rounds with the stand-in described below."""

    def factory():
        def answer(prompt: str, retry: bool) -> str:
            kind, lang = prompt.split("kind ")[-1].split()[:2]
            reminded = FORMAT_REMINDER in prompt
            if kind == "0" or (kind == "1" and reminded) or (kind == "2" and retry and not reminded):
                return f"item <answer>{lang}</answer>"
            return "so " * 20 if kind == "2" else "no tag here"

        return lambda texts, retry: [answer(p, retry) for p in texts]

    template = prompts.MessageTemplate(
        "user", "{text} kind {kind} {lang} .", {"text": "text", "kind": "kind", "lang": "lang"}
    )
    items = documents.withColumn("kind", F.col("doc_id") % 4).select(
        F.col(id_column).cast("string").alias("id"),
        prompts.render_messages([template]).alias("messages"),
    )
    return generation.generate_with_retries(items, factory, parsing.is_valid_answer)


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS id,
     CASE WHEN doc_id % 4 < 3 THEN 'item <answer>' || lang || '</answer>' END AS output,
     CASE doc_id % 4 WHEN 0 THEN 1 WHEN 3 THEN 3 ELSE 2 END AS attempts FROM documents"""
)
def generate_with_retries(t):
    """Generation rounds over all documents with a stand-in for a model.

    By item, the stand-in answers at once, after a reminder, after a repetitive text on the
    fresh try, or never.
    """

    return _answers(t["documents"]).select("id", "output", "attempts")


@query(
    """SELECT lang AS id, CASE WHEN doc_id % 4 < 3 THEN 'item <answer>' || lang || '</answer>' END AS output,
     CASE doc_id % 4 WHEN 0 THEN 1 WHEN 3 THEN 3 ELSE 2 END AS attempts, CAST(count(*) AS BIGINT) AS n
    FROM documents GROUP BY ALL"""
)
def generate_repeated_ids(t):
    """The same rounds where all documents of a language share one id: a row for each of them."""
    rows = _answers(t["documents"], id_column="lang")
    return rows.groupBy("id", "output", "attempts").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT conv_id, turn, len(parts)::INT AS n, array_to_string(parts, '|') AS parts FROM (
     SELECT conv_id, turn, CASE WHEN text = '' THEN [] ELSE list_transform(string_split(text, ','),
      lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))) END AS parts FROM conversations)"""
)
def csv_split(t):
    return t["conversations"].select(
        "conv_id", "turn", text.split_csv(F.col("text")).alias("parts")
    ).select(
        "conv_id", "turn", F.size("parts").alias("n"), F.array_join("parts", "|").alias("parts")
    )


def source_documents(t):
    """Each turn as a source document: its lines are paragraphs, each with a question."""
    paragraphs = F.split("text", "\n")
    answers = lambda p, i: F.transform(
        F.split(p, "\\. "),
        lambda a, k: F.struct(
            a.alias("answer"),
            F.when((k + F.col("conv_id")) % 5 != 4, k).alias("from"),
            (k + F.length(a)).alias("end"),
            i.alias("para"),
        ),
    )
    return t["conversations"].select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("row"),
        F.col("conv_id").alias("index"),
        "role",
        paragraphs.alias("paras"),
        F.transform(
            paragraphs,
            lambda p, i: F.struct(
                F.concat(F.col("role"), F.lit(" "), i.cast("string")).alias("question"),
                answers(p, i).alias("answers"),
            ),
        ).alias("questions"),
    )


FLAT_SQL = """, paras AS (SELECT conv_id * 100 + turn AS row, conv_id, role, text AS context, unnest(string_split(text, chr(10))) AS p,
  unnest(range(len(string_split(text, chr(10))))) AS i FROM conversations),
flat AS (SELECT row || '_' || i AS id, conv_id AS "index", role, context, role || ' ' || i AS question,
  string_split(p, '. ') AS answers, i,
  len(list_filter(range(len(string_split(p, '. '))), lambda k: (k + conv_id) % 5 = 4)) > 0 AS broken FROM paras)
"""


@query(
    FLAT_SQL
    + """SELECT id, "index", role, context, question, replace(array_to_string(answers, ' ; '), ' .', '.') AS label,
     CASE WHEN NOT broken THEN len(answers)::INT END AS n_positions,
     CASE WHEN NOT broken THEN i::INT END AS para FROM flat"""
)
def flatten_questions(t):
    flat = flatten.flatten_questions(source_documents(t))
    places = F.col("position_labels")
    return flat.select(
        "id", "index", "role", "context", "question", "label",
        F.when(places.isNotNull(), F.size(places)).alias("n_positions"),
        places[0]["target"]["para"].alias("para"),
    )


ANNOTATION_TEXT_SQL = (
    FLAT_SQL
    + "SELECT id, context || chr(10) || repeat('=', 50) || chr(10) || chr(10) || chr(10) || '.' || question AS text FROM flat"
)


@query(ANNOTATION_TEXT_SQL)
def annotation_texts(t):
    return flatten.annotation_texts(source_documents(t))


REDUCE_SQL = """, it AS (SELECT id, context, concat_ws(' ; ', concat_ws(' ', p[-2], p[-1]), p[1]) AS label
 FROM (SELECT id, context, string_split(context, ' ') AS p FROM fx_items)),
labels_of AS (SELECT id, raw, trim(raw, blanks) AS t FROM (
  SELECT id, unnest(string_split(label, ';')) AS raw, ' ' || chr(9) || chr(10) || chr(13) AS blanks FROM it) WHERE trim(raw, blanks) <> ''),
sized AS (SELECT id, raw, t, greatest(length(t) // 3, length(regexp_extract(t, '^\\S+')), 1) AS m FROM labels_of),
starts AS (SELECT *, unnest(range(1, length(t) + 1)) AS i FROM sized),
subs AS (SELECT id, substr(t, i, n) AS piece FROM (SELECT *, unnest(range(m, length(t) - i + 2)) AS n FROM starts)
 WHERE contains(substr(t, i, n), ' ') UNION SELECT id, raw FROM sized),
found AS (SELECT s.id, s.piece, it.context FROM subs s JOIN it ON it.id = s.id WHERE contains(it.context, s.piece)),
cut AS (SELECT id, piece, unnest(string_split(context, piece)) AS part, unnest(range(len(string_split(context, piece)))) AS k FROM found),
hits AS (SELECT DISTINCT id, b, b + length(piece) AS e FROM (SELECT id, piece, k, (sum(length(part) + length(piece)) OVER (
   PARTITION BY id, piece ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - length(piece))::BIGINT AS b FROM cut) WHERE k > 0),
split AS (SELECT id, context, string_split(regexp_replace(context, '([.!?]) +', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM it),
sentences AS (SELECT id, k, s, strpos(context, s) - 1 AS st, strpos(context, s) - 1 + length(s) AS en FROM (
  SELECT id, context, unnest(ss) AS s, unnest(range(len(ss))) AS k FROM split)),
touched AS (SELECT DISTINCT s.id, s.k FROM sentences s JOIN hits h ON h.id = s.id
 WHERE (s.st <= h.b AND h.b < s.en) OR (s.st < h.e AND h.e <= s.en)),
seeds AS (SELECT id, k FROM touched UNION SELECT id, k FROM sentences WHERE k < 10 AND id IN (SELECT id FROM touched)),
kept AS (SELECT DISTINCT s.id, s.k, s.s FROM seeds x JOIN sentences s ON s.id = x.id AND s.k BETWEEN x.k - 5 AND x.k + 5),
gaps AS (SELECT id, k, trim(s, ' ' || chr(9) || chr(10) || chr(13)) AS s,
  k > coalesce(lag(k) OVER (PARTITION BY id ORDER BY k), 0) + 1 AS gap FROM kept),
reduced AS (SELECT id, string_agg(CASE WHEN gap THEN '[...] ' ELSE '' END || s, ' ' ORDER BY k) AS context,
  count(*) + count(*) FILTER (WHERE gap) AS n_kept FROM gaps GROUP BY id)
SELECT split.id, coalesce(r.context, split.context) AS context, len(ss)::INT AS n_sentences, coalesce(r.n_kept, len(ss))::INT AS n_kept,
 round((length(split.context) - length(coalesce(r.context, split.context)))::DOUBLE / length(split.context), 9) AS reduction
FROM split LEFT JOIN reduced r ON r.id = split.id
"""


def labelled_by_words(t):
    """Items whose label is ``word pair ; word`` of their text."""
    parts = F.split("context", " ")
    label = F.concat_ws(
        " ; ",
        F.concat_ws(" ", F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-1))),
        parts[0],
    )
    return t.items.select("id", "context", "question", label.alias("label"))


@query(REDUCE_SQL)
def reduce_context(t):
    """Contexts reduced to the sentences around ``word ; word pair`` labels of the text.

    Texts of one word or none have shorter labels, or the whole text as their label.
    """
    items = labelled_by_words(t).select("id", "context", "label")
    return rounded(
        textjobs.reduce_contexts(items).select("id", "context", "n_sentences", "n_kept", "reduction"),
        "reduction",
    )


ENTITIES = ["de", "the", "un"]
BIO_SQL = """, d AS (SELECT doc_id, text, translate(text, chr(10) || chr(9) || chr(13), '   ') AS flat FROM documents),
pieces AS (SELECT doc_id, unnest(string_split(flat, ' ')) AS token, unnest(range(len(string_split(flat, ' ')))) AS k FROM d),
tokens AS (SELECT * FROM (SELECT doc_id, token, (coalesce(sum(length(token) + 1) OVER (PARTITION BY doc_id ORDER BY k
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS b FROM pieces) WHERE token <> ''),
cuts AS (SELECT doc_id, e, entity, unnest(string_split(text, entity)) AS piece, unnest(range(len(string_split(text, entity)))) AS k
  FROM d, (VALUES (0, 'de'), (1, 'the'), (2, 'un')) AS x(e, entity)),
hits AS (SELECT * FROM (SELECT doc_id, e, k, (coalesce(sum(length(piece) + length(entity)) OVER (PARTITION BY doc_id, e ORDER BY k
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - length(entity))::BIGINT AS b FROM cuts) WHERE k > 0),
tagged AS (SELECT t.doc_id, t.b, arg_max(CASE WHEN t.b = h.b THEN 1 ELSE 2 END, struct_pack(e := h.e, b := h.b)) AS tag
  FROM hits h ASOF JOIN tokens t ON t.doc_id = h.doc_id AND h.b >= t.b GROUP BY t.doc_id, t.b),
counts AS (SELECT doc_id, count(*) AS n_tokens, CAST(sum(b) AS BIGINT) AS begins FROM tokens GROUP BY doc_id)
SELECT CAST(c.doc_id AS VARCHAR) AS id, n_tokens, begins, coalesce(starts, 0) AS starts, coalesce(insides, 0) AS insides,
 coalesce(weighted, 0) AS weighted FROM counts c LEFT JOIN (
  SELECT doc_id, count(*) FILTER (tag = 1) AS starts, count(*) FILTER (tag = 2) AS insides,
   CAST(sum(tag * b) AS BIGINT) AS weighted FROM tagged GROUP BY doc_id) g ON g.doc_id = c.doc_id
"""


@query(BIO_SQL)
def bio_tags(t):
    """Tags of all tokens, summed up per document."""
    items = t.items.withColumn("label", F.lit(" ; ".join(ENTITIES)))
    tokens = textjobs.bio_tags(items).select("id", F.inline("tokens"))
    tag, begin = F.col("tag"), F.col("begin").cast("long")
    return tokens.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.sum(begin).alias("begins"),
        F.count_if(tag == 1).alias("starts"),
        F.count_if(tag == 2).alias("insides"),
        F.sum(tag * begin).alias("weighted"),
    )


# The expected shape of the audited outputs.
EVENT_SCHEMA = {
    "type": "object",
    "properties": {
        "event": {
            "type": "object",
            "properties": {"k": {"type": "integer"}, "missing": {"type": "string"}},
        },
        "tags": {
            "type": "array",
            "items": {"type": "object", "properties": {"name": {"type": "string"}}},
        },
        "value": {"type": "number"},
        "note": {"type": "string"},
    },
}


@query(
    """, e AS (SELECT CAST(event_id AS VARCHAR) AS id, event_id, value FROM events)
    SELECT id, 'event' AS path, 'object' AS expected_type, 'existing' AS status, 'object' AS type_path, 1 AS level FROM e WHERE event_id % 10 < 9
    UNION ALL SELECT id, 'event.k', 'integer', 'existing', 'object.integer', 2 FROM e WHERE event_id % 10 < 9
    UNION ALL SELECT id, 'event.missing', 'string', 'missing', 'object.string', 2 FROM e WHERE event_id % 10 < 9
    UNION ALL SELECT id, 'tags', 'array', 'existing', 'array', 1 FROM e WHERE event_id % 10 < 9
    UNION ALL SELECT id, 'tags[0].name', 'string', 'existing', 'array.object.string', 2 FROM e WHERE event_id % 10 < 9
    UNION ALL SELECT id, 'tags[1].name', 'string', 'type mismatch', 'array.object.string', 2 FROM e WHERE event_id % 10 < 9
    UNION ALL SELECT id, 'value', 'number', CASE WHEN event_id % 10 < 5 THEN 'existing' ELSE 'missing' END, 'number', 1 FROM e WHERE event_id % 10 < 9
    UNION ALL SELECT id, 'note', 'string', 'missing', 'string', 1 FROM e WHERE event_id % 10 < 9
    UNION ALL SELECT id, NULL, NULL, 'invalid', NULL, NULL FROM e WHERE event_id % 10 = 9"""
)
def json_audit(t):
    """Outputs that are whole, cut off inside the tags, or not JSON at all."""
    n, value = F.col("event_id") % 10, F.col("value").cast("string")
    head = F.when(n < 5, F.concat(F.lit('"value": '), value, F.lit(", "))).otherwise("")
    cut = F.concat(
        F.lit("{"), head, F.lit('"event": '), "props", F.lit(', "tags": [{"name": "'),
        "event_type", F.lit('"}, {"name": '), value,
    )
    output = (
        F.when(n == 9, F.concat(F.lit("{props: "), "props"))
        .when(n % 2 == 0, F.concat(cut, F.lit("}]}")))
        .otherwise(cut)
    )
    rows = spread(t["events"]).select(
        F.col("event_id").cast("string").alias("id"), output.alias("output")
    )
    return textjobs.audit_json(rows, EVENT_SCHEMA)


@query(vote_sql("fx_verdicts"))
def stream_votes(t):
    """Outputs and items arriving as files in two waves, voted incrementally: equal to the batch.

    The first wave holds earlier texts, at an earlier, the same or no time, that the second one
    replaces, and outputs whose items only come with the second wave.
    """
    ensure_checkpoint_dir(t.spark)
    base = f"{t.spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    table = VoteTable(f"{base}/tables")
    number = F.col("id").cast("bigint")
    stamped = t.outputs.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000)))
    early = F.col("ts") - F.expr("INTERVAL 1 HOUR")
    stale = stamped.where(number % 2 == 0).withColumns(
        {
            "output": F.lit("no verdict yet"),
            "ts": F.when(number % 6 == 0, early).when(number % 6 == 2, F.col("ts")),
        }
    )
    items = t.items.select("id", "label")
    waves = [
        (stamped.where(number % 2 == 1).unionByName(stale), items.where(number % 3 > 0)),
        (stamped.where(number % 2 == 0), items.where(number % 3 == 0)),
    ]
    for arriving, known in waves:
        arriving.write.mode("append").json(f"{base}/in", compression="gzip")
        known.write.mode("append").json(f"{base}/items")
        start_votes(
            read_stream(t.spark, f"{base}/in"),
            read_stream(t.spark, f"{base}/items", ITEM_STREAM),
            PROMPTS, MODELS, table, f"{base}/state",
        ).awaitTermination()
    return rounded(table.votes(t.spark), "percentage_vote")
