"""Queries: samples, splits, fine-tuning rows, features, learned scores and table upkeep."""

import uuid

from pyspark.errors import PythonException
from pyspark.sql import functions as F

from tallyframe import schemas
from tallyframe.functions.numbers import verdict_number
from tallyframe.functions.parsing import is_valid_answer
from tallyframe.functions.prompts import MessageTemplate, render_messages
from tallyframe.operators import features, generation, learned, metrics, relational, sampling
from tallyframe.plans import jobs
from tallyframe.plans.catalog import (
    MODELS,
    PROMPTS,
    QUESTION_TEMPLATE,
    query,
    rounded,
)
from tallyframe.plans.curve_queries import CURVE_SQL
from tallyframe.plans.text_queries import (
    ANNOTATION_TEXT_SQL,
    REDUCE_SQL,
    labelled_by_words,
    source_documents,
)
from tallyframe.plans.label_queries import IMPORT_SQL, annotation_documents, label_rows
from tallyframe.session import ensure_checkpoint_dir, materialise
from tallyframe.sources import tables
from tallyframe.sources.annotations import write_annotation_files
from tallyframe.sources.registry import Model, PromptRecord

UNCERTAIN_SQL = """, answer_scores AS (SELECT id, score FROM fx_score WHERE curve = 'answer_a'),
top AS (SELECT s.id, round(score, 4) AS score, round(abs(score - 0.5E0), 4) AS "distance_from_0.5"
 FROM answer_scores s WHERE s.id NOT IN (SELECT id FROM fx_truth)
 ORDER BY abs(score - 0.5E0), s.id LIMIT 100)
"""


def _answer_scores(t):
    return t.scores.where("curve = 'answer_a'").select("id", "score")


def _scratch(t) -> str:
    """A new folder of its own under the shared checkpoint folder."""
    ensure_checkpoint_dir(t.spark)
    return f"{t.spark.sparkContext.getCheckpointDir()}/work-{uuid.uuid4().hex}"


def _project(t, buckets=None) -> jobs.Workspace:
    models = [Model(m, ("all",)) for m in MODELS]
    return jobs.Workspace(t.spark, _scratch(t), models, PROMPTS, buckets)


@query(UNCERTAIN_SQL + 'SELECT id, score, "distance_from_0.5" FROM top')
def uncertainty_top_n(t):
    return sampling.most_uncertain(_answer_scores(t), t.truth, 100)


AL_SQL = UNCERTAIN_SQL + ", al AS (SELECT i.id, i.label, i.id IN (SELECT id FROM top) AS moved FROM fx_items i)"


def _al_split(t):
    top = sampling.most_uncertain(_answer_scores(t), t.truth, 100)
    return relational.split_by_ids(t.items.select("id", "label"), top)


@query(AL_SQL + "SELECT id, label FROM al WHERE NOT moved")
def al_split_kept(t):
    return _al_split(t).where("NOT moved").drop("moved")


@query(AL_SQL + "SELECT id, label FROM al WHERE moved")
def al_split_moved(t):
    return _al_split(t).where("moved").drop("moved")


@query(
    """SELECT id, matches_original, CASE WHEN CAST(id AS BIGINT) % 7 = 0 THEN 'sampled' ELSE 'docs' END AS dataset
    FROM fx_truth"""
)
def al_round_in_place(t):
    """Sampled rows leave the stored table under its own name; both sides are read back."""
    ws = _project(t)
    ws.store("relabel_evaluation", t.truth.select("id", "matches_original"), "docs")
    sampled = t.truth.where(F.col("id").cast("bigint") % 7 == 0).select("id")
    ws.store("al_samples", sampled.withColumn("run_id", F.lit("al_1")), "docs", "run_id")
    jobs.move_sampled(ws, "docs", "docs", "sampled")
    return ws.read("relabel_evaluation").select("id", "matches_original", "dataset")


@query(
    """SELECT id FROM (SELECT id, CASE CAST(id AS BIGINT) % 5 WHEN 0 THEN NULL WHEN 1 THEN 0.5E0 ELSE score END AS score,
      CAST(id AS BIGINT) % 5 AS k FROM fx_score WHERE curve = 'answer_a') WHERE k <> 2 AND score > 0.4E0"""
)
def confident_nan(t):
    """Items above a score where others have none or NaN."""
    k = F.col("id").cast("bigint") % 5
    score = F.when(k == 1, 0.5).when(k == 2, float("nan")).when(k > 2, F.col("score"))
    rows = _answer_scores(t).withColumn("score", score)
    return relational.confident(rows, "score", 0.4).select("id")


HASH = "CAST(('0x' || substr(md5({key} || ':{seed}'), 1, 8)) AS BIGINT) % {n}"


@query(
    f"SELECT id, CASE WHEN {HASH.format(key='id', seed=42, n=100)} < 10 THEN 'validation' ELSE 'train' END AS part FROM fx_items"
)
def hash_split(t):
    return sampling.hash_split(t.items.select("id"), 10)


@query(f"SELECT id, CAST({HASH.format(key='id', seed=42, n=2)} AS INT) AS baseline_random FROM fx_items")
def random_baseline(t):
    return sampling.random_baseline(t.items.select("id"))


@query(
    """, losses AS (SELECT event_id, event_type AS method, CASE WHEN event_id % 7 > 0 THEN value END AS loss FROM events),
    s AS (SELECT method, max(loss) AS top, avg(loss) AS mean FROM losses GROUP BY method)
    SELECT event_id, method, loss, round(top - coalesce(loss, mean), 9) AS score FROM losses JOIN s USING (method)"""
)
def loss_inversion(t):
    losses = t["events"].select(
        "event_id", F.col("event_type").alias("method"),
        F.when(F.col("event_id") % 7 > 0, F.col("value")).alias("loss"),
    )
    return rounded(metrics.invert_losses(losses), "score")


PROMPT_SQL = """'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || question || chr(10)
 || 'Give the answer as {text}.'"""
FINETUNE_SQL = f""", confident AS (SELECT id FROM fx_score WHERE curve = 'answer_a' AND score > 0.6E0),
chosen AS (SELECT id, arg_min(model, rank) AS model FROM (
  SELECT id, model, CASE model WHEN 'm2' THEN 1 WHEN 'm0' THEN 2 WHEN 'm1' THEN 3 ELSE 4 END AS rank
  FROM fx_pred WHERE prompt = 'answer_a' AND vote) GROUP BY id),
rows AS (SELECT i.id, {PROMPT_SQL} AS "input", o.output FROM fx_items i JOIN confident c ON c.id = i.id
  JOIN chosen h ON h.id = i.id JOIN fx_out o ON o.id = i.id AND o.model = h.model AND o.prompt = 'answer_a')
"""


def _finetune(t):
    prompt = "prompt = 'answer_a'"
    reasoning = (t.verdicts.where(prompt), t.outputs.where(prompt), ["m2", "m0", "m1", "m3"])
    return sampling.finetune_rows(
        t.items, QUESTION_TEMPLATE, _answer_scores(t), "score", 0.6, reasoning
    )


@query(FINETUNE_SQL + 'SELECT id, "input", output FROM rows')
def finetune_rows(t):
    """Confident items with the reasoning of the first correct model."""
    return _finetune(t)


@query(FINETUNE_SQL + 'SELECT id, "input", output FROM rows')
def finetune_stored(t):
    """The same rows by the job, over items and outputs that a project stores in buckets by id."""
    buckets = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    ws = _project(t, buckets)
    ws.store("items", t.items, "docs")
    ws.store("outputs", t.outputs, "docs", "prompt", "model")
    ws.store("verdicts", t.verdicts, "docs", "prompt", "model")
    jobs.store_scores(ws, "docs", _answer_scores(t), "baseline_answer_a")
    prompt = next(p for p in PROMPTS if p.name == "answer_a")
    return jobs.finetuning_rows(
        ws, "docs", QUESTION_TEMPLATE, prompt, "baseline_answer_a", 0.6, preferred_model="m2"
    )


@query(f'SELECT id, {PROMPT_SQL} AS "input", label AS output FROM fx_items')
def finetune_rows_plain(t):
    """All items, with the original label as output."""
    return sampling.finetune_rows(t.items, QUESTION_TEMPLATE)


@query(
    FINETUNE_SQL
    + """SELECT id, 2 AS n, 'user/assistant' AS roles, "input" || '|' || output AS contents FROM rows"""
)
def finetune_chats(t):
    chats = sampling.finetune_chats(_finetune(t))
    return chats.select(
        "id", F.size("messages").alias("n"),
        F.array_join(F.col("messages.role"), "/").alias("roles"),
        F.array_join(F.col("messages.content"), "|").alias("contents"),
    )


def _feature_sql(method: str) -> str:
    """One row per (id, feature), then one aggregate per feature column."""
    names = features.feature_names(PROMPTS, MODELS, method)
    words = "list_distinct(list_filter(regexp_split_to_array(lower({x}), '\\s+'), lambda w: w <> ''))"
    parts = ["SELECT id, model || '_' || prompt AS feature, CASE WHEN vote IS NULL THEN NULL ELSE CAST(vote AS INT) END::DOUBLE AS value FROM yes_no"]
    if method == "bool":
        parts.append("SELECT id, model || '_' || prompt, CAST(trim(answer) = trim(label) AS INT)::DOUBLE FROM answers")
    else:
        for side, size in (("precision", "a"), ("recall", "l")):
            parts.append(
                f"SELECT id, model || '_' || prompt || '_{side}', CASE WHEN answer <> '' AND label <> '' THEN "
                f"coalesce(len(list_intersect(a, l)) / nullif(len({size}), 0), 0E0) END FROM answers"
            )
    columns = ", ".join(
        f"round(coalesce(any_value(value) FILTER (feature = '{n}'), 0.5E0), 9) AS \"{n}\"" for n in names
    )
    return f""", yes_no AS (SELECT id, prompt, model, lower(answer) = 'yes' AS vote FROM fx_yes_no),
    answers AS (SELECT *, {words.format(x="answer")} AS a, {words.format(x="label")} AS l FROM (
     SELECT f.id, prompt, model, replace(answer, ';', ' ') AS answer,
      replace(CASE WHEN label = '' THEN 'unanswerable' ELSE label END, ';', ' ') AS label
     FROM fx_answers f JOIN fx_items i ON i.id = f.id)),
    long AS ({" UNION ALL ".join(parts)})
    SELECT id, {columns} FROM long GROUP BY id"""


def _matrix(t, method, labels=None):
    names = features.feature_names(PROMPTS, MODELS, method)
    rows = features.feature_rows(t.outputs, PROMPTS, t.items, method)
    return names, features.feature_matrix(rows, names, labels)


@query(_feature_sql("precision_recall"))
def feature_matrix(t):
    names, matrix = _matrix(t, "precision_recall")
    return rounded(matrix, *names)


@query(_feature_sql("bool"))
def feature_matrix_bool(t):
    names, matrix = _matrix(t, "bool")
    return rounded(matrix, *names)


SMALL_FOREST = {
    "numTrees": [10, 20],
    "maxDepth": [5, 10],
    "minInstancesPerNode": [1, 2],
    "featureSubsetStrategy": ["sqrt", "all"],
}


@query()
def rf_score(t):
    """Random forest over the verdict features: trained on labelled items, scoring all."""
    names, matrix = _matrix(t, "precision_recall")
    matrix = materialise(matrix)  # the texts are parsed once for training and scoring
    labelled = matrix.join(
        t.truth.select("id", verdict_number(F.col("matches_original")).alias("y")), "id"
    )
    model, _runs = learned.train_forest(labelled, names, rounds=1, tries=2, space=SMALL_FOREST)
    return learned.score(model, matrix)


def _vectors(t):
    """Embedding vectors as features; the class is "label 0" against the rest."""
    width = 64
    return [f"e{i}" for i in range(width)], t["embeddings"].select(
        F.col("vec_id").cast("string").alias("id"),
        *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(width)],
        (F.col("label") != 0).cast("double").alias("y"),
    )


@query()
def mlp_score(t):
    names, matrix = _vectors(t)
    model, _runs = learned.train_perceptron(matrix, names, rounds=1, tries=2, max_iter=30)
    return learned.score(model, matrix)


def _facts(scored, truth):
    """What any scoring must hold to: a row per id, scores within 0 and 1, better than chance."""
    chance = sampling.random_baseline(truth).select(
        "y", F.col("baseline_random").cast("double").alias("score")
    )
    judged = scored.join(truth, "id")
    reports = (learned.training_report(judged.select("y", "score")), learned.training_report(chance))
    better = reports[0].select(F.col("negative_f1").alias("own")).join(
        reports[1].select(F.col("negative_f1").alias("other")), F.lit(True)
    )
    rows = scored.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("id").alias("n_ids"),
        F.min((F.col("score") >= 0) & (F.col("score") <= 1)).alias("within"),
    )
    return rows.join(better, F.lit(True)).select(
        "n_rows", "n_ids", "within", (F.col("own") > F.col("other")).alias("above_chance")
    )


@query(
    """SELECT count(*) AS n_rows, count(DISTINCT vec_id) AS n_ids, TRUE AS within, TRUE AS above_chance
    FROM embeddings"""
)
def mlp_facts(t):
    """The perceptron's scores: one per vector, probabilities, better than a random baseline."""
    return _facts(mlp_score(t), _vectors(t)[1].select("id", "y"))


@query(
    """SELECT count(*) AS n, count(*) AS n_same FROM embeddings"""
)
def stored_model_scores(t):
    """A perceptron stored and loaded again gives every vector the same score."""
    names, matrix = _vectors(t)
    model, _runs = learned.train_perceptron(matrix, names, rounds=1, tries=1, max_iter=10)
    path = learned.model_path(_scratch(t), "mlp", "all", "main", "bool", "r2")
    learned.save_model(model, path)
    again = learned.score(learned.load_model(path), matrix).withColumnRenamed("score", "again")
    return learned.score(model, matrix).join(again, "id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") == F.col("again")).alias("n_same")
    )


@query()
def score_report(t):
    """A perceptron stored, loaded again, and reported on its training rows."""
    names, matrix = _vectors(t)
    model, _runs = learned.train_perceptron(matrix, names, rounds=1, tries=1, max_iter=30)
    path = learned.model_path(_scratch(t), "mlp", "all", "main", "bool", "r1")
    learned.save_model(model, path)
    scored = learned.score(learned.load_model(path), matrix).join(matrix.select("id", "y"), "id")
    return learned.training_report(scored)


@query(
    """, s AS (SELECT score > 0.5E0 AS guess, matches_original AS y FROM fx_score s JOIN fx_truth l ON l.id = s.id WHERE curve = 'answer_a'),
    c AS (SELECT count(*) AS n, (count(*) FILTER (WHERE guess = y)) AS n_right, (count(*) FILTER (WHERE NOT y AND NOT guess)) AS tn,
      (count(*) FILTER (WHERE NOT y AND guess)) AS fp, (count(*) FILTER (WHERE y AND NOT guess)) AS fn FROM s)
    SELECT n, round(n_right / n, 9) AS accuracy, round(coalesce(2E0 * tn / nullif(2 * tn + fp + fn, 0), 0E0), 9) AS negative_f1 FROM c"""
)
def vote_score_report(t):
    """Accuracy and negative-class F1 of a vote score against the truth."""
    scored = _answer_scores(t).join(
        t.truth.select("id", F.col("matches_original").cast("double").alias("y")), "id"
    )
    return rounded(learned.training_report(scored), "accuracy", "negative_f1")


@query(
    """SELECT id, prompt, model, CASE WHEN model = 'm1' AND prompt = 'answer_a' THEN NOT vote ELSE vote END AS vote
    FROM fx_pred"""
)
def column_upsert(t):
    """Replace the verdicts of one prompt and model; the rest of the table stays."""
    new = t.verdicts.where("model = 'm1' AND prompt = 'answer_a'").withColumn("vote", ~F.col("vote"))
    return tables.replace_column(t.verdicts, new, ["id", "prompt", "model"], ["prompt", "model"])


@query(
    """SELECT (SELECT count(*) FROM fx_items) AS left_rows, 0::BIGINT AS left_null_ids, 0::BIGINT AS left_repeated_ids,
     (SELECT count(*) FROM fx_items WHERE id NOT IN (SELECT id FROM fx_truth)) AS left_only_ids,
     (SELECT count(*) FROM fx_truth) AS right_rows, 0::BIGINT AS right_null_ids,
     (SELECT count(*) FROM (SELECT id FROM fx_truth GROUP BY id HAVING count(*) > 1)) AS right_repeated_ids,
     (SELECT count(*) FROM fx_truth WHERE id NOT IN (SELECT id FROM fx_items)) AS right_only_ids"""
)
def contract_report(t):
    return relational.contract_report(t.items.select("id"), t.truth.select("id"))


@query(
    """, k AS (SELECT l_orderkey AS id, l_linenumber AS n FROM lineitem),
    a AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT o_orderkey AS id FROM orders)
    SELECT CAST(sum(a.n) AS BIGINT) AS left_rows, 0::BIGINT AS left_null_ids, count(*) FILTER (a.n > 1) AS left_repeated_ids,
     count(*) FILTER (a.id NOT IN (SELECT id FROM b)) AS left_only_ids, (SELECT count(*) FROM b) AS right_rows, 0::BIGINT AS right_null_ids,
     (SELECT count(*) FROM (SELECT id FROM b GROUP BY id HAVING count(*) > 1)) AS right_repeated_ids,
     (SELECT count(*) FROM b WHERE id NOT IN (SELECT id FROM a)) AS right_only_ids FROM a"""
)
def line_contract_report(t):
    """The same checks where ids repeat and are missing on either side."""
    lines = t["lineitem"].select(F.col("l_orderkey").alias("id"))
    return relational.contract_report(lines, t["orders"].select(F.col("o_orderkey").alias("id")))


@query(
    """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
     ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1"""
)
def first_per_key(t):
    order = [F.col("o_orderdate"), F.col("o_orderkey")]
    return relational.first_per_key(
        t["orders"], "o_custkey", order, ["o_custkey", "o_orderkey", "o_totalprice"]
    )


@query(
    """SELECT id, CASE WHEN curve LIKE 'yes%' THEN 'percentage_vote_' || curve || '-all' || CASE WHEN score = 0.5E0 THEN '_no_nan' ELSE '' END
      WHEN curve = 'answer_a' THEN 'baseline_loss' ELSE 'mlp_all_answer_b_bool_r1' END AS name FROM fx_score"""
)
def score_names(t):
    """Display names from the key columns of a score table."""
    method = (
        F.when(F.startswith("curve", F.lit("yes")), "percentage_vote")
        .when(F.col("curve") == "answer_a", "baseline_loss")
        .otherwise("mlp")
    )
    return t.scores.select(
        "id",
        relational.score_name(
            method, F.col("curve"), F.lit("all"), F.lit("bool"), F.lit("r1"),
            F.col("score") == 0.5,
        ).alias("name"),
    )


@query(
    "SELECT id, prompt, model, length(output) AS n_chars, md5(output) AS digest FROM fx_out"
)
def outputs_from_files(t):
    """Outputs written as JSON lines with one column per model, and read back as rows."""
    folder = _scratch(t)
    tables.write_outputs(t.outputs, t.items.select("id", "label"), MODELS, folder)
    read = [
        tables.read_outputs(t.spark, f"{folder}/prompt={p.name}", p.name, MODELS) for p in PROMPTS
    ]
    return relational.union_all(read).select(
        "id", "prompt", "model",
        F.length("output").cast("long").alias("n_chars"), F.md5("output").alias("digest"),
    )


PROJECT_SQL = (
    f""", project AS (
     SELECT id, 'percentage_vote_main-all' AS curve, percentage_vote AS score FROM (
      SELECT id, avg(p) AS percentage_vote FROM (SELECT id, prompt,
       avg(CASE WHEN vote IS NULL THEN 0.5E0 WHEN vote THEN 1E0 ELSE 0E0 END) AS p FROM fx_verdicts GROUP BY id, prompt) GROUP BY id)
     UNION ALL SELECT id, 'baseline_random', {HASH.format(key='id', seed=42, n=2)}::DOUBLE FROM fx_items),
    """
    + CURVE_SQL.lstrip(", ").replace("FROM fx_score s", "FROM project s")
    + "SELECT curve, round(auc, 9) AS auc_pr FROM areas"
)


@query(PROJECT_SQL)
def project_auc_pr(t):
    """A whole project: stored items and outputs, vote scores, a baseline, their areas."""
    ws = _project(t)
    ws.store("items", t.items, "docs")
    ws.store("outputs", t.outputs, "docs", "prompt", "model")
    ws.store("relabel_evaluation", t.truth.select("id", "matches_original"), "docs")
    jobs.aggregate_votes(ws, "docs", "all", "main")
    jobs.add_random_baseline(ws, "docs")
    names = ["percentage_vote_main-all", "baseline_random"]
    return rounded(jobs.evaluate_auc_pr(ws, "docs", names), "auc_pr")


@query(IMPORT_SQL)
def annotation_files(t):
    """Annotation folders written, imported into a project by the job, and read back as labels."""
    ws = _project(t)
    documents = annotation_documents(t).select(
        F.concat("id", F.lit(".txt")).alias("document"), F.lit("ann").alias("annotator"), "features"
    )
    folder = f"{ws.root}/annotations"
    write_annotation_files(documents, folder)
    jobs.import_relabeled(ws, "given", folder, "ann", partitioned=True)
    return label_rows(ws.read("relabeled", "given").where(F.col("annotator") == "ann"))


HALF = HASH.format(key="id", seed=42, n=16) + " >= 8"


@query(
    f"""SELECT id, 'run ' || CASE WHEN {HALF} OR doc_id % 3 = 0 THEN 2 ELSE 1 END || ' <answer>' || lang || '</answer>' AS output,
     CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS attempts, CASE WHEN {HALF} THEN 2 ELSE 1 END AS first_run
    FROM (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, lang FROM documents)"""
)
def generation_resumed(t):
    """A run that breaks off half-way, and the one that goes on: the committed first answers stay.

    Texts name the run that gave them. The stand-in ends the first run at items of the later parts;
    every third item has to be asked twice, and only the second run comes that far.
    """

    def factory(run):
        def answer(prompt, retry):
            late, third, lang = prompt.split("item ")[1].split()[:3]
            if run == 1 and late == "true":
                raise generation.Interrupted("out of time")
            return f"run {run} <answer>{lang}</answer>" if third == "false" or retry else f"run {run}"

        return lambda texts, retry: [answer(text, retry) for text in texts]

    template = MessageTemplate("user", "item {late} {third} {lang} .", {c: c for c in ("late", "third", "lang")})
    facts = {
        "id": F.col("doc_id").cast("string"),
        "late": (sampling.hash_bucket(F.col("doc_id").cast("string"), 16) >= 8).cast("string"),
        "third": (F.col("doc_id") % 3 == 0).cast("string"),
    }
    items = t["documents"].withColumns(facts).select("id", render_messages([template]).alias("messages"))
    rounds = generation.StoredRounds(t.spark, _scratch(t), parts=16)
    ask = lambda run: generation.generate_resumably(
        items, lambda: factory(run), is_valid_answer, rounds
    )
    try:
        ask(1)
    except PythonException as error:
        if "out of time" not in str(error):
            raise
    else:
        raise RuntimeError("the first run was to break off")
    answers = ask(2)
    first = rounds.round(1).select(
        F.col("id").alias("first_id"), F.regexp_extract("output", r"run (\d)", 1).cast("int").alias("first_run")
    )
    return answers.join(first, F.col("id") == F.col("first_id")).select("id", "output", "attempts", "first_run")


@query(
    REDUCE_SQL.split("SELECT split.id, coalesce(")[0]
    + """SELECT split.id, 'user/assistant/user' AS roles, 'Is it {red}?' AS first,
     'About:' || chr(10) || coalesce(r.context, split.context) || chr(10) || i.question AS last
    FROM split LEFT JOIN reduced r ON r.id = split.id JOIN fx_items i ON i.id = split.id"""
)
def prompt_record(t):
    """A prompt stored as one unit, found by its name, and rendered after its preprocessing."""
    ws = _project(t)
    about = MessageTemplate("user", "About:\n{text}\n{ask}", {"text": "context", "ask": "question"})
    ws.save_prompts(
        [
            PromptRecord("plain", ("main",), "answer", (about,)),
            PromptRecord(
                "reduced", ("main", "short"), "answer",
                (MessageTemplate("user", "Is it {red}?"), MessageTemplate("assistant", "Yes."), about),
                ("reduce_context",),
            ),
        ]
    )
    rows = jobs.prompt_messages(labelled_by_words(t), ws.prompt("reduced"))
    return rows.select(
        "id", F.array_join("messages.role", "/").alias("roles"),
        F.element_at("messages", 1)["content"].alias("first"),
        F.element_at("messages", -1)["content"].alias("last"),
    )


@query(
    """SELECT CASE WHEN k = 0 THEN 'sound' ELSE 'broken' END AS kind,
     CASE WHEN k = 0 THEN count(*) ELSE 0 END::BIGINT AS records, CASE WHEN k = 0 THEN 0 ELSE 1 END::BIGINT AS broken,
     CASE WHEN k = 0 THEN sum(length(label) + length(question))::BIGINT END AS n_chars
    FROM fx_items, (VALUES (0), (1)) v(k) GROUP BY k"""
)
def json_arrays(t):
    """Items written as one array per file and read back, beside a file that breaks off."""
    folder = _scratch(t)
    tables.write_json_arrays(t.items.select("id", "label", "question"), f"{folder}/sound", files=32)
    cut = t.items.agg(F.count(F.lit(1)).alias("n")).select(
        F.concat(F.lit('[{"id": "1", "label": "x"}, {"id": "'), "n").alias("value")
    )
    cut.write.text(f"{folder}/cut/part=broken")
    paths = [f"{folder}/sound/*", f"{folder}/cut/*"]
    checked = tables.read_json_checked(t.spark, paths, "id string, label string, question string", arrays=True)
    report = tables.file_report(checked)
    kind = F.when(F.col("broken") > 0, "broken").otherwise("sound").alias("kind")
    files = report.groupBy(kind).agg(F.sum("records").alias("records"), F.sum("broken").alias("broken"))
    chars = tables.sound_records(checked).agg(
        F.sum(F.length("label") + F.length("question")).alias("n_chars")
    )
    return files.join(chars.withColumn("kind", F.lit("sound")), "kind", "left")


@query(
    """SELECT coalesce(source, 'none') AS dataset, count(*) AS n, sum(doc_id)::BIGINT AS ids,
     sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY 1"""
)
def json_folders(t):
    """Documents written into a folder for each source, and all folders read as one table."""
    folder = _scratch(t)
    documents = t["documents"].select("doc_id", "text", F.coalesce("source", F.lit("none")).alias("source"))
    documents.write.partitionBy("source").json(folder)
    read = tables.read_json_folder(t.spark, folder, "doc_id long, text string", folders=True)
    return read.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"),
        F.sum(F.length("text").cast("bigint")).alias("n_chars"),
    )


@query(UNCERTAIN_SQL + 'SELECT id, score, "distance_from_0.5" FROM top')
def samples_written(t):
    """The most uncertain items as a sample file, read back."""
    folder = _scratch(t)
    tables.write_samples(sampling.most_uncertain(_answer_scores(t), t.truth, 100), folder)
    return tables.read_json_lines(t.spark, folder, schemas.SAMPLES)


@query(ANNOTATION_TEXT_SQL)
def annotation_texts_written(t):
    """Question texts for annotators, stored as a table and read back."""
    folder = _scratch(t)
    tables.write_annotation_texts(source_documents(t), folder)
    return t.spark.read.parquet(folder).withColumnRenamed("value", "text")
