"""One query per operator over the driver tables, with SQL where SQL can say the same."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import (
    alignment,
    bottom_k,
    centroids,
    decontamination,
    line_runs,
    multi_index,
    packing,
    passages,
    tag_paths,
    token_rollup,
    toxicity,
    url_lists,
    url_rules,
    whitening,
)
from tallyframe.llm.tokens import byte_level_side, piece_side
from tallyframe.session import ensure_checkpoint_dir, materialise

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> tuple[str, str]:
    """Path of a public byte-pair vocabulary and its pre-token pattern."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN


# The added token of byte_bpe_50k.json (fixed value): the tokenizer finds its string inside texts.
SPECIAL_50K = {"<|endoftext|>": 50256}


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    labelled = toxicity.sample_labelled(documents, table(spark, sf_dir, "labels"))
    return toxicity.grade_documents(documents, toxicity.learn(labelled))


@query(
    "op2_spaced_seed_decontamination",
    r"""
WITH masks(mask, places) AS (VALUES
  (0, [1, 2, 3, 6, 7, 10]), (1, [1, 2, 7, 8, 9, 10]), (2, [1, 2, 4, 5, 8, 10])),
doc_words AS (
  SELECT DISTINCT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')),
    '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
item_words AS (
  SELECT DISTINCT item_id, list_filter(string_split_regex(lower(coalesce(text, '')),
    '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
doc_places AS (SELECT doc_id, w, unnest(range(0, len(w) - 9)) AS p FROM doc_words WHERE len(w) >= 10),
item_places AS (
  SELECT item_id, w, unnest(range(0, len(w) - 9)) AS p FROM item_words WHERE len(w) >= 10),
doc_seeds AS (
  SELECT doc_id, p, mask, list_transform(places, lambda i: w[p + i]) AS s FROM doc_places, masks),
item_seeds AS (
  SELECT item_id, p, mask, list_transform(places, lambda i: w[p + i]) AS s FROM item_places, masks),
hits AS (
  SELECT DISTINCT d.doc_id, i.item_id, d.p - i.p AS start_word
  FROM doc_seeds d JOIN item_seeds i ON d.mask = i.mask AND d.s = i.s),
points AS (
  SELECT h.doc_id, h.item_id, h.start_word, len(i.w) AS item_words, j.j,
    sum(CASE WHEN h.start_word + j.j >= 1 AND h.start_word + j.j <= len(d.w)
      AND d.w[h.start_word + j.j] = i.w[j.j] THEN 1 ELSE -1 END)
      OVER (PARTITION BY h.doc_id, h.item_id, h.start_word ORDER BY j.j) AS total
  FROM hits h JOIN doc_words d ON d.doc_id = h.doc_id JOIN item_words i ON i.item_id = h.item_id,
    range(1, 1000) j(j)
  WHERE j.j <= len(i.w)),
rises AS (
  SELECT *, total - least(0, coalesce(min(total) OVER (PARTITION BY doc_id, item_id, start_word
    ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS rise FROM points),
scores AS (
  SELECT doc_id, item_id, item_words, start_word, max(rise) AS overlap
  FROM rises GROUP BY ALL HAVING max(rise) >= least(10, item_words))
SELECT doc_id, item_id, CAST(max(overlap) AS INTEGER) AS overlap,
  CAST(item_words AS INTEGER) AS item_words,
  CAST(arg_min(start_word, (-overlap) * 1000000 + start_word) AS INTEGER) AS start_word
FROM scores GROUP BY doc_id, item_id, item_words""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


@query("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(
        table(spark, sf_dir, "documents"), *vocabulary("byte_bpe_50k"), special=SPECIAL_50K
    )


@query(
    "op4_line_dedup",
    """
WITH lines AS (
  SELECT doc_id, i,
    lines[i] AS line,
    translate(trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents) t,
    range(1, 100000) r(i)
  WHERE i <= len(lines)),
often AS (
  SELECT key, max(doc_id) AS top FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT l.doc_id, l.i, l.line, coalesce(l.doc_id <> o.top, FALSE) AS gone
  FROM lines l LEFT JOIN often o ON l.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), ''))
    AS kept_sha256
FROM marked GROUP BY doc_id""",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.line_decisions(table(spark, sf_dir, "documents"))


@query(
    "op5_minhash_near_dedup",
    r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS w
  FROM documents),
places AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * m >= 80 * (x.n + y.n - m)),
reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
lowest AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id,
  d.doc_id = c.component_id AS kept
FROM documents d JOIN lowest c ON c.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottom_k.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = (centroids.fold(F.col("doc_id")) == 1).alias("held_out")
    model = centroids.learn(documents.where(centroids.fold(F.col("doc_id")) != 1))
    return centroids.predict(documents, model).select(
        "doc_id", held_out, "lang_pred", "score", "rejected"
    )


@query("op7_tag_path_extraction")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_paths.extract(table(spark, sf_dir, "pages"))


@query(
    "op8_multi_index_top_k",
    """
WITH codes AS (
  SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS bits FROM embeddings),
pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id,
    CAST(len(list_filter(list_zip(q.bits, r.bits), lambda z: z[1] <> z[2])) AS INTEGER) AS distance
  FROM codes q JOIN codes r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER)
    AS rank FROM pairs)
SELECT query_id, vec_id, distance, rank FROM ranked WHERE rank <= 10""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return multi_index.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=10)


@query("op9_token_rollup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after a draft of every document (a quarter of its code points), a revision of every
    document by its real counts, and a repeated commit, in four parts each."""
    names = ("byte_bpe_50k", "byte_bpe_multi_50k")
    counts = materialise(
        token_rollup.count_tokens(
            table(spark, sf_dir, "documents"), {name: vocabulary(name) for name in names}
        )
    )
    rollup = token_rollup.TokenRollup(spark, new_folder(spark, "token-rollup"))
    parts = [counts.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == k) for k in range(4)]
    for k, part in enumerate(parts):
        draft = part.withColumn("tokens", F.col("chars").bitwiseAND(F.lit(-4)) / 4)
        draft = draft.withColumn("tokens", F.col("tokens").cast("bigint"))
        rollup.commit(f"draft-{k}", token_rollup.inserts(draft))
        rollup.commit(f"revised-{k}", token_rollup.revisions(draft, part))
    rollup.commit("draft-0", token_rollup.inserts(parts[0]))
    return rollup.totals()


@query("op10_repeated_passages")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


@query("op11_block_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = whitening.quantise(
        table(spark, sf_dir, "embeddings"), "embedding", scale=64, shift=1_000_000
    )
    whitened = whitening.whiten(points, components=32)
    return whitened.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def _values(*rows: tuple) -> str:
    return ", ".join("(" + ", ".join(repr(v) for v in row) + ")" for row in rows)


# Regular expressions of the patterns over whole URLs, written out by hand for the SQL.
URL_EXPRESSIONS = [
    ("/adserver/", "block", "/adserver/"),
    ("/adclick^", "block", "/adclick([^A-Za-z0-9]|$)"),
    ("^adframe.", "block", "(^|[^A-Za-z0-9])adframe[.]"),
    ("/popunder^", "block", "/popunder([^A-Za-z0-9]|$)"),
    ("/track/*.gif^", "block", "/track/.*[.]gif([^A-Za-z0-9]|$)"),
    ("^anti-spam^", "allow", "(^|[^A-Za-z0-9])anti-spam([^A-Za-z0-9]|$)"),
    ("^racetrack^track^", "allow", "(^|[^A-Za-z0-9])racetrack[^A-Za-z0-9]track([^A-Za-z0-9]|$)"),
    ("^responsible-betting^", "allow", "(^|[^A-Za-z0-9])responsible-betting([^A-Za-z0-9]|$)"),
]


@query(
    "op12_url_rules",
    f"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN contains(url, '://')
    THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS behind FROM pages),
split AS (
  SELECT page_id, url, behind,
    translate(regexp_extract(behind, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(behind, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
sites(rule, action) AS (VALUES {_values(*url_lists.SITE_RULES)}),
site_hits AS (
  SELECT DISTINCT url, rule, action, length(rule) AS size
  FROM split, sites
  WHERE (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
    AND starts_with(path, substr(rule, strpos(rule, '/')))),
best_site AS (
  SELECT url, arg_max(rule, size) AS rule, arg_max(action, size) AS action
  FROM site_hits GROUP BY url),
words(pattern, expression) AS (
  SELECT '^' || w || '^', '(^|[^A-Za-z0-9])' || w || '([^A-Za-z0-9]|$)'
  FROM (VALUES {_values(*((w,) for w in url_lists.BLOCKED_HOST_WORDS))}) t(w)),
patterns(pattern, action, expression) AS (VALUES {_values(*URL_EXPRESSIONS)}),
pattern_hits AS (
  SELECT DISTINCT url, pattern, 'block' AS action FROM split, words
  WHERE regexp_matches(host, expression)
  UNION ALL
  SELECT DISTINCT url, pattern, action FROM split, patterns
  WHERE regexp_matches(host || substr(behind, length(host) + 1), expression, 's')),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY url
    ORDER BY length(pattern) DESC, action, pattern) AS place FROM pattern_hits)
SELECT s.page_id, s.host, s.path, b.rule,
  coalesce(b.action, r.action, 'allow') AS verdict,
  CASE WHEN b.rule IS NULL THEN r.pattern END AS pattern
FROM split s LEFT JOIN best_site b ON b.url = s.url
LEFT JOIN ranked r ON r.url = s.url AND r.place = 1""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = (
        [url_rules.site_rule(*rule) for rule in url_lists.SITE_RULES]
        + [url_rules.pattern_rule(f"^{w}^", "block", "host") for w in url_lists.BLOCKED_HOST_WORDS]
        + [url_rules.pattern_rule(p, "block") for p in url_lists.BLOCKED_PATTERNS]
        + [url_rules.pattern_rule(p, "allow") for p in url_lists.ALLOWED_PATTERNS]
    )
    judged = url_rules.judge(
        table(spark, sf_dir, "pages"), spark.createDataFrame(rules, url_rules.RULES)
    )
    return judged.select(
        "page_id", "host", "path",
        F.when(F.col("tier") == 1, F.col("rule")).alias("rule"),
        F.coalesce("action", F.lit("allow")).alias("verdict"),
        F.when(F.col("tier") == 0, F.col("rule")).alias("pattern"),
    )


@query("op13_galloping_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = vocabulary("byte_bpe_50k")
    model = public_tokenizers.path("piece_bpe_32k.model")
    return alignment.link_statistics(
        table(spark, sf_dir, "documents"),
        lambda: byte_level_side(ranks, pattern),
        lambda: piece_side(model),
    )
