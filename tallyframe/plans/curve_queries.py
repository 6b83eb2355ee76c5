"""Queries: curves, sweeps and the ensemble search."""

from pyspark.sql import functions as F

from tallyframe.operators import curves, metrics, relational, search
from tallyframe.plans.catalog import MODELS, PROMPT_NAMES, query, rounded
from tallyframe.plans.vote_queries import RATE_SQL, RATES, confusion_sql

CURVE_SQL = """, ranked AS (
 SELECT s.curve, s.id, s.score, NOT coalesce(l.matches_original, FALSE) AS wrong,
  row_number() OVER (PARTITION BY s.curve ORDER BY s.score, s.id) AS rank,
  sum(CASE WHEN coalesce(l.matches_original, FALSE) THEN 0 ELSE 1 END)
   OVER (PARTITION BY s.curve ORDER BY s.score, s.id ROWS UNBOUNDED PRECEDING) AS tp,
  sum(CASE WHEN coalesce(l.matches_original, FALSE) THEN 0 ELSE 1 END) OVER (PARTITION BY s.curve) AS total
 FROM fx_score s JOIN fx_truth l ON l.id = s.id WHERE s.score IS NOT NULL),
points AS (SELECT curve, id, score, wrong, rank, tp / rank AS p, coalesce(tp / nullif(total, 0), 0E0) AS r FROM ranked),
areas AS (SELECT curve, coalesce(sum((r - pr) * (p + pp) / 2), 0E0) AS auc FROM (
 SELECT curve, p, r, lag(p) OVER w AS pp, lag(r) OVER w AS pr FROM points
 WINDOW w AS (PARTITION BY curve ORDER BY rank)) GROUP BY curve)
"""


@query(
    CURVE_SQL
    + 'SELECT curve, id, round(score, 9) AS score, wrong, CAST(rank AS BIGINT) AS rank, '
    'round(p, 9) AS "precision", round(r, 9) AS recall FROM points'
)
def pr_curve(t):
    rows = curves.pr_curve(curves.curve_rows(t.scores, t.truth))
    return rounded(rows, "score", "precision", "recall")


@query(CURVE_SQL + "SELECT curve, round(auc, 9) AS auc_pr FROM areas")
def auc_pr(t):
    return rounded(curves.auc_pr(curves.curve_rows(t.scores, t.truth)), "auc_pr")


COMPARED = ["answer_a", "yes_no_b"]


@query(
    """, gaps AS (SELECT id, curve, CASE WHEN curve = 'answer_a' AND CAST(id AS BIGINT) % 5 = 0 THEN NULL ELSE score END AS score
      FROM fx_score WHERE curve IN ('answer_a', 'yes_no_b')),
    kept AS (SELECT id FROM gaps GROUP BY id HAVING count(score) = 2),
    """
    + CURVE_SQL.lstrip(", ").replace(
        "FROM fx_score s", "FROM (SELECT * FROM gaps WHERE id IN (SELECT id FROM kept)) s"
    )
    + "SELECT curve, round(auc, 9) AS auc_pr FROM areas"
)
def auc_pr_complete(t):
    """Areas over the items that have a score in every compared curve."""
    gap = (F.col("curve") == "answer_a") & (F.col("id").cast("long") % 5 == 0)
    scores = t.scores.withColumn("score", F.when(~gap, F.col("score")))
    whole = relational.complete_rows(scores, COMPARED)
    return rounded(curves.auc_pr(curves.curve_rows(whole, t.truth)), "auc_pr")


def _sweep_sql(source: str, by: str) -> str:
    return f"""SELECT {by}, t.i AS t_idx, t.i * 0.05E0 AS threshold,
      {confusion_sql("(NOT coalesce(score <= t.i * 0.05E0, FALSE))")}
     FROM {source}, (SELECT unnest(range(21))::INT AS i) t GROUP BY {by}, t.i"""


LABELLED = ", joined AS (SELECT s.*, l.matches_original FROM fx_score s JOIN fx_truth l ON l.id = s.id)"
SWEEP_SQL = LABELLED + f", counts AS ({_sweep_sql('joined', 'curve')}), sweep AS (SELECT *, {RATE_SQL} FROM counts)"
SWEEP_COLUMNS = ["curve", "t_idx", "threshold", "tp", "fp", "tn", "fn", *RATES[:4]]


@query(
    SWEEP_SQL
    + 'SELECT curve, t_idx, round(threshold, 9) AS threshold, tp, fp, tn, fn, accuracy, "precision", recall, f1_score FROM sweep'
)
def threshold_sweep(t):
    sweep = curves.threshold_sweep(t.scores, t.truth).select(*SWEEP_COLUMNS)
    return rounded(sweep, "threshold", *RATES[:4])


BEST = """SELECT {by}, t_idx, round(threshold, 9) AS threshold, accuracy, "precision", recall, f1_score
 FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY f1_score DESC, t_idx) AS rn FROM sweep) WHERE rn = 1"""


@query(SWEEP_SQL + BEST.format(by="curve"))
def best_threshold(t):
    best = curves.best_threshold(curves.threshold_sweep(t.scores, t.truth))
    return rounded(best, "threshold", *RATES[:4])


@query(
    SWEEP_SQL
    + 'SELECT curve, tp, fp, tn, fn, accuracy, "precision", recall, f1_score FROM sweep WHERE t_idx = 10'
)
def sweep_at_half(t):
    rows = curves.at_half(curves.threshold_sweep(t.scores, t.truth))
    return rounded(rows.select("curve", "tp", "fp", "tn", "fn", *RATES[:4]), *RATES[:4])


F1_SQL = (
    LABELLED
    + """, neg AS (SELECT curve, t.i AS t_idx, t.i * 0.01E0 AS threshold,
  (count(*) FILTER (WHERE NOT coalesce(matches_original, FALSE) AND NOT coalesce(score > t.i * 0.01E0, FALSE))) AS tn,
  (count(*) FILTER (WHERE coalesce(matches_original, FALSE) AND NOT coalesce(score > t.i * 0.01E0, FALSE))) AS fn,
  (count(*) FILTER (WHERE NOT coalesce(matches_original, FALSE) AND coalesce(score > t.i * 0.01E0, FALSE))) AS fp
 FROM joined, (SELECT unnest(range(101))::INT AS i) t GROUP BY curve, t.i),
f1 AS (SELECT *, tn / nullif(tn + fn, 0) AS p, tn / nullif(tn + fp, 0) AS r,
  CASE WHEN tn + fn > 0 AND tn + fp > 0 AND tn > 0 THEN 2E0 * tn / (2 * tn + fn + fp) END AS f
 FROM neg)
"""
)


@query(
    F1_SQL
    + 'SELECT curve, t_idx, round(threshold, 9) AS threshold, tn, fn, fp, round(p, 9) AS "precision", '
    "round(r, 9) AS recall, round(f, 9) AS f1_score FROM f1"
)
def f1_sweep(t):
    return rounded(
        curves.f1_sweep(t.scores, t.truth), "threshold", "precision", "recall", "f1_score"
    )


@query(
    F1_SQL
    + "SELECT curve, round(max(f), 9) AS max_f1, round(min(CASE WHEN r = 1 THEN threshold END), 9) AS full_recall_from, "
    "round(max(CASE WHEN p = 1 THEN threshold END), 9) AS full_precision_to FROM f1 GROUP BY curve"
)
def f1_summary(t):
    summary = curves.f1_summary(curves.f1_sweep(t.scores, t.truth))
    return rounded(summary, "max_f1", "full_recall_from", "full_precision_to")


@query(
    LABELLED
    + """, c AS (SELECT curve,
      (count(*) FILTER (WHERE NOT coalesce(matches_original, FALSE) AND NOT coalesce(score >= 0.5E0, FALSE))) AS tn,
      (count(*) FILTER (WHERE NOT coalesce(matches_original, FALSE) AND coalesce(score >= 0.5E0, FALSE))) AS fp,
      (count(*) FILTER (WHERE coalesce(matches_original, FALSE) AND NOT coalesce(score >= 0.5E0, FALSE))) AS fn
     FROM joined GROUP BY curve)
    SELECT curve, tn, fp, fn, round(coalesce(tn / nullif(tn + fn, 0), 0E0), 9) AS "precision",
     round(coalesce(tn / nullif(tn + fp, 0), 0E0), 9) AS recall,
     round(coalesce(2E0 * tn / nullif(2 * tn + fn + fp, 0), 0E0), 9) AS f1_score FROM c"""
)
def f1_at_half(t):
    return rounded(metrics.f1_at(t.scores, t.truth), "precision", "recall", "f1_score")


@query(
    SWEEP_SQL
    + """SELECT curve, arg_max(t_idx, struct_pack(f := f1_score, i := -t_idx)) AS best_run,
     max(f1_score) AS best_score, round(avg(f1_score), 8) AS mean_score FROM sweep GROUP BY curve"""
)
def best_and_mean_run(t):
    """Thresholds as repeated runs: the best one and the mean, per curve."""
    runs = rounded(curves.threshold_sweep(t.scores, t.truth), "f1_score")
    best = metrics.best_and_mean_run(runs, score="f1_score", run="t_idx", by=["curve"])
    return rounded(best, "mean_score", digits=8)


SUBSET_SQL = """, models AS (SELECT * FROM (VALUES ('m0',0),('m1',1),('m2',2),('m3',3)) AS x(model, k)),
prompts AS (SELECT * FROM (VALUES ('answer_a',0),('answer_b',1),('yes_no_a',2),('yes_no_b',3)) AS x(prompt, k)),
model_masks AS (SELECT mask, model FROM (SELECT unnest(range(1, 16))::INT AS mask) r JOIN models ON (mask >> k) & 1 = 1),
prompt_masks AS (SELECT mask, prompt FROM (SELECT unnest(range(1, 16))::INT AS mask) r JOIN prompts ON (mask >> k) & 1 = 1),
model_names AS (SELECT mask, string_agg(model, ',' ORDER BY model) AS ensemble FROM model_masks GROUP BY mask),
prompt_names AS (SELECT mask, string_agg(prompt, ',' ORDER BY prompt) AS prompt_group FROM prompt_masks GROUP BY mask),
per_model AS (
 SELECT mm.mask AS model_mask, v.prompt, v.id, l.matches_original,
  avg(CASE WHEN vote IS NULL THEN 0.5E0 WHEN vote THEN 1E0 ELSE 0E0 END) AS pct,
  (count(*) FILTER (WHERE vote)) > (count(*) FILTER (WHERE NOT vote)) AS maj,
  CASE WHEN (count(*) FILTER (WHERE vote)) = count(*) THEN TRUE WHEN (count(*) FILTER (WHERE NOT vote)) = count(*) THEN FALSE END AS una
 FROM fx_pred v JOIN fx_truth l ON l.id = v.id JOIN model_masks mm USING (model) GROUP BY ALL),
subsets AS (
 SELECT model_mask, pm.mask AS prompt_mask, id, matches_original, avg(pct) AS score,
  (count(*) FILTER (WHERE maj)) * 2 > count(maj) AS majority_vote,
  CASE WHEN (count(*) FILTER (WHERE una)) = count(*) THEN TRUE WHEN (count(*) FILTER (WHERE NOT una)) = count(*) THEN FALSE END AS unanimous_vote
 FROM per_model JOIN prompt_masks pm USING (prompt) GROUP BY model_mask, pm.mask, id, matches_original),
long AS (
 SELECT model_mask, prompt_mask, 'majority_vote' AS c, majority_vote AS vote, matches_original FROM subsets
 UNION ALL SELECT model_mask, prompt_mask, 'unanimous_vote', unanimous_vote, matches_original FROM subsets),
"""
SUBSET_METRICS_SQL = (
    SUBSET_SQL
    + f"""counts AS (SELECT model_mask, prompt_mask, c, {confusion_sql("vote")} FROM long GROUP BY 1, 2, 3),
measured AS (SELECT model_mask, prompt_mask, c AS "column", tp, fp, tn, fn, none_fn, none_fp, {RATE_SQL} FROM counts)
"""
)


def _profile(t):
    return search.subset_profile(
        search.subset_votes(t.verdicts, t.truth, MODELS, PROMPT_NAMES)
    )


@query(
    SUBSET_METRICS_SQL
    + """SELECT ensemble, prompt_group, "column", tp, fp, tn, fn, none_fn, none_fp, accuracy, "precision", recall, f1_score, no_prediction
    FROM measured JOIN model_names n ON n.mask = model_mask JOIN prompt_names p ON p.mask = prompt_mask"""
)
def subset_search(t):
    found = search.named(search.subset_vote_metrics(_profile(t)), MODELS, PROMPT_NAMES)
    return rounded(found.drop(*search.MASKS), *RATES)


@query(
    SUBSET_METRICS_SQL
    + ", picked AS ("
    + " UNION ALL ".join(
        f"""SELECT "column", '{m}' AS metric, model_mask, prompt_mask, "{m}" AS value,
        row_number() OVER (PARTITION BY "column" ORDER BY "{m}" DESC, model_mask, prompt_mask) AS rn FROM measured"""
        for m in ("f1_score", "accuracy", "precision", "recall")
    )
    + """) SELECT "column", metric, ensemble, prompt_group, value FROM picked
    JOIN model_names n ON n.mask = model_mask JOIN prompt_names p ON p.mask = prompt_mask WHERE rn = 1"""
)
def subset_best(t):
    measured = rounded(search.subset_vote_metrics(_profile(t)), *RATES)
    best = search.named(search.best_subsets(measured), MODELS, PROMPT_NAMES)
    return best.drop(*search.MASKS)


SUBSET_SWEEP_SQL = (
    SUBSET_SQL
    + f"counts AS ({_sweep_sql('subsets', 'model_mask, prompt_mask')}), sweep AS (SELECT *, {RATE_SQL} FROM counts)"
)


@query(
    SUBSET_SWEEP_SQL
    + ", best AS ("
    + BEST.format(by="model_mask, prompt_mask")
    + """) SELECT ensemble, prompt_group, t_idx, threshold, accuracy, "precision", recall, f1_score
    FROM best JOIN model_names n ON n.mask = model_mask JOIN prompt_names p ON p.mask = prompt_mask"""
)
def subset_best_threshold(t):
    sweep = rounded(search.subset_sweep(_profile(t)), *RATES[:4])
    best = search.named(curves.best_threshold(sweep, search.MASKS), MODELS, PROMPT_NAMES)
    return rounded(best.drop(*search.MASKS), "threshold")


@query(
    SUBSET_SWEEP_SQL
    + """SELECT ensemble, prompt_group, accuracy, "precision", recall, f1_score
    FROM sweep JOIN model_names n ON n.mask = model_mask JOIN prompt_names p ON p.mask = prompt_mask WHERE t_idx = 10"""
)
def subset_at_half(t):
    rows = curves.at_half(search.subset_sweep(_profile(t)))
    named = search.named(rows, MODELS, PROMPT_NAMES)
    return rounded(named.select("ensemble", "prompt_group", *RATES[:4]), *RATES[:4])


SUBSET_AREA_SQL = (
    SUBSET_SQL
    + """ranked AS (
 SELECT *, row_number() OVER w AS rank, sum(CASE WHEN coalesce(matches_original, FALSE) THEN 0 ELSE 1 END) OVER w AS tp,
  sum(CASE WHEN coalesce(matches_original, FALSE) THEN 0 ELSE 1 END) OVER (PARTITION BY model_mask, prompt_mask) AS total
 FROM (SELECT model_mask, prompt_mask, id, matches_original, round(score, 12) AS score FROM subsets)
 WINDOW w AS (PARTITION BY model_mask, prompt_mask ORDER BY score, id ROWS UNBOUNDED PRECEDING)),
pts AS (SELECT model_mask, prompt_mask, rank, tp / rank AS p, tp / total AS r FROM ranked),
areas AS (SELECT model_mask, prompt_mask, sum((r - pr) * (p + pp) / 2) AS auc FROM (
 SELECT *, lag(p) OVER w AS pp, lag(r) OVER w AS pr FROM pts
 WINDOW w AS (PARTITION BY model_mask, prompt_mask ORDER BY rank)) GROUP BY 1, 2),
named AS (SELECT ensemble, prompt_group, round(auc, 9) AS auc_pr
 FROM areas JOIN model_names n ON n.mask = model_mask JOIN prompt_names p ON p.mask = prompt_mask)
"""
)


def _areas(t):
    """Areas of all subsets; shares are rounded so that summation order makes no ties differ."""
    found = search.subset_auc_pr(t.verdicts, t.truth, MODELS, PROMPT_NAMES)
    named = search.named(found, MODELS, PROMPT_NAMES)
    return rounded(named.select("ensemble", "prompt_group", "auc_pr"), "auc_pr")


@query(SUBSET_AREA_SQL + "SELECT ensemble, prompt_group, auc_pr FROM named")
def subset_auc_pr(t):
    return _areas(t)


@query(
    SUBSET_AREA_SQL
    + """, sized AS (SELECT *, len(string_split(ensemble, ',')) AS nm, len(string_split(prompt_group, ',')) AS np FROM named)
    SELECT varied, CAST(k AS INT) AS k, count(*) AS n, round(avg(auc_pr), 8) AS mean_auc_pr,
     min(auc_pr) AS min_auc_pr, max(auc_pr) AS max_auc_pr
    FROM (SELECT 'models' AS varied, nm AS k, auc_pr FROM sized WHERE np = 4
          UNION ALL SELECT 'prompts', np, auc_pr FROM sized WHERE nm = 4) GROUP BY varied, k"""
)
def subset_scaling(t):
    rows = search.scaling_curves(_areas(t), len(MODELS), len(PROMPT_NAMES))
    return rounded(rows, "mean_auc_pr", digits=8)


@query(
    SUBSET_METRICS_SQL
    + """SELECT ensemble, prompt_group, "column", f1_score FROM measured
    JOIN model_names n ON n.mask = model_mask JOIN prompt_names p ON p.mask = prompt_mask
    WHERE len(string_split(ensemble, ',')) = 2 AND len(string_split(prompt_group, ',')) = 4"""
)
def subset_of_size(t):
    found = search.named(search.subset_vote_metrics(_profile(t)), MODELS, PROMPT_NAMES)
    kept = search.by_subset_size(found, models=2, prompts=4)
    return rounded(kept.select("ensemble", "prompt_group", "column", "f1_score"), "f1_score")
