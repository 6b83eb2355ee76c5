"""Agreement of annotators and of predictions with re-annotated labels.

A re-annotated table has ``id, annotator, entries, other_texts, unanswerable``.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.matching import (
    contained_pair_ratio,
    entity_f1,
    entity_iou,
    flat_labels,
    label_matches,
    relabeled_f1,
    set_iou,
)
from tallyframe.functions.parsing import exact_match


def annotator_pairs(relabeled: DataFrame, first: str, second: str) -> DataFrame:
    """Rows of two named annotators for the same id, one row per shared id."""
    columns = ["annotator", "entries", "other_texts", "unanswerable"]
    side = lambda who, name: relabeled.where(F.col("annotator") == who).select(
        "id", F.struct(*columns).alias(name)
    )
    return side(first, "a").join(side(second, "b"), "id")


def all_annotator_pairs(relabeled: DataFrame) -> DataFrame:
    """Rows of every two annotators of an id, the lower name as ``a``.

    The rows of an id, one for each annotator, are gathered by one shuffle and paired in place; rows
    without a name take part in no pair.
    """
    row = F.struct("annotator", "entries", "other_texts", "unanswerable")
    gathered = relabeled.where(F.col("annotator").isNotNull()).groupBy("id").agg(F.collect_list(row).alias("rows"))
    later = lambda a: F.filter("rows", lambda b: a["annotator"] < b["annotator"])
    pairs = F.flatten(
        F.transform(
            "rows", lambda a: F.transform(later(a), lambda b: F.struct(a.alias("a"), b.alias("b")))
        )
    )
    return gathered.select("id", F.explode(pairs).alias("p")).select("id", "p.a", "p.b")


def answerable_pairs(pairs: DataFrame) -> DataFrame:
    """Leave out pairs in which either annotator flags the item as unanswerable."""
    flag = lambda s: F.coalesce(F.col(f"{s}.unanswerable"), F.lit(False))
    return pairs.where(~(flag("a") | flag("b")))


def pair_scores(
    pairs: DataFrame, labels_only: bool = False, skip_unanswerable: bool = True
) -> DataFrame:
    """Agreement values of each pair of rows; overlaps of spans only where both can answer, unless
    unanswerable items are not to be skipped."""
    flat = lambda s: flat_labels(F.col(f"{s}.entries"), F.col(f"{s}.other_texts"))
    flag = lambda s: F.coalesce(F.col(f"{s}.unanswerable"), F.lit(False))
    texts = pairs.withColumns({"flat_a": flat("a"), "flat_b": flat("b")})
    answerable = ~(flag("a") | flag("b")) if skip_unanswerable else F.lit(True)
    a, b = F.col("flat_a"), F.col("flat_b")
    return texts.select(
        "id",
        F.col("a.annotator").alias("annotator_a"),
        F.col("b.annotator").alias("annotator_b"),
        F.col("a.unanswerable").eqNullSafe(F.col("b.unanswerable")).alias("same_flag"),
        set_iou(a, b).alias("iou"),
        F.when(answerable, contained_pair_ratio(a, b)).alias("pair_ratio"),
        F.when(
            answerable, entity_iou(F.col("a.entries"), F.col("b.entries"), labels_only)
        ).alias("entity_iou"),
    )


def annotator_agreement(scores: DataFrame) -> DataFrame:
    """Mean agreement per annotator pair; undefined overlaps are left out of the means."""
    return scores.groupBy("annotator_a", "annotator_b").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.avg(F.col("same_flag").cast("int")).alias("unanswerable_agreement"),
        F.avg("iou").alias("mean_iou"),
        F.avg("pair_ratio").alias("mean_pair_ratio"),
        F.coalesce(F.avg("entity_iou"), F.lit(0.0)).alias("mean_entity_iou"),
    )


def prediction_scores(answers: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean exact match and mean F1 per model against the original labels."""
    scored = answers.join(labels.select("id", "label"), "id").select(
        "model",
        F.coalesce(exact_match(F.col("answer"), F.col("label")), F.lit(False))
        .cast("double")
        .alias("em"),
        entity_f1(F.col("answer"), F.col("label")).alias("f1"),
    )
    return scored.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.avg("em").alias("exact_match"), F.avg("f1").alias("f1")
    )


def relabeled_prediction_scores(answers: DataFrame, relabeled: DataFrame) -> DataFrame:
    """Mean exact match and mean F1 per model against the re-annotated labels."""
    truth = relabeled.select("id", "entries", "unanswerable")
    a, e, u = F.col("answer"), F.col("entries"), F.col("unanswerable")
    scored = answers.join(truth, "id").select(
        "model",
        label_matches(a, e, u).cast("double").alias("em"),
        relabeled_f1(a, e, u).alias("f1"),
    )
    return scored.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.avg("em").alias("exact_match"), F.avg("f1").alias("f1")
    )


def evaluate_relabeling(
    relabeled: DataFrame,
    items: DataFrame,
    prior: DataFrame | None = None,
    reviews: DataFrame | None = None,
    redo: bool = False,
) -> DataFrame:
    """Compare re-annotations with the original labels.

    Rows evaluated before are taken over as they are unless ``redo``. Otherwise a mismatch
    takes the latest review decision (``reviews(id, decision, ts)``, ``y`` or ``n``); of two at the
    same time ``y`` holds, and one without a time counts as the earliest.
    """
    looked_up = relabeled.join(
        items.select("id", F.col("label").alias("original_label"), "question"), "id", "left"
    )
    rows = looked_up.withColumn(
        "matches_original",
        label_matches(F.col("original_label"), F.col("entries"), F.col("unanswerable")),
    ).withColumn("manual_review", F.lit(None).cast("boolean"))
    if reviews is not None:
        latest = (
            reviews.where(F.lower("decision").isin("y", "n"))
            .groupBy("id")
            .agg(F.max(F.struct("ts", F.lower("decision").alias("decision")))["decision"].alias("decision"))
        )
        reviewed = ~F.col("matches_original") & F.col("decision").isNotNull()
        rows = (
            rows.join(latest, "id", "left")
            .withColumns(
                {
                    "matches_original": F.when(reviewed, F.col("decision") == "y").otherwise(
                        F.col("matches_original")
                    ),
                    "manual_review": F.when(reviewed, True),
                }
            )
            .drop("decision")
        )
    if prior is None or redo:
        return rows
    kept = [c for c in rows.columns if c != "id"]
    earlier = prior.select("id", F.struct(*kept).alias("earlier"))
    joined = rows.join(earlier, "id", "left")
    return joined.select(
        "id",
        *[
            F.when(F.col("earlier").isNotNull(), F.col("earlier")[c])
            .otherwise(F.col(c))
            .alias(c)
            for c in kept
        ],
    )


def matched_share(evaluated: DataFrame) -> DataFrame:
    """Share of rows whose labels match, by rule or by review."""
    return evaluated.agg(
        F.count_if("matches_original").alias("matches"),
        F.count(F.lit(1)).alias("total_rows"),
        F.avg(F.coalesce(F.col("matches_original"), F.lit(False)).cast("int")).alias("share"),
    )

