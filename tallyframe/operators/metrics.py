"""Confusion counts and rates; the positive class is "the original label is wrong"."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.numbers import harmonic, ratio, ratio_or_zero
from tallyframe.operators.relational import attach_statistics

COUNTS = ("tp", "fp", "tn", "fn", "none_fn", "none_fp")


def with_labels(scores: DataFrame, labels: DataFrame, columns: Sequence[str] = ("matches_original",)) -> DataFrame:
    """Keep the ids both tables share, with the truth columns attached."""
    return scores.join(labels.select("id", *columns), "id")


def confusion_counts(says_wrong: Column, is_wrong: Column, weight: Column | None = None) -> list[Column]:
    """Six counts; a NULL prediction is set apart, a NULL truth counts as not wrong."""
    wrong = F.coalesce(is_wrong, F.lit(False))

    def total(condition: Column, name: str) -> Column:
        if weight is None:
            return F.count_if(condition).alias(name)
        return F.coalesce(F.sum(F.when(condition, weight)), F.lit(0)).cast("long").alias(name)

    return [
        total(says_wrong & wrong, "tp"),
        total(says_wrong & ~wrong, "fp"),
        total(~says_wrong & ~wrong, "tn"),
        total(~says_wrong & wrong, "fn"),
        total(says_wrong.isNull() & wrong, "none_fn"),
        total(says_wrong.isNull() & ~wrong, "none_fp"),
    ]


def rates(df: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 and share without prediction from the six counts.

    A missing prediction on a wrong label is a false negative; one on a right label enters
    the missing share alone. Undefined rates are 0, an undefined share is NULL.
    """
    tp, fp, tn = F.col("tp"), F.col("fp"), F.col("tn")
    fn = F.col("fn") + F.col("none_fn")
    total = tp + tn + fp + fn
    return (
        df.withColumns(
            {
                "accuracy": ratio_or_zero(tp + tn, total),
                "precision": ratio_or_zero(tp, tp + fp),
                "recall": ratio_or_zero(tp, tp + fn),
                "no_prediction": ratio(F.col("none_fp") + F.col("none_fn"), total),
            }
        )
        .withColumn(
            "f1_score", F.coalesce(harmonic(F.col("precision"), F.col("recall")), F.lit(0.0))
        )
    )


def vote_metrics(
    votes: DataFrame, labels: DataFrame, columns: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """One row per vote column (and ``by`` key): counts and rates.

    The join runs once; vote columns become rows after it, and the counts combine map-side.
    """
    joined = with_labels(votes, labels).select(
        *by,
        "matches_original",
        F.explode(
            F.array(
                *[F.struct(F.lit(c).alias("column"), F.col(c).alias("vote")) for c in columns]
            )
        ).alias("v"),
    )
    return rates(
        joined.select(*by, "matches_original", "v.column", "v.vote")
        .groupBy(*by, "column")
        .agg(*confusion_counts(~F.col("vote"), ~F.col("matches_original")))
    )


def negative_class_rates(tn: Column, fn: Column, fp: Column) -> dict[str, Column]:
    return {"precision": ratio(tn, tn + fn), "recall": ratio(tn, tn + fp)}


def f1_at(
    scores: DataFrame, labels: DataFrame, threshold: float = 0.5, by: Sequence[str] = ("curve",)
) -> DataFrame:
    """Negative-class precision, recall and F1 when ``score >= threshold`` means correct."""
    truth = F.coalesce(F.col("matches_original"), F.lit(False))
    accepted = F.coalesce(~F.isnan("score") & (F.col("score") >= threshold), F.lit(False))
    counts = (
        with_labels(scores, labels)
        .groupBy(*by)
        .agg(
            F.count_if(~truth & ~accepted).alias("tn"),
            F.count_if(~truth & accepted).alias("fp"),
            F.count_if(truth & ~accepted).alias("fn"),
        )
    )
    tn, fp, fn = F.col("tn"), F.col("fp"), F.col("fn")
    return (
        counts.withColumn("precision", ratio_or_zero(tn, tn + fn))
        .withColumn("recall", ratio_or_zero(tn, tn + fp))
        .withColumn(
            "f1_score", F.coalesce(harmonic(F.col("precision"), F.col("recall")), F.lit(0.0))
        )
    )


def match_rate(rows: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Matches, rows and percentage per dataset and, with a NULL dataset, overall."""
    return (
        rows.rollup(dataset)
        .agg(
            F.count_if(F.col("matches_original")).alias("matches"),
            F.count(F.lit(1)).alias("total_rows"),
        )
        .withColumn("percentage", ratio(F.col("matches"), F.col("total_rows")) * 100)
    )


def mean_by(rows: DataFrame, value: Column, by: Sequence[str], name: str = "mean") -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(value.cast("double")).alias(name), F.count(F.lit(1)).alias("n"))


def best_and_mean_run(
    runs: DataFrame, score: str = "score", run: str = "run", by: Sequence[str] = ()
) -> DataFrame:
    """Best run (lowest number among equals) and mean score of repeated model selection."""
    return runs.groupBy(*by).agg(
        F.min_by(run, F.struct((-F.col(score)).alias("s"), F.col(run))).alias("best_run"),
        F.max(score).alias("best_score"),
        F.avg(score).alias("mean_score"),
    )


def invert_losses(losses: DataFrame, by: str = "method", value: str = "loss") -> DataFrame:
    """Turn losses into scores: ``max - loss``; a missing loss becomes ``max - mean``."""
    known = F.nanvl(F.col(value), F.lit(None).cast("double"))
    statistics = losses.groupBy(by).agg(F.max(known).alias("top"), F.avg(known).alias("mean"))
    return (
        attach_statistics(losses, statistics, [by])
        .withColumn("score", F.col("top") - F.coalesce(known, F.col("mean")))
        .drop("top", "mean")
    )
