"""Precision-recall curves and threshold sweeps.

A curve ranks all its rows by ``(score, id)``; the positive class is "label is wrong", so
low scores come first. One curve may hold most of the rows, therefore nothing here puts a
curve into one task: rows are range-partitioned into sorted pieces, the pieces are counted,
and every row finds its rank as (rows in earlier pieces) + (position in its piece).
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallyframe.constants import RANKING_SWEEP, VOTE_SWEEP
from tallyframe.functions.numbers import harmonic, ratio, ratio_or_zero
from tallyframe.operators.metrics import confusion_counts, rates, with_labels
from tallyframe.session import materialise


def _usable(score: Column) -> Column:
    return score.isNotNull() & ~F.isnan(score)


def curve_rows(
    scores: DataFrame, labels: DataFrame, by: Sequence[str] = ("curve",), score: str = "score"
) -> DataFrame:
    """Labelled rows with a score; ``wrong`` is true unless the truth is TRUE."""
    return with_labels(scores.where(_usable(F.col(score))), labels).select(
        *by, "id", F.col(score).alias("score"),
        (~F.coalesce(F.col("matches_original"), F.lit(False))).alias("wrong"),
    )


def _pieces(rows: DataFrame, by: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows in global ``(curve, score, id)`` order, with their piece and row number in it.

    The range bounds come from sampling, so the pieces are written out before they are used
    twice, with no more columns than needed.
    """
    ordered = rows.repartitionByRange(*by, "score", "id").sortWithinPartitions(*by, "score", "id")
    return materialise(
        ordered.select(
            *by, *keep, "wrong",
            F.spark_partition_id().alias("piece"),
            F.monotonically_increasing_id().alias("at"),
        )
    )


def _offsets(pieces: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per (curve, piece): what lies before it in the curve and in the piece, and the total.

    There are at most (pieces + curves) rows here, however long a curve is.
    """
    counts = pieces.groupBy(*by, "piece").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("wrong").alias("n_wrong")
    )
    whole = Window.partitionBy(*by)
    in_curve = whole.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    in_piece = Window.partitionBy("piece").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    return counts.select(
        *by, "piece",
        (before("n", in_curve) - before("n", in_piece)).alias("rank_shift"),
        (before("n_wrong", in_curve) - before("n_wrong", in_piece)).alias("wrong_shift"),
        F.sum("n_wrong").over(whole).alias("total_wrong"),
    )


def _place(number: str) -> Column:
    """One-based position in the piece: the low 33 bits of the generated row number."""
    return F.col(number).bitwiseAND(F.lit((1 << 33) - 1)) + 1


def pr_curve(rows: DataFrame, by: Sequence[str] = ("curve",)) -> DataFrame:
    """Running precision and recall of every row of ``curve_rows``, with its rank.

    The stored pieces are sorted, so a task counts the wrong rows as it passes them; the numbers
    before a piece are added by a join with one small row for each (curve, piece).
    """
    pieces = _pieces(rows, by, ["id", "score"])
    schema = StructType([*pieces.schema, StructField("wrong_here", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed = 0
        for batch in batches:
            wrong = batch["wrong"].to_numpy(zero_copy_only=False).astype(np.int64)
            yield batch.append_column("wrong_here", pa.array(passed + np.cumsum(wrong)))
            passed += int(wrong.sum())

    counted = pieces.mapInArrow(run, schema).join(
        materialise(_offsets(pieces, by)), [*by, "piece"]
    )
    rank = F.col("rank_shift") + _place("at")
    tp = F.col("wrong_shift") + F.col("wrong_here")
    return counted.select(
        *by, "id", "score", "wrong",
        rank.alias("rank"),
        ratio(tp, rank).alias("precision"),
        ratio_or_zero(tp, F.col("total_wrong")).alias("recall"),
    )


def auc_pr(rows: DataFrame, by: Sequence[str] = ("curve",)) -> DataFrame:
    """Trapezoid area under the PR curve, without an added start point.

    Recall only grows at wrong rows, so only these contribute:
    ``(tp/rank + (tp-1)/(rank-1)) / (2 * total)``. Their count so far is their own position
    among the wrong rows of the sorted piece, hence no window and no second shuffle.
    """
    pieces = _pieces(rows, by)
    offsets = materialise(_offsets(pieces, by))
    wrong = pieces.where("wrong").withColumn("nth", F.monotonically_increasing_id())
    placed = wrong.join(offsets, [*by, "piece"]).select(
        *by, "total_wrong",
        (F.col("rank_shift") + _place("at")).alias("rank"),
        (F.col("wrong_shift") + _place("nth")).alias("tp"),
    )
    area = (
        ratio(F.col("tp"), F.col("rank")) + ratio(F.col("tp") - 1, F.col("rank") - 1)
    ) / (F.lit(2.0) * F.col("total_wrong"))
    areas = placed.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(F.col("rank") > 1, area)), F.lit(0.0)).alias("auc_pr")
    )
    return offsets.select(*by).distinct().join(areas, list(by), "left").na.fill(0.0, ["auc_pr"])


def threshold_index(score: Column, steps: int, step: float) -> Column:
    """Smallest i with ``score <= i * step``; ``steps`` when there is none.

    The quotient gives the neighbourhood; the comparison with the grid value itself decides,
    so the result is that of testing every threshold.
    """
    near = F.ceil(F.least(F.greatest(score / F.lit(step), F.lit(0.0)), F.lit(float(steps))))
    at = lambda i: i.cast("double") * F.lit(step)
    exact = (
        F.when(score <= at(near - 1), near - 1).when(score <= at(near), near).otherwise(near + 1)
    )
    return F.least(F.greatest(exact, F.lit(0)), F.lit(steps)).cast("int")


def _bucketed(
    scores: DataFrame, labels: DataFrame, by: Sequence[str], steps: int, step: float,
    missing: int, score: str,
) -> DataFrame:
    """Row counts per curve, threshold bucket and truth: at most 3 * (steps + 1) per curve."""
    value = F.col(score)
    bucket = F.when(_usable(value), threshold_index(value, steps, step)).otherwise(missing)
    return (
        with_labels(scores, labels)
        .groupBy(*by, bucket.alias("bucket"), "matches_original")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _over_thresholds(buckets: DataFrame, steps: int) -> DataFrame:
    return buckets.withColumn("t_idx", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))


def threshold_sweep(
    scores: DataFrame, labels: DataFrame, by: Sequence[str] = ("curve",), score: str = "score"
) -> DataFrame:
    """Vote-score sweep: "wrong" if ``score <= t``; a missing score is never wrong."""
    steps, step = VOTE_SWEEP
    buckets = _bucketed(scores, labels, by, steps, step, steps, score)
    return sweep_buckets(buckets, by)


def sweep_buckets(buckets: DataFrame, by: Sequence[str]) -> DataFrame:
    steps, step = VOTE_SWEEP
    counts = (
        _over_thresholds(buckets, steps)
        .groupBy(*by, "t_idx")
        .agg(
            *confusion_counts(
                F.col("bucket") <= F.col("t_idx"), ~F.col("matches_original"), F.col("n")
            )
        )
    )
    return rates(counts).withColumn("threshold", F.col("t_idx").cast("double") * F.lit(step))


def f1_sweep(
    scores: DataFrame, labels: DataFrame, by: Sequence[str] = ("curve",), score: str = "score"
) -> DataFrame:
    """Ranking sweep: correct if ``score > t``; negative-class rates, NULL when undefined."""
    steps, step = RANKING_SWEEP
    truth = F.coalesce(F.col("matches_original"), F.lit(False))
    rejected = F.col("bucket") <= F.col("t_idx")
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    counts = (
        _over_thresholds(_bucketed(scores, labels, by, steps, step, 0, score), steps)
        .groupBy(*by, "t_idx")
        .agg(
            n(~truth & rejected).alias("tn"),
            n(truth & rejected).alias("fn"),
            n(~truth & ~rejected).alias("fp"),
        )
    )
    tn, fn, fp = F.col("tn"), F.col("fn"), F.col("fp")
    return (
        counts.withColumn("threshold", F.col("t_idx").cast("double") * F.lit(step))
        .withColumn("precision", ratio(tn, tn + fn))
        .withColumn("recall", ratio(tn, tn + fp))
        .withColumn("f1_score", harmonic(F.col("precision"), F.col("recall")))
    )


def f1_summary(sweep: DataFrame, by: Sequence[str] = ("curve",)) -> DataFrame:
    """Best F1, smallest threshold of full recall and largest threshold of full precision."""
    return sweep.groupBy(*by).agg(
        F.max("f1_score").alias("max_f1"),
        F.min(F.when(F.col("recall") == 1, F.col("threshold"))).alias("full_recall_from"),
        F.max(F.when(F.col("precision") == 1, F.col("threshold"))).alias("full_precision_to"),
    )


def best_threshold(sweep: DataFrame, by: Sequence[str] = ("curve",)) -> DataFrame:
    """The threshold of best F1 (the smallest among equals) with its rates."""
    kept = ["t_idx", "threshold", "accuracy", "precision", "recall", "f1_score"]
    best = F.max_by(F.struct(*kept), F.struct("f1_score", (-F.col("t_idx")).alias("i")))
    return sweep.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def at_half(sweep: DataFrame) -> DataFrame:
    """The rows at threshold one half, by grid index rather than by comparing doubles."""
    return sweep.where(F.col("t_idx") == (VOTE_SWEEP[0] - 1) // 2)
