"""Ensemble search over every non-empty subset of models and of prompts.

An item's verdicts shrink to two integers per (prompt, model) cell in the single shuffle by
id. Subsets are then bit masks exploded inside the task, where all votes are sums over mask
bits, and only per-subset counts leave it. Nothing is joined or shuffled per subset. Curve areas
need ranks: items are range-partitioned by id once, and every piece of them is walked for all
subsets in the task that holds it.
"""

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.constants import VOTE_SWEEP
from tallyframe.functions.numbers import ratio
from tallyframe.operators.curves import best_threshold, sweep_buckets, threshold_index
from tallyframe.operators.metrics import confusion_counts, rates
from tallyframe.session import materialise

MASKS = ("model_mask", "prompt_mask")
BUCKET_BITS = 10


def _add(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _in_mask(mask: str, position: int) -> Column:
    return F.col(mask).bitwiseAND(F.lit(1 << position)) != 0


def subset_name(mask: str, members: Sequence[str]) -> Column:
    """Comma-joined members of a mask, in the given (sorted) order."""
    return F.array_join(
        F.array(*[F.when(_in_mask(mask, i), F.lit(m)) for i, m in enumerate(members)]), ","
    )


def item_cells(verdicts: DataFrame, models: Sequence[str], prompts: Sequence[str]) -> DataFrame:
    """One row per id: twice the vote sum and the vote count of each (prompt, model) cell."""
    twice = F.when(F.col("vote").isNull(), 1).when(F.col("vote"), 2).otherwise(0)
    aggregates = []
    for p, prompt in enumerate(prompts):
        for m, model in enumerate(models):
            here = (F.col("prompt") == prompt) & (F.col("model") == model)
            aggregates.append(
                F.coalesce(F.sum(F.when(here, twice)), F.lit(0)).alias(f"s_{p}_{m}")
            )
            aggregates.append(F.count_if(here).alias(f"n_{p}_{m}"))
    return verdicts.groupBy("id").agg(*aggregates)


def subset_votes(
    verdicts: DataFrame, labels: DataFrame, models: Sequence[str], prompts: Sequence[str]
) -> DataFrame:
    """Merged votes of every (model subset, prompt subset) for every labelled item."""
    models, prompts = sorted(models), sorted(prompts)
    cells = item_cells(verdicts, models, prompts).join(
        labels.select("id", "matches_original"), "id"
    )
    per_models = cells.withColumn(
        "model_mask", F.explode(F.sequence(F.lit(1), F.lit(2 ** len(models) - 1)))
    )

    def masked(kind: str, p: int) -> Column:
        return _add(
            [
                F.when(_in_mask("model_mask", m), F.col(f"{kind}_{p}_{m}")).otherwise(0)
                for m in range(len(models))
            ]
        )

    sums = per_models.select(
        "id", "matches_original", "model_mask",
        *[masked("s", p).alias(f"s_{p}") for p in range(len(prompts))],
        *[masked("n", p).alias(f"n_{p}") for p in range(len(prompts))],
    )
    votes = []
    for p in range(len(prompts)):
        s, n = F.col(f"s_{p}"), F.col(f"n_{p}")
        votes += [
            (n > 0).cast("int").alias(f"seen_{p}"),
            F.when(n > 0, ratio(s, n * 2)).alias(f"share_{p}"),
            F.when(n > 0, (s > n).cast("int")).alias(f"maj_{p}"),
            F.when((n > 0) & (s == n * 2), 1).otherwise(0).alias(f"all_{p}"),
            F.when((n > 0) & (s == 0), 1).otherwise(0).alias(f"none_{p}"),
        ]
    per_prompts = sums.select("id", "matches_original", "model_mask", *votes).withColumn(
        "prompt_mask", F.explode(F.sequence(F.lit(1), F.lit(2 ** len(prompts) - 1)))
    )

    def chosen(kind: str) -> Column:
        return _add(
            [
                F.when(
                    _in_mask("prompt_mask", p), F.coalesce(F.col(f"{kind}_{p}"), F.lit(0))
                ).otherwise(0)
                for p in range(len(prompts))
            ]
        )

    combined = per_prompts.select(
        "id", "matches_original", *MASKS,
        chosen("seen").alias("seen"), chosen("share").alias("share"), chosen("maj").alias("maj"),
        chosen("all").alias("all_true"), chosen("none").alias("all_false"),
    ).where("seen > 0")
    return combined.select(
        "id", "matches_original", *MASKS,
        (F.col("maj") * 2 > F.col("seen")).alias("majority_vote"),
        F.when(F.col("all_true") == F.col("seen"), True)
        .when(F.col("all_false") == F.col("seen"), False)
        .alias("unanimous_vote"),
        ratio(F.col("share"), F.col("seen")).alias("percentage_vote"),
    )


def subset_profile(votes: DataFrame) -> DataFrame:
    """Counts per subset, vote values, threshold bucket and truth.

    All subset metrics but the curve area follow from this table; its size depends on the
    number of subsets, not of items.
    """
    steps, step = VOTE_SWEEP
    bucket = F.when(
        F.col("percentage_vote").isNotNull(),
        threshold_index(F.col("percentage_vote"), steps, step),
    ).otherwise(steps)
    return votes.groupBy(
        *MASKS, "majority_vote", "unanimous_vote", bucket.alias("bucket"), "matches_original"
    ).agg(F.count(F.lit(1)).alias("n"))


def subset_vote_metrics(profile: DataFrame) -> DataFrame:
    """Rates of the majority and the unanimous vote per subset."""
    rows = profile.select(
        *MASKS, "matches_original", "n",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column"), F.col(c).alias("vote"))
                    for c in ("majority_vote", "unanimous_vote")
                ]
            )
        ).alias("v"),
    )
    return rates(
        rows.groupBy(*MASKS, F.col("v.column").alias("column")).agg(
            *confusion_counts(~F.col("v.vote"), ~F.col("matches_original"), F.col("n"))
        )
    )


def subset_sweep(profile: DataFrame) -> DataFrame:
    """Threshold sweep of the percentage vote per subset."""
    return sweep_buckets(profile, MASKS)


def subset_best_thresholds(profile: DataFrame) -> DataFrame:
    return best_threshold(subset_sweep(profile), MASKS)


def _subset_scores(
    items: pd.DataFrame, n_models: int, n_prompts: int
) -> Iterator[tuple[int, int, np.ndarray]]:
    """Percentage vote of every subset for all items of a frame, NaN where nobody voted.

    Twelve digits are kept, so that shares that only differ by rounding are ties.
    """
    sums = np.array([[items[f"s_{p}_{m}"] for m in range(n_models)] for p in range(n_prompts)])
    sizes = np.array([[items[f"n_{p}_{m}"] for m in range(n_models)] for p in range(n_prompts)])
    for model_mask in range(1, 2**n_models):
        members = [m for m in range(n_models) if model_mask >> m & 1]
        s, n = sums[:, members].sum(axis=1), sizes[:, members].sum(axis=1)
        share = np.where(n > 0, s / np.maximum(2 * n, 1), 0.0)
        for prompt_mask in range(1, 2**n_prompts):
            chosen = [p for p in range(n_prompts) if prompt_mask >> p & 1]
            seen = (n[chosen] > 0).sum(axis=0)
            score = reduce(np.add, [share[p] for p in chosen]) / np.maximum(seen, 1)
            yield model_mask, prompt_mask, np.where(seen > 0, np.round(score, 12), np.nan)


def _before_scores(counts: DataFrame) -> DataFrame:
    """Rows and wrong ones of lower scores per subset and score, and the wrong ones of the subset.

    Scores lie between 0 and 1 and are grouped into buckets. What lies before a score in its bucket
    comes from a window over that bucket; what lies before the bucket is the sum of one block of
    2^level buckets for each bit of the bucket's number. So no task holds a whole subset.
    """
    numbers = [F.sum("n").alias("n"), F.sum("n_wrong").alias("n_wrong")]
    scores = counts.groupBy(*MASKS, "score").agg(*numbers).withColumn(
        "bucket", F.floor(F.col("score") * 2**BUCKET_BITS).cast("int")
    )
    buckets = scores.groupBy(*MASKS, "bucket").agg(*numbers)
    levels = F.explode(F.sequence(F.lit(0), F.lit(BUCKET_BITS)))
    block = F.expr("shiftright(bucket, level)")
    leveled = buckets.withColumn("level", levels).withColumn("block", block)
    blocks = leveled.groupBy(*MASKS, "level", "block").agg(*numbers)
    before = (
        leveled.where(F.col("block") % 2 == 1)
        .select(*MASKS, "bucket", "level", (F.col("block") - 1).alias("block"))
        .join(blocks, [*MASKS, "level", "block"])
        .groupBy(*MASKS, "bucket")
        .agg(F.sum("n").alias("earlier"), F.sum("n_wrong").alias("wrong_earlier"))
    )
    lower = (
        Window.partitionBy(*MASKS, "bucket").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    )
    none = F.lit(0)
    totals = buckets.groupBy(*MASKS).agg(F.sum("n_wrong").alias("total"))
    return (
        scores.withColumns(
            {"in_n": F.coalesce(F.sum("n").over(lower), none),
             "in_wrong": F.coalesce(F.sum("n_wrong").over(lower), none)}
        )
        .join(before, [*MASKS, "bucket"], "left")
        .join(totals, list(MASKS))
        .select(
            *MASKS, "score", "total",
            (F.col("in_n") + F.coalesce("earlier", none)).alias("before"),
            (F.col("in_wrong") + F.coalesce("wrong_earlier", none)).alias("wrong_before"),
        )
    )


def subset_auc_pr(
    verdicts: DataFrame, labels: DataFrame, models: Sequence[str], prompts: Sequence[str]
) -> DataFrame:
    """Area under the PR curve of the percentage vote per subset.

    Items move once, to pieces in id order. A piece gives its numbers of items and of wrong ones per
    subset and score (a few values each). What lies before a piece's items of a score is the running
    sum over earlier pieces of that score, plus that over lower scores; their order within the piece
    gives the rest. No window holds all pieces and scores of a subset.
    """
    n_models, n_prompts = len(models), len(prompts)
    cells = item_cells(verdicts, sorted(models), sorted(prompts)).join(
        labels.select("id", "matches_original"), "id"
    )
    pieces = materialise(
        cells.withColumn("wrong", ~F.coalesce(F.col("matches_original"), F.lit(False)))
        .drop("matches_original")
        .repartitionByRange("id")
        .sortWithinPartitions("id")
        .withColumn("piece", F.spark_partition_id())
        .drop("id")
    )

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            wrong = frame["wrong"].to_numpy(bool)
            for model_mask, prompt_mask, score in _subset_scores(frame, n_models, n_prompts):
                voted = ~np.isnan(score)
                values, place = np.unique(score[voted], return_inverse=True)
                yield pd.DataFrame(
                    {
                        "model_mask": model_mask, "prompt_mask": prompt_mask, "score": values,
                        "piece": frame["piece"].iloc[0] if len(frame) else 0,
                        "n": np.bincount(place, minlength=len(values)),
                        "n_wrong": np.bincount(place, wrong[voted], len(values)).astype(np.int64),
                    }
                )

    counts = (
        pieces.mapInPandas(
            count,
            "model_mask int, prompt_mask int, score double, piece int, n bigint, n_wrong bigint",
        )
        # dealt by score, so a score's pieces meet without another shuffle
        .repartition(*MASKS, "score")
        .groupBy(*MASKS, "score", "piece")
        .agg(F.sum("n").alias("n"), F.sum("n_wrong").alias("n_wrong"))
    )
    counts = materialise(counts)
    earlier = (
        Window.partitionBy(*MASKS, "score").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    )
    in_score = counts.select(
        *MASKS, "score", "piece",
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("n", "n_wrong")],
    )
    offsets = in_score.join(_before_scores(counts), [*MASKS, "score"]).select(
        *MASKS, "score", "piece", "total",
        (F.col("n") + F.col("before")).alias("before"),
        (F.col("n_wrong") + F.col("wrong_before")).alias("wrong_before"),
    )

    def walk(items: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        wrong = items["wrong"].to_numpy(np.int64)
        by_subset = dict(list(known.sort_values("score").groupby(list(MASKS))))
        areas = []
        for model_mask, prompt_mask, score in _subset_scores(items, n_models, n_prompts):
            if (model_mask, prompt_mask) not in by_subset:
                continue
            shifts = by_subset[model_mask, prompt_mask]
            total = shifts["total"].iloc[0]
            order = np.argsort(score, kind="stable")[: np.count_nonzero(~np.isnan(score))]
            scores, flags = score[order], wrong[order]
            values, first = np.unique(scores, return_index=True)
            group = np.searchsorted(values, scores)
            so_far = np.cumsum(flags)
            rank = shifts["before"].to_numpy()[group] + np.arange(len(scores)) - first[group] + 1
            tp = shifts["wrong_before"].to_numpy()[group] + so_far - (so_far - flags)[first][group]
            here = (flags == 1) & (rank > 1)
            rank, tp = rank[here], tp[here]
            areas.append(
                (model_mask, prompt_mask, float((tp / rank + (tp - 1) / (rank - 1)).sum() / (2 * max(total, 1))))
            )
        return pd.DataFrame(areas, columns=[*MASKS, "area"])

    parts = pieces.groupBy("piece").cogroup(offsets.groupBy("piece")).applyInPandas(
        walk, "model_mask int, prompt_mask int, area double"
    )
    return parts.groupBy(*MASKS).agg(F.sum("area").alias("auc_pr"))


def named(df: DataFrame, models: Sequence[str], prompts: Sequence[str]) -> DataFrame:
    """Add readable subset names."""
    return df.withColumns(
        {
            "ensemble": subset_name("model_mask", sorted(models)),
            "prompt_group": subset_name("prompt_mask", sorted(prompts)),
        }
    )


def best_subsets(
    metrics: DataFrame, metric_names: Sequence[str] = ("f1_score", "accuracy", "precision", "recall")
) -> DataFrame:
    """Best subset per voting method and metric; equals go to the lowest masks."""
    measured = metrics.select(
        "column", *MASKS,
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metric_names])
        ).alias("m"),
    )
    order = F.struct((-F.col("m.value")).alias("v"), *MASKS)
    return (
        measured.groupBy("column", F.col("m.metric").alias("metric"))
        .agg(F.min(order).alias("best"))
        .select(
            "column", "metric", "best.model_mask", "best.prompt_mask",
            (-F.col("best.v")).alias("value"),
        )
    )


def by_subset_size(
    df: DataFrame, models: int | None = None, prompts: int | None = None,
    ensemble: str = "ensemble", prompt_group: str = "prompt_group",
) -> DataFrame:
    """Keep subsets with the given numbers of models and of prompts."""
    size = lambda c: F.size(F.split(c, ","))
    if models is not None:
        df = df.where(size(F.col(ensemble)) == models)
    if prompts is not None:
        df = df.where(size(F.col(prompt_group)) == prompts)
    return df


def scaling_curves(
    areas: DataFrame, n_models: int, n_prompts: int, area: str = "auc_pr",
    ensemble: str = "ensemble", prompt_group: str = "prompt_group",
) -> DataFrame:
    """Area by number of models (all prompts) and by number of prompts (all models)."""
    sized = areas.withColumns(
        {
            "n_models": F.size(F.split(F.col(ensemble), ",")),
            "n_prompts": F.size(F.split(F.col(prompt_group), ",")),
        }
    )
    roles = F.array(
        F.when(
            F.col("n_prompts") == n_prompts,
            F.struct(F.lit("models").alias("varied"), F.col("n_models").alias("k")),
        ),
        F.when(
            F.col("n_models") == n_models,
            F.struct(F.lit("prompts").alias("varied"), F.col("n_prompts").alias("k")),
        ),
    )
    return (
        sized.withColumn("r", F.explode(F.filter(roles, lambda r: r.isNotNull())))
        .groupBy(F.col("r.varied").alias("varied"), F.col("r.k").alias("k"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(area).alias("mean_auc_pr"),
            F.min(area).alias("min_auc_pr"),
            F.max(area).alias("max_auc_pr"),
        )
    )
