"""Feature matrix of learned aggregators: one row per item, one number per verdict."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.numbers import verdict_number
from tallyframe.functions.parsing import (
    FAMILIES,
    feature_answer,
    feature_label,
    judge,
    word_precision_recall,
)
from tallyframe.sources.registry import Prompt, family_of


def _uses_word_scores(family: str, method: str) -> bool:
    return method == "precision_recall" and FAMILIES[family].word_scores


def feature_names(prompts: Sequence[Prompt], models: Sequence[str], method: str) -> list[str]:
    """Feature columns in prompt, then model order."""
    names = []
    for prompt in prompts:
        for model in models:
            base = f"{model}_{prompt.name}"
            if _uses_word_scores(prompt.family, method):
                names += [f"{base}_precision", f"{base}_recall"]
            else:
                names.append(base)
    return names


def feature_rows(
    outputs: DataFrame, prompts: Sequence[Prompt], labels: DataFrame, method: str = "bool"
) -> DataFrame:
    """``(id, feature, value)``: a verdict, or word precision and recall of an answer.

    Texts are parsed before the join with the labels, so only short answers are shuffled.
    """
    listed = outputs.where(F.col("prompt").isin(*[p.name for p in prompts]))
    answers = listed.withColumn("family", family_of(prompts, F.col("prompt"))).select(
        "id", "family",
        F.concat_ws("_", "model", "prompt").alias("base"),
        feature_answer(F.col("family"), F.col("output")).alias("answer"),
    )
    joined = answers.join(
        labels.select("id", feature_label(F.col("label")).alias("label")), "id"
    )
    verdict = judge(F.col("family"), F.col("answer"), F.col("label")).cast("double")
    single = F.array(F.struct(F.col("base").alias("feature"), verdict.alias("value")))

    def pair(scores: Column) -> Column:
        return F.array(
            *[
                F.struct(
                    F.concat("base", F.lit(f"_{part}")).alias("feature"),
                    scores[part].alias("value"),
                )
                for part in ("precision", "recall")
            ]
        )

    scored = [name for name in FAMILIES if _uses_word_scores(name, method)]
    features = single
    if scored:
        features = F.when(
            F.col("family").isin(*scored),
            pair(word_precision_recall(F.col("answer"), F.col("label"))),
        ).otherwise(single)
    return joined.select("id", F.inline(features)).select(
        "id", "feature", verdict_number(F.col("value")).alias("value")
    )


def feature_matrix(
    rows: DataFrame, names: Sequence[str], labels: DataFrame | None = None
) -> DataFrame:
    """One column per feature, in one shuffle; a verdict without a row is one half.

    ``labels(id, matches_original)`` keeps the labelled items and adds ``y`` (missing: 0.5).
    """
    of = lambda n: F.max(F.when(F.col("feature") == n, F.col("value")))
    matrix = rows.groupBy("id").agg(*[F.coalesce(of(n), F.lit(0.5)).alias(n) for n in names])
    if labels is None:
        return matrix
    return matrix.join(
        labels.select("id", verdict_number(F.col("matches_original")).alias("y")), "id"
    )
