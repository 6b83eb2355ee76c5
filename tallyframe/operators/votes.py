"""Votes across models per (item, prompt), and their merge across prompts.

A verdict is TRUE, FALSE or NULL; NULL weighs one half. All rules follow from three counts
per group, which Spark adds up map-side, so a hot item shuffles one row per task.
"""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.numbers import ratio
from tallyframe.functions.parsing import judge, parse_output
from tallyframe.sources.registry import Prompt, family_of


def parse_outputs(
    outputs: DataFrame, prompts: Sequence[Prompt], extra: Sequence[str] = ()
) -> DataFrame:
    """``(id, prompt, model, family, answer)`` of the listed prompts, and the extra columns."""
    listed = outputs.where(F.col("prompt").isin(*[p.name for p in prompts]))
    return listed.withColumn("family", family_of(prompts, F.col("prompt"))).select(
        "id", "prompt", "model", "family",
        parse_output(F.col("family"), F.col("output")).alias("answer"),
        *extra,
    )


def verdicts(
    outputs: DataFrame, prompts: Sequence[Prompt], labels: DataFrame, extra: Sequence[str] = ()
) -> DataFrame:
    """``(id, prompt, model, vote)``: parse first, so the join moves answers, not texts."""
    answers = parse_outputs(outputs, prompts, extra)
    return answers.join(labels.select("id", "label"), "id").select(
        "id", "prompt", "model",
        judge(F.col("family"), F.col("answer"), F.col("label")).alias("vote"),
        *extra,
    )


def _counts(vote: Column) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"),
        F.count_if(vote).alias("n_true"),
        F.count_if(~vote).alias("n_false"),
    ]


def _reduce(strict: bool) -> list[Column]:
    n, yes, no = F.col("n"), F.col("n_true"), F.col("n_false")
    missing = n - yes - no
    usable = (missing == 0) if strict else F.lit(True)
    return [
        F.when(usable & (n > 0), yes > no).alias("majority_vote"),
        F.when(usable, F.when(yes == n, True).when(no == n, False)).alias("unanimous_vote"),
        F.when(usable, ratio(yes + F.lit(0.5) * missing, n)).alias("percentage_vote"),
    ]


def prompt_votes(
    verdict_rows: DataFrame,
    strict: bool = False,
    keys: Sequence[str] = ("id", "prompt"),
    expected: DataFrame | None = None,
) -> DataFrame:
    """Majority, unanimous and percentage vote per key.

    ``strict`` makes all three NULL as soon as one verdict is missing. ``expected`` lists
    keys that must appear; one without any voter gets NULL, TRUE (vacuous) and NULL.
    """
    counts = verdict_rows.groupBy(*keys).agg(*_counts(F.col("vote")))
    if expected is not None:
        counts = (
            expected.select(*keys)
            .join(counts, list(keys), "left")
            .na.fill(0, ["n", "n_true", "n_false"])
        )
    return counts.select(*keys, *_reduce(strict))


def custom_votes(
    verdict_rows: DataFrame,
    reducer: Callable[[Column], Column],
    name: str,
    keys: Sequence[str] = ("id", "prompt"),
) -> DataFrame:
    """A vote of one's own per key: any aggregate of the verdict column.

    ``reducer`` may be a built-in aggregate or a grouped-aggregate pandas UDF; the former
    combines map-side.
    """
    return verdict_rows.groupBy(*keys).agg(reducer(F.col("vote")).alias(name))


def _majority(vote: str) -> Column:
    seen = F.count(F.col(vote))
    return F.when(seen > 0, F.count_if(F.col(vote)) * 2 > seen)


def _all_seen(vote: str) -> Column:
    seen = F.count(F.col(vote))
    return F.when(seen > 0, F.count_if(F.col(vote)) == seen)


def merge_prompts(votes: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Merge prompt votes per item; missing ones are skipped except for unanimity."""
    rows = F.count(F.lit(1))
    unanimous = F.col("unanimous_vote")
    return votes.groupBy(*keys).agg(
        _majority("majority_vote").alias("majority_vote"),
        F.when(F.count_if(unanimous) == rows, True)
        .when(F.count_if(~unanimous) == rows, False)
        .alias("unanimous_vote"),
        F.avg("percentage_vote").alias("percentage_vote"),
        _majority("unanimous_vote").alias("model_unanimous_prompt_majority_vote"),
        _all_seen("majority_vote").alias("model_majority_prompt_unanimous_vote"),
    )


def merge_prompts_grouped(
    votes: DataFrame,
    strict: bool = False,
    compat: bool = False,
    keys: Sequence[str] = ("id",),
) -> DataFrame:
    """Merge for a named prompt and model group.

    ``strict``: a missing prompt vote makes that column NULL. ``compat`` leaves prompts
    whose percentage is zero or missing out of the unanimity test, so that an item every
    prompt rejects comes out TRUE; kept for comparison with results made that way.
    """
    rows = F.count(F.lit(1))
    unanimous, share = F.col("unanimous_vote"), F.col("percentage_vote")
    counted = (F.coalesce(share, F.lit(0.0)) != 0) if compat else F.lit(True)
    tested = F.count_if(counted)
    unanimity = F.when(F.count_if(counted & unanimous) == tested, True).when(
        F.count_if(counted & ~unanimous) == tested, False
    )

    def whole(column: str, value: Column) -> Column:
        return F.when(F.count(F.col(column)) == rows, value) if strict else value

    return votes.groupBy(*keys).agg(
        whole("majority_vote", _majority("majority_vote")).alias("majority_vote"),
        whole("unanimous_vote", unanimity).alias("unanimous_vote"),
        whole("percentage_vote", F.avg("percentage_vote")).alias("percentage_vote"),
        whole("majority_vote", _all_seen("majority_vote")).alias(
            "model_majority_prompt_unanimous_vote"
        ),
    )


def missing_counts(verdict_rows: DataFrame) -> DataFrame:
    """Missing verdicts and cells per model, per prompt and in total, in one pass."""
    missing = F.count_if(F.col("vote").isNull()).alias("missing")
    cells = F.count(F.lit(1)).alias("cells")
    m, p = F.col("model"), F.col("prompt")
    return (
        verdict_rows.groupingSets([[m], [p], []], m, p)
        .agg(missing, cells)
        .select("model", "prompt", "missing", "cells")
    )


def wide_to_verdicts(df: DataFrame, models: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Turn one column per model into rows."""
    return df.unpivot(list(keys), list(models), "model", "vote")


def verdicts_to_wide(verdict_rows: DataFrame, models: Sequence[str]) -> DataFrame:
    """One boolean column per model, for files in that layout, in one shuffle."""
    columns = [F.max(F.when(F.col("model") == m, F.col("vote"))).alias(m) for m in models]
    return verdict_rows.groupBy("id", "prompt").agg(*columns)
