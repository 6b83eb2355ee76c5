"""Samples, splits, baselines and fine-tuning rows."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.prompts import MessageTemplate, training_chat
from tallyframe.operators.relational import confident, exclude, restrict_to


def most_uncertain(
    scores: DataFrame, labelled: DataFrame, n: int, key: str = "id", score: str = "score"
) -> DataFrame:
    """The n not yet labelled items closest to one half; equals go by id.

    ``orderBy`` + ``limit`` keeps n rows per task before merging, never a full sort.
    """
    distance = F.abs(F.col(score) - 0.5)
    return (
        exclude(scores.where(F.col(score).isNotNull()), labelled, key)
        .select(key, score, distance.alias("distance"))
        .orderBy("distance", key)
        .limit(n)
        .select(
            key,
            F.round(score, 4).alias("score"),
            F.round("distance", 4).alias("distance_from_0.5"),
        )
    )


def hash_bucket(key: Column, buckets: int, seed: int = 42) -> Column:
    """Stable bucket of an id: the same on every run, order, partitioning and SQL engine."""
    digits = F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(buckets))


def hash_split(df: DataFrame, validation_percent: int, key: str = "id", seed: int = 42) -> DataFrame:
    """Add ``part``: ``validation`` for about the given share of ids, else ``train``."""
    held_out = hash_bucket(F.col(key), 100, seed) < validation_percent
    return df.withColumn("part", F.when(held_out, "validation").otherwise("train"))


def random_baseline(df: DataFrame, key: str = "id", seed: int = 42) -> DataFrame:
    """A 0/1 score per item by hash parity, repeatable where ``rand`` is not."""
    return df.withColumn("baseline_random", hash_bucket(F.col(key), 2, seed).cast("int"))


def first_correct_model(verdicts: DataFrame, preference: Sequence[str]) -> DataFrame:
    """Per item the first model of the preference list whose verdict is TRUE."""
    order = F.lit(list(preference))
    rank = F.array_position(order, F.col("model"))
    first = verdicts.where(F.col("vote") & (rank > 0)).groupBy("id").agg(F.min(rank).alias("r"))
    return first.select("id", F.element_at(order, F.col("r").cast("int")).alias("model"))


def finetune_rows(
    items: DataFrame,
    template: MessageTemplate,
    scores: DataFrame | None = None,
    score: str = "score",
    threshold: float | None = None,
    reasoning: tuple[DataFrame, DataFrame, Sequence[str]] | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """``(id, input, output)`` rows.

    ``scores`` with a ``threshold`` keeps confident items only. ``reasoning`` is
    ``(verdicts, outputs, preference)`` of one prompt: the output is then the raw text of
    the first correct model and items without one are left out; otherwise it is the label.
    ``buckets`` says that items and outputs are stored in so many buckets by id: the chosen ids are
    then dealt out alike, so that they move to the texts.
    """
    kept = None if scores is None else confident(scores, score, threshold)
    source = template.column().alias("input")
    if reasoning is None:
        rows = items if kept is None else restrict_to(items, kept)
        return rows.select("id", source, F.col("label").alias("output"))
    verdicts, outputs, preference = reasoning
    # by the packed size of stored tables Spark takes many rows for few, and would broadcast them
    stored = lambda rows: rows if buckets is None else rows.hint("merge")
    if kept is not None:  # before the texts are met, only the ids of confident items are left
        verdicts = restrict_to(verdicts.where("vote"), stored(kept))
    chosen = first_correct_model(verdicts, preference)
    if buckets is not None:
        chosen = chosen.repartition(buckets, "id")
    outputs = stored(outputs)
    return texts_of(items, outputs, chosen).select("id", source, "output")


def texts_of(items: DataFrame, outputs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Items with the ``output`` of their chosen model.

    Items and outputs meet on the id alone, the model being a further condition: tables bucketed by
    id are then joined where they lie, and only ``chosen`` (id, model) is shuffled.
    """
    chosen = chosen.withColumnRenamed("model", "chosen_model")
    texts = outputs.select(F.col("id").alias("text_id"), "model", "output")
    # two comparisons, as an equality would become a key and deal the texts out again
    same = (F.col("model") <= F.col("chosen_model")) & (F.col("model") >= F.col("chosen_model"))
    return items.join(chosen, "id").join(texts, F.expr("id = text_id")).where(same)


def finetune_chats(rows: DataFrame) -> DataFrame:
    return rows.select("id", training_chat(F.col("input"), F.col("output")).alias("messages"))
