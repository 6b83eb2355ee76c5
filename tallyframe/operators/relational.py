"""Filters, id joins, contract checks and name keys over item tables."""

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.parsing import is_valid_output
from tallyframe.functions.text import words
from tallyframe.session import materialise

Step = Callable[[DataFrame], DataFrame]


def keep_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def drop_empty_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Drop items with an empty label; a NULL label stays."""
    return df.where(~F.col(label).eqNullSafe(""))


def apply_filters(df: DataFrame, steps: Sequence[Step]) -> tuple[DataFrame, DataFrame]:
    """Apply filters in order; also ``(step, rows)``: what is left after each of them.

    The count table costs nothing unless it is read. (Observed metrics would give the counts
    along the way, but a session that has used them cannot run ML evaluators any more.)
    """
    counts = []
    for number, step in enumerate(steps, start=1):
        df = df.transform(step)
        counts.append(df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(number).alias("step"), "rows"))
    return df, union_all(counts)


@dataclass(frozen=True)
class InSet:
    """Filter step: the id is (or, if not ``wanted``, is not) in a set of ids."""

    ids: DataFrame
    key: str = "id"
    wanted: bool = True


def survival(df: DataFrame, steps: Sequence[Column | InSet], name: str = "survived") -> DataFrame:
    """All rows with the number of the last step they survive, in one pass; 0 for none.

    A step is a condition, which must hold, or a set of ids. Sets are joined as marks before, so a
    row is read once, whatever the number of steps; a NULL id is in no set.
    """
    conditions = []
    columns = df.columns
    for number, step in enumerate(steps):
        if isinstance(step, InSet):
            mark = f"__in_{number}"
            marks = step.ids.select(step.key).distinct().withColumn(mark, F.lit(True))
            df = df.join(marks, step.key, "left")
            step = F.col(mark).isNotNull() if step.wanted else F.col(mark).isNull()
        conditions.append(F.coalesce(step, F.lit(False)))
    last = F.lit(len(conditions))
    for number in reversed(range(len(conditions))):
        last = F.when(~conditions[number], number).otherwise(last)
    return df.select(*columns, last.cast("int").alias(name))


def survivors(marked: DataFrame, n_steps: int, name: str = "survived") -> DataFrame:
    """Rows that all steps keep."""
    return marked.where(F.col(name) == n_steps).drop(name)


def step_counts(marked: DataFrame, n_steps: int, name: str = "survived") -> DataFrame:
    """``(step, rows)``: what is left after each step, from one aggregation."""
    left = [F.count_if(F.col(name) >= k).alias(f"n_{k}") for k in range(1, n_steps + 1)]
    named = [F.struct(F.lit(k).alias("step"), F.col(f"n_{k}").alias("rows")) for k in range(1, n_steps + 1)]
    return marked.agg(*left).select(F.inline(F.array(*named)))


def restrict_to(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def exclude(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def split_by_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The whole table with ``moved``: is the id in the set? One join serves both sides."""
    marks = ids.select(key).distinct().withColumn("moved", F.lit(True))
    return df.join(marks, key, "left").withColumn(
        "moved", F.coalesce(F.col("moved"), F.lit(False))
    )


def invalid_rerun_set(
    items: DataFrame, outputs: DataFrame, family: Column, key: str = "id"
) -> tuple[DataFrame, DataFrame]:
    """Items whose stored output is invalid, and ids of invalid outputs without an item."""
    invalid = outputs.where(~is_valid_output(family, F.col("output"))).select(key)
    return restrict_to(items, invalid, key), exclude(invalid.distinct(), items, key)


def complete_rows(
    scores: DataFrame,
    curves: Sequence[str],
    key: str = "id",
    curve: str = "curve",
    score: str = "score",
) -> DataFrame:
    """Rows of the compared curves (one per id) whose id has a score in every one of them."""
    usable = scores.where(
        F.col(curve).isin(*curves) & F.col(score).isNotNull() & ~F.isnan(score)
    )
    whole = (
        usable.groupBy(key)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") == len(set(curves)))
    )
    return usable.join(whole, key, "left_semi")


def confident(df: DataFrame, score: str, threshold: float) -> DataFrame:
    """Rows above the threshold; NULL and NaN are not confident."""
    return df.where(~F.isnan(score) & (F.col(score) > threshold))


def within_words(text: str, max_words: int) -> Column:
    """Is a text within the word limit? A NULL text is."""
    return F.coalesce(F.size(words(F.col(text))), F.lit(0)) <= max_words


def over_long(df: DataFrame, text: str, max_words: int) -> tuple[DataFrame, DataFrame]:
    """Rows within the word limit, and ids with their length for the skipped ones.

    A NULL text has no words, so it is within any limit.
    """
    counted = df.withColumn("n_words", F.coalesce(F.size(words(F.col(text))), F.lit(0)))
    return (
        counted.where(F.col("n_words") <= max_words).drop("n_words"),
        counted.where(F.col("n_words") > max_words).select("id", "n_words"),
    )


def first_per_key(df: DataFrame, key: str, order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """First row per key by the given order, as a partial aggregate rather than a sort."""
    rest = [c for c in columns if c != key]
    return (
        df.groupBy(key)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("first"))
        .select(key, *[F.col("first")[c].alias(c) for c in rest])
    )


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def score_name(
    method: Column, prompt_group: Column, model_group: Column, eval_method: Column,
    run_id: Column, no_nan: Column,
) -> Column:
    """Display name of a score column; the parts stay columns of their own in the table."""
    vote = F.concat(
        method, F.lit("_"), prompt_group, F.lit("-"), model_group,
        F.when(no_nan, F.lit("_no_nan")).otherwise(F.lit("")),
    )
    learned = F.concat_ws("_", method, model_group, prompt_group, eval_method, run_id)
    return (
        F.when(F.contains(method, F.lit("vote")), vote)
        .when(F.contains(method, F.lit("baseline")), method)
        .otherwise(learned)
    )


def require_columns(df: DataFrame, required: Sequence[str], absent: Sequence[str] = ()) -> DataFrame:
    """Schema contract: these columns must exist, those must not."""
    missing = [c for c in required if c not in df.columns]
    taken = [c for c in absent if c in df.columns]
    if missing or taken:
        raise ValueError(f"missing columns {missing}; columns already present {taken}")
    return df


def contract_report(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Id alignment of two tables: rows, NULL ids, repeated ids and ids without a partner."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias(name))

    both = side(left, "n_left").join(side(right, "n_right"), "k", "full_outer")

    def checks(mine: str, other: str, name: str) -> list[Column]:
        n = F.col(mine)
        return [
            F.coalesce(F.sum(n), F.lit(0)).alias(f"{name}_rows"),
            F.coalesce(F.sum(F.when(F.col("k").isNull(), n)), F.lit(0)).alias(f"{name}_null_ids"),
            F.count_if(F.col("k").isNotNull() & (n > 1)).alias(f"{name}_repeated_ids"),
            F.count_if(F.col("k").isNotNull() & n.isNotNull() & F.col(other).isNull()).alias(
                f"{name}_only_ids"
            ),
        ]

    return both.agg(*checks("n_left", "n_right", "left"), *checks("n_right", "n_left", "right"))


def missing_members(df: DataFrame, column: str, expected: Sequence[str]) -> DataFrame:
    """Expected models (or prompts) that have no row at all."""
    wanted = df.sparkSession.createDataFrame([(e,) for e in expected], f"{column} string")
    return wanted.join(df.select(column).distinct(), column, "left_anti")


def attach_statistics(rows: DataFrame, statistics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join per-key statistics, written out once, back to the rows.

    AQE knows the bytes of both sides when it runs: it broadcasts statistics that are small
    enough and splits skewed keys otherwise.
    """
    return rows.join(materialise(statistics), list(keys))
