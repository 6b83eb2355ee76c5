"""Batch generation with a caller's generator, and retries of invalid outputs."""

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from tallyframe.constants import FORMAT_REMINDER, RETRY_LIMIT
from tallyframe.functions.prompts import ChatFormat, chat_text
from tallyframe.functions.text import is_repetitive
from tallyframe.operators.relational import union_all
from tallyframe.operators.sampling import hash_bucket
from tallyframe.session import materialise

Generator = Callable[[Sequence[str], bool], Sequence[str]]


class Interrupted(BaseException):
    """Raised by a generator to end the whole run; other exceptions only fail its batch."""


def generate(
    prompts: DataFrame, factory: Callable[[], Generator], batch_size: int = 32, retry: bool = False
) -> DataFrame:
    """The rows with ``output`` and ``failed`` in place of ``prompt_text``.

    ``factory`` runs once per task and returns a function of (texts, is this a retry?). All other
    columns pass through beside their prompt, so repeated ids stay apart and nothing is joined. A
    batch that raises gives an empty text per row, which counts as invalid, and is marked failed.
    """
    passed = [f for f in prompts.schema if f.name != "prompt_text"]
    schema = StructType([*passed, StructField("output", StringType()), StructField("failed", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        generator = factory()
        for whole in batches:
            for start in range(0, whole.num_rows, batch_size):
                part = whole.slice(start, batch_size)
                try:
                    texts = list(generator(part["prompt_text"].to_pylist(), retry))
                    failed = False
                except Exception:
                    texts, failed = [""] * part.num_rows, True
                rest = part.drop_columns(["prompt_text"])
                rest = rest.append_column("output", pa.array(texts, pa.string()))
                yield rest.append_column("failed", pa.array([failed] * part.num_rows))

    columns = [f.name for f in passed]
    return prompts.select(*columns, "prompt_text").mapInArrow(run, schema)


def retry_action(output: Column, is_valid: Column, attempt: Column) -> Column:
    """What follows an output: done, given up, a fresh try, or a try with a reminder.

    ``attempt`` counts this output, starting at 1.
    """
    return (
        F.when(is_valid, "valid")
        .when(attempt >= RETRY_LIMIT, "invalid")
        .when(F.coalesce(is_repetitive(output), F.lit(False)), "retry")
        .otherwise("append")
    )


def retry_messages(messages: Column, output: Column, action: Column) -> Column:
    """Messages of the next try: the original ones, plus output and reminder for ``append``."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    reply = F.array(turn("assistant", output), turn("user", F.lit(FORMAT_REMINDER)))
    return F.when(action == "append", F.concat(messages, reply)).otherwise(messages)


def generate_with_retries(
    items: DataFrame,
    factory: Callable[[], Generator],
    is_valid: Callable[[Column], Column],
    layout: ChatFormat = ChatFormat(),
    batch_size: int = 32,
) -> DataFrame:
    """``(id, output, attempts, failures)`` for ``(id, messages)`` rows; NULL after the last
    failure. Rows that share an id are asked one by one and each give a row.

    Each round generates only what is still open. Its result is written out, since running
    the generator again would be expensive and need not repeat the same texts. ``failures``
    counts the tries in which the generator itself raised.
    """

    def ask(open_rows: DataFrame, attempt: int) -> DataFrame:
        return materialise(_round(open_rows, attempt, factory, is_valid, layout, batch_size))

    return _rounds(items, ask)


def _round(
    open_rows: DataFrame, attempt: int, factory: Callable[[], Generator],
    is_valid: Callable[[Column], Column], layout: ChatFormat, batch_size: int,
) -> DataFrame:
    """Outputs of one round, what follows each, and how often the generator has raised."""
    prompts = open_rows.withColumn("prompt_text", chat_text(F.col("next_messages"), layout))
    outputs = generate(prompts, factory, batch_size, retry=attempt > 1)
    action = retry_action(F.col("output"), is_valid(F.col("output")), F.lit(attempt))
    return outputs.withColumn("action", action).withColumn(
        "failures", F.col("failures") + F.col("failed").cast("int")
    )


def _rounds(items: DataFrame, ask: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """Ask in rounds what is still open; ``ask`` gives the stored results of a round."""
    open_rows = items.select(
        "id", "messages", F.col("messages").alias("next_messages"), F.lit(0).alias("failures")
    )
    finished = []
    for attempt in range(1, RETRY_LIMIT + 1):
        results = ask(open_rows, attempt)
        done = F.col("action").isin("valid", "invalid")
        finished.append(
            results.where(done).select(
                "id",
                F.when(F.col("action") == "valid", F.col("output")).alias("output"),
                F.lit(attempt).alias("attempts"),
                "failures",
            )
        )
        open_rows = results.where(~done).select(
            "id", "messages",
            retry_messages(F.col("messages"), F.col("output"), F.col("action")).alias(
                "next_messages"
            ),
            "failures",
        )
    return union_all(finished)


class StoredRounds:
    """Results of a run's rounds under a folder, in parts of ids that are committed one by one.

    A part's folder counts from its ``_SUCCESS`` on, which is written last, so what a broken run has
    committed is found again and the rest is asked anew. ``attempt=1/part=3/rows=0`` holds the first
    results of part 3; items that come later are committed beside them, as ``rows=1`` and so on.
    """

    def __init__(self, spark: SparkSession, folder: str, parts: int = 16):
        self.spark, self.folder, self.parts = spark, folder.rstrip("/"), parts

    def _committed(self, attempt: int) -> dict[int, list[str]]:
        """Folders with committed results of a round, by part."""
        found: dict[int, list[str]] = {}
        for path in self._paths(f"{self.folder}/attempt={attempt}/part=*/rows=*/_SUCCESS"):
            folder = path.getParent()
            found.setdefault(int(folder.getParent().getName().split("=")[1]), []).append(folder.toString())
        return found

    def _paths(self, pattern: str) -> list:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(pattern)
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [status.getPath() for status in files.globStatus(path) or []]

    def round(self, attempt: int) -> DataFrame:
        """All committed results of a round that has begun."""
        return self.spark.read.parquet(*[f for found in self._committed(attempt).values() for f in found])

    def ask(
        self, open_rows: DataFrame, attempt: int, answer: Callable[[DataFrame], DataFrame]
    ) -> DataFrame:
        """Results of a round for the open rows; ``answer`` is asked about those without any yet."""
        known = self._committed(attempt)
        if known:
            seen = self.round(attempt).select(F.col("id").alias("seen")).distinct()
            asked = open_rows.join(seen, F.col("id").eqNullSafe(F.col("seen")), "left_anti")
        else:
            asked = open_rows
        # dealt out once, so that a part reads its own rows only
        questions = f"{self.folder}/questions/attempt={attempt}-{uuid.uuid4().hex}"
        asked.withColumn("part", F.coalesce(hash_bucket(F.col("id"), self.parts), F.lit(0))).hint(
            "rebalance", "part"
        ).write.partitionBy("part").parquet(questions)
        dealt = [path.getName() for path in self._paths(f"{questions}/part=*")]
        for number in sorted(int(name.split("=")[1]) for name in dealt):
            name = f"part={number}"
            target = f"{self.folder}/attempt={attempt}/{name}/rows={len(known.get(number, []))}"
            rows = self.spark.read.schema(asked.schema).parquet(f"{questions}/{name}")
            answer(rows).write.mode("overwrite").parquet(target)
        if not self._committed(attempt):
            return answer(open_rows.limit(0))
        stored = self.round(attempt)
        wanted = open_rows.select(F.col("id").alias("wanted")).distinct()
        return stored.join(wanted, F.col("id").eqNullSafe(F.col("wanted")), "left_semi")


def generate_resumably(
    items: DataFrame,
    factory: Callable[[], Generator],
    is_valid: Callable[[Column], Column],
    stored: StoredRounds,
    layout: ChatFormat = ChatFormat(),
    batch_size: int = 32,
) -> DataFrame:
    """Like ``generate_with_retries``, with every part of a round committed as soon as it is done.

    Called again with the same folder after a run that broke off, it asks only about items that no
    committed part holds. An item asked before keeps its results, even if its messages have changed:
    a new question needs a new folder.
    """

    def ask(open_rows: DataFrame, attempt: int) -> DataFrame:
        return stored.ask(
            open_rows, attempt,
            lambda rows: _round(rows, attempt, factory, is_valid, layout, batch_size),
        )

    return _rounds(items, ask)
