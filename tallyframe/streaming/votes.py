"""Keep votes up to date while files of new model outputs and of items arrive.

One streaming aggregation, keyed by item and prompt, remembers the newest answer of every model and
the item's label; it is made of built-in functions, so rows are combined before the shuffle and the
state holds binary rows, one for each key. A batch reads and writes the state of its own keys only and
passes on their answers; those are judged, voted and stored as the batch's changed votes. Outputs that
arrive before their item wait in the state. Which answer is newest does not depend on the order of
arrival: the later time wins, no time counts as earliest, and of equal times the greater answer wins.

The models of the registry are columns of the state. Answers of other models are left out, and a
registry with another list of models needs a checkpoint of its own.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyframe.functions.parsing import judge
from tallyframe.operators.votes import parse_outputs, prompt_votes
from tallyframe.sources.registry import Prompt

OUTPUT_STREAM = "id string, prompt string, model string, output string, ts timestamp"
ITEM_STREAM = "id string, label string"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VOTES = "id string, prompt string, majority_vote boolean, unanimous_vote boolean, percentage_vote double"


def read_stream(
    spark: SparkSession, folder: str, schema: str = OUTPUT_STREAM, files_per_batch: int = 1000
) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)
    )


def newest_answers(
    outputs: DataFrame, items: DataFrame, prompts: Sequence[Prompt], models: Sequence[str]
) -> DataFrame:
    """Complete answers of every (id, prompt) that a batch touches, with the item's label.

    Each cell of the state is the greatest (time, answer) of its model so far; NULL orders first.
    Labels do not change; of several ones the greatest holds. Items without rows of a prompt wait.
    """
    cell = F.struct(F.unix_micros("ts").alias("ts"), F.col("answer"))
    answers = parse_outputs(outputs, prompts, ["ts"]).select(
        "id", "prompt", "family", "model", cell.alias("cell"),
        F.lit(None).cast("string").alias("label"), F.lit(False).alias("come"),
    )
    named = F.explode(F.array(*[F.struct(F.lit(p.name).alias("prompt"), F.lit(p.family).alias("family")) for p in prompts]))
    labels = items.withColumn("p", named).select(
        "id", "p.prompt", "p.family", F.lit(None).cast("string").alias("model"),
        F.lit(None).cast(answers.schema["cell"].dataType).alias("cell"), "label", F.lit(True).alias("come"),
    )
    cells = [
        F.max(F.when(F.col("model") == name, F.col("cell"))).alias(f"cell_{k}")
        for k, name in enumerate(models)
    ]
    held = answers.unionByName(labels).groupBy("id", "prompt", "family").agg(
        F.max("come").alias("come"), F.max("label").alias("label"), *cells
    )
    listed = F.array(
        *[F.struct(F.lit(name).alias("model"), F.col(f"cell_{k}").alias("cell")) for k, name in enumerate(models)]
    )
    return (
        held.where("come")
        .select("id", "prompt", "family", "label", F.explode(listed).alias("c"))
        .where(F.col("c.cell").isNotNull())
        .select("id", "prompt", F.col("c.model").alias("model"), "family", F.col("c.cell.answer").alias("answer"), "label")
    )


class VoteTable:
    """Changed votes by batch under one folder, and now and then a compacted table of all."""

    def __init__(self, folder: str):
        self.changes, self.whole = f"{folder}/changes", f"{folder}/whole"

    def add(self, answers: DataFrame, batch: int) -> None:
        """Store the votes of a batch; a repeated batch overwrites itself with the same."""
        judged = answers.withColumn("vote", judge(F.col("family"), F.col("answer"), F.col("label")))
        prompt_votes(judged.select("id", "prompt", "model", "vote")).write.mode("overwrite").parquet(
            f"{self.changes}/batch={batch}"
        )

    def _numbers(self, spark: SparkSession, path: str) -> list[int]:
        """Numbers of the complete folders: ``_SUCCESS`` is written last."""
        files = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*/_SUCCESS")
        system = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = [s.getPath().getParent().getName() for s in system.globStatus(files) or []]
        return sorted(int(name.split("=")[1]) for name in found)

    def _latest(self, spark: SparkSession) -> tuple[DataFrame, int | None]:
        """Rows of the newest whole table and of the batches after it, with their number, and the
        last number of all. A folder that is being written counts as absent."""
        whole = self._numbers(spark, self.whole)[-1:]
        batches = [n for n in self._numbers(spark, self.changes) if not whole or n > whole[0]]
        rows = spark.createDataFrame([], f"{VOTES}, batch bigint")
        for path, key, numbers in ((self.whole, "upto", whole), (self.changes, "batch", batches)):
            if numbers:
                read = spark.read.schema(f"{VOTES}, {key} bigint").option("basePath", path)
                found = read.parquet(*[f"{path}/{key}={n}" for n in numbers])
                rows = rows.unionByName(found.withColumnRenamed(key, "batch"))
        return rows, max(whole + batches, default=None)

    def votes(self, spark: SparkSession) -> DataFrame:
        """Current votes: those of the last batch that changed the key."""
        columns = ["majority_vote", "unanimous_vote", "percentage_vote"]
        return (
            self._latest(spark)[0]
            .groupBy("id", "prompt")
            .agg(F.max_by(F.struct(*columns), "batch").alias("v"))
            .select("id", "prompt", "v.*")
        )

    def compact(self, spark: SparkSession) -> None:
        """Write the current votes as one table; earlier batches are not read any more."""
        last = self._latest(spark)[1]
        if last is not None:
            self.votes(spark).write.mode("overwrite").parquet(f"{self.whole}/upto={last}")


def start_votes(
    outputs: DataFrame,
    items: DataFrame,
    prompts: Sequence[Prompt],
    models: Sequence[str],
    table: VoteTable,
    checkpoint: str,
) -> StreamingQuery:
    """Refresh the votes from streams of outputs and of items (id, label).

    Runs over what is there and stops; schedule it again, or change the trigger, to go on.
    """
    outputs.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return (
        newest_answers(outputs, items, prompts, models)
        .writeStream.foreachBatch(table.add)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
