"""Clean, deduplicate, decontaminate and pack the documents, stage by stage.

Every stage reads what its predecessor kept from Parquet, so a lost executor never costs more than
the stage that runs. All but the last return the columns of ``documents``. Rows without a doc_id
pass the stages that decide by id.
"""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import bottom_k, decontamination, line_runs, packing, toxicity
from tallyframe.llm.queries import SPECIAL_50K, table, vocabulary
from tallyframe.session import ensure_checkpoint_dir


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, learned from the labelled ones, does not find toxic."""
    labelled = toxicity.sample_labelled(docs, table(spark, sf_dir, "labels"))
    return toxicity.clean_documents(docs, toxicity.learn(labelled))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that at least three hold; ``n_chars`` follows the new text."""
    kept = line_runs.drop_repeated_lines(docs)
    if "n_chars" in docs.columns:
        size = F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
        kept = kept.withColumn("n_chars", size)
    return kept


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of every group linked by five-word shingles at 0.8."""
    found = bottom_k.near_duplicates(docs, words=5, percent=80)
    copies = found.where(~F.col("kept")).select("doc_id").distinct()
    kept = docs.join(copies, "doc_id", "left_anti").select(docs.columns)
    # rows that repeat an id are copies too
    return kept.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"]).unionByName(
        docs.where(F.col("doc_id").isNull())
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    found = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"))
    held = found.select("doc_id").distinct()
    return docs.join(held, "doc_id", "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 ids, one row per piece."""
    return packing.pack(docs, *vocabulary("byte_bpe_50k"), special=SPECIAL_50K)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# Token ids are beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; stages in between lie in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
