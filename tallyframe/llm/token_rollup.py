"""Token counts kept as additive totals by source, language and tokenizer version.

A batch of signed changes becomes one small table of totals in a folder named by the batch. The
totals of all folders add up to the counts now; a batch that is committed again is skipped, and one
that broke off is written anew, so repeating a batch changes nothing.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.shared import map_rows
from tallyframe.llm.tokens import byte_encoder

KEYS = ["source", "lang", "tokenizer"]
TOTALS = "source string, lang string, tokenizer string, documents bigint, tokens bigint"


def count_tokens(documents: DataFrame, tokenizers: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per document and tokenizer version with the document's tokens and code points.

    ``tokenizers`` maps a version to the paths and pre-token pattern of ``byte_encoder``. A null
    or empty text has no tokens but counts as a document.
    """

    def make():
        encoders = {name: byte_encoder(*args) for name, args in tokenizers.items()}

        def work(batch):
            texts = batch["text"].to_pylist()
            names = list(encoders)
            spread = {c: batch[c].to_pylist() for c in ("doc_id", "source", "lang")}
            out = {c: [v for v in values for _ in names] for c, values in spread.items()}
            out["tokenizer"] = names * len(texts)
            out["tokens"] = [len(encoders[n](t or "")) // 4 for t in texts for n in names]
            out["chars"] = [len(t or "") for t in texts for _ in names]
            return out

        return work

    return map_rows(
        documents.select("doc_id", "source", "lang", "text"),
        "doc_id bigint, source string, lang string, tokenizer string, tokens bigint, chars bigint",
        make,
    )


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).alias("sign"), "tokens")


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).alias("sign"), "tokens")


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Replace counts: what was inserted goes, what holds now comes. The two need no join."""
    return deletes(before).unionByName(inserts(after))


class TokenRollup:
    """Totals under a folder; ``commit`` adds a batch once, ``totals`` sums what is committed."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _exists(self, name: str) -> bool:
        path = self._path(name)
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return files.exists(path)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add signed changes (source, lang, tokenizer, sign, tokens) as a batch.

        Returns False, and reads nothing, if that batch is already in. ``_SUCCESS`` is written
        last, so a batch that broke off counts as absent and is written anew.
        """
        if self._exists(f"batch={batch}/_SUCCESS"):
            return False
        delta = changes.groupBy(*KEYS).agg(
            F.sum(F.col("sign").cast("bigint")).alias("documents"),
            F.sum(F.col("sign") * F.col("tokens")).alias("tokens"),
        )
        delta.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")
        return True

    def batches(self) -> list[str]:
        root = self._path("")
        files = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(root):
            return []
        names = [s.getPath().getName() for s in files.listStatus(root)]
        return sorted(n for n in names if n.startswith("batch=") and self._exists(f"{n}/_SUCCESS"))

    def totals(self) -> DataFrame:
        """Totals of all committed batches; a key whose documents have all gone has no row."""
        paths = [f"{self.folder}/{name}" for name in self.batches()]
        deltas = (
            self.spark.read.schema(TOTALS).parquet(*paths)
            if paths
            else self.spark.createDataFrame([], TOTALS)
        )
        return (
            deltas.groupBy(*KEYS)
            .agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
            .where((F.col("documents") != 0) | (F.col("tokens") != 0))
        )
