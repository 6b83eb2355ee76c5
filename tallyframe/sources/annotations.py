"""Folders of annotation documents: one folder per document, one file per annotator."""

import itertools
import os
from collections.abc import Iterator, Sequence
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe import schemas
from tallyframe.session import materialise

# Tasks that list folders; Spark's default is 10,000 whatever the cluster.
LISTERS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
LISTERS_PER_CORE = 16
# Files that tasks read go to the JVM in batches of so many, or fewer of so many bytes together.
FILES_AT_ONCE, BYTES_AT_ONCE = 64, 4 << 20
# Documents in a part of the table they are read to, if that gives every core its parts.
DOCUMENTS_IN_PART = 8192
# Characters that names of partition folders hold as %XX, and the name for NULL and the empty text.
ESCAPED = {chr(c): f"%{c:02X}" for c in [*range(1, 32), 127, *b"\"#%'*/:=?\\{[]^"]}
NO_NAME = "__HIVE_DEFAULT_PARTITION__"


def read_annotation_files(
    spark: SparkSession, path: str, partitioned: bool = False
) -> DataFrame:
    """``(document, annotator, features)`` for every ``<document>/<annotator>.json``.

    ``partitioned`` reads what ``write_annotation_files`` wrote. On a local (or locally mounted) file
    system tasks list and read its folders, and the driver learns only how many documents there are.
    Elsewhere Spark lists them in tasks, a folder of folders at a time, but its driver keeps every
    file; patterns would be resolved on the driver, one folder after another.
    """
    folder = _local_folder(path) if partitioned else None
    if folder is not None:
        return _read_by_tasks(spark, folder)
    file = F.col("_metadata.file_path")
    if partitioned:
        files, patterns = "", ("/document=([^/]*)/", "/annotator=([^/]*)/[^/]*$")
    else:
        files, patterns = "/*/*.json", (r"([^/]+)/[^/]+$", r"([^/]+)\.json$")
    document, annotator = (_unescaped(F.regexp_extract(file, p, 1), partitioned) for p in patterns)
    before = spark.conf.get(LISTERS)
    spark.conf.set(LISTERS, LISTERS_PER_CORE * spark.sparkContext.defaultParallelism)
    try:  # files are listed here, not when they are read
        read = spark.read.schema(schemas.ANNOTATION_FEATURES).json(
            f"{path}{files}", multiLine=True, recursiveFileLookup=partitioned
        )
    finally:
        spark.conf.set(LISTERS, before)
    # Spark reads some thirty small files to a task; a part holds those of some thirty such tasks
    parts = read.rdd.getNumPartitions() // 32
    return read.coalesce(max(parts, LISTERS_PER_CORE * spark.sparkContext.defaultParallelism)).select(
        document.alias("document"),
        annotator.alias("annotator"),
        F.col("`%FEATURE_STRUCTURES`").alias("features"),
    )


def _local_folder(path: str) -> str | None:
    """A path as Python opens it, if it is one of a local file system."""
    place = urlparse(path)
    if place.scheme not in ("", "file"):
        return None
    return unquote(place.path) if place.scheme else path


def _read_by_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of a written folder. One task goes through the names of its documents as the file
    system gives them; they are dealt out, and tasks open what lies in the folders dealt to them."""
    listed = spark.range(1, numPartitions=1).mapInArrow(
        lambda batches: _documents_listed(folder, batches), "name string"
    )
    names = materialise(listed)  # a folder is gone through once
    documents = names.count()
    least = LISTERS_PER_CORE * spark.sparkContext.defaultParallelism
    parts = max(1, min(documents, max(documents // DOCUMENTS_IN_PART, least)))
    read = names.repartition(parts, "name").mapInArrow(
        lambda batches: _files_read(folder, batches), "document string, annotator string, value binary"
    )
    parsed = F.from_json(F.col("value").cast("string"), schemas.ANNOTATION_FEATURES)
    return read.select(
        _unescaped("document", False).alias("document"),
        _unescaped("annotator", False).alias("annotator"),
        parsed["%FEATURE_STRUCTURES"].alias("features"),
    )


def _folders(folder: str, column: str) -> Iterator[str]:
    """Values, as they are escaped, of the partition folders of a column."""
    with os.scandir(folder) as entries:
        for entry in entries:
            if entry.name.startswith(f"{column}=") and entry.is_dir():
                yield entry.name.removeprefix(f"{column}=")


def _documents_listed(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _ in range(batch.num_rows):
            for names in itertools.batched(_folders(folder, "document"), 10_000):
                yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string())})


def _files_read(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(document, annotator, value)`` of the files that Spark would read: no hidden and no blank ones."""
    rows, size = [], 0
    for document in (name for batch in batches for name in batch.column(0).to_pylist()):
        home = f"{folder}/document={document}"
        for annotator in _folders(home, "annotator"):
            with os.scandir(f"{home}/annotator={annotator}") as entries:
                files = [e.path for e in entries if not e.name.startswith(("_", ".")) and e.is_file()]
            for file in files:
                with open(file, "rb") as opened:
                    value = opened.read()
                if not value.strip():
                    continue
                rows.append((document, annotator, value))
                size += len(value)
                if len(rows) == FILES_AT_ONCE or size >= BYTES_AT_ONCE:
                    yield _file_rows(rows)
                    rows, size = [], 0
    if rows:
        yield _file_rows(rows)


def _file_rows(rows: list[tuple[str, str, bytes]]) -> pa.RecordBatch:
    document, annotator, value = zip(*rows, strict=True)
    columns = [pa.array(document, pa.string()), pa.array(annotator, pa.string()), pa.array(value, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["document", "annotator", "value"])


def opened_once(files: DataFrame) -> DataFrame:
    """Read files stored as a table."""
    return materialise(files)


def _unescaped(name: Column | str, partitioned: bool) -> Column:
    """Names as they were: paths are escaped once, values of partition folders once more."""
    plain = lambda text: F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
    return plain(plain(name)) if partitioned else plain(name)


def write_annotation_files(documents: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One file per ``(document, annotator, features)`` row, in a folder for each document and in
    it for each annotator, written where the rows are.

    New folders of a local (or locally mounted) file system are filled by the tasks themselves: there
    Hadoop starts a process for every file it makes. All others are written by Spark.
    """
    text = F.to_json(F.struct(F.col("features").alias("%FEATURE_STRUCTURES")))
    rows = documents.select("document", "annotator", text.alias("value"))
    folder = _local_folder(path) if mode == "errorifexists" else None
    writer = (rows if folder is None else rows.limit(0)).write.mode(mode)
    writer.partitionBy("document", "annotator").text(path)
    if folder is not None:
        files = rows.mapInArrow(lambda batches: _files_written(folder, batches), "files bigint")
        files.agg(F.sum("files")).collect()


def _files_written(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Write a task's rows; names depend on the task alone, so a repeated one replaces its files."""
    name, met = f"part-{TaskContext.get().partitionId():05d}.txt", set()
    for batch in batches:
        for document, annotator, value in zip(*batch.columns, strict=True):
            document, annotator = _escaped(document.as_py()), _escaped(annotator.as_py())
            home = f"{folder}/document={document}/annotator={annotator}"
            os.makedirs(home, exist_ok=True)
            # rows of one document and annotator stand in one file, one below the other
            with open(f"{home}/{name}", "a" if home in met else "w", encoding="utf-8", newline="") as file:
                file.write(f"{value.as_py()}\n")
            met.add(home)
        yield pa.RecordBatch.from_pydict({"files": pa.array([batch.num_rows], pa.int64())})


def _escaped(name: str | None) -> str:
    return "".join(ESCAPED.get(c, c) for c in name) if name else NO_NAME


def choose_annotator(files: DataFrame, annotator: str | Sequence[str] | None = None) -> DataFrame:
    """One file per document: a named annotator, the first of a list, or the only one.

    Without a name a document with several files is an error. Documents nobody listed has
    annotated are left out.
    """
    picked = files
    if isinstance(annotator, str):
        picked = files.where(F.col("annotator") == annotator)
    elif annotator is not None:
        rank = F.array_position(F.lit(list(annotator)), F.col("annotator"))
        best = (
            files.where(rank > 0)
            .groupBy("document")
            .agg(F.min_by("annotator", rank).alias("annotator"))
        )
        picked = files.join(best, ["document", "annotator"], "left_semi")
    else:
        crowded = files.groupBy("document").count().where("count > 1").limit(1).collect()
        if crowded:
            raise ValueError(f"document {crowded[0]['document']} has several annotation files")
    return picked.select(
        F.split_part("document", F.lit("."), F.lit(1)).alias("id"), "annotator", "features"
    )
