"""JSON tables, column upserts and text documents."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe import schemas
from tallyframe.functions.matching import label_entries
from tallyframe.operators.flatten import annotation_texts, parse_question_pairs
from tallyframe.operators.sampling import hash_bucket
from tallyframe.session import materialise


def spread(df: DataFrame) -> DataFrame:
    """Give a table with fewer splits than cores one partition per core.

    Meant for text-heavy work on a small or single file; a table that already has enough
    splits is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_json_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One record per line; keys a record lacks are NULL and nothing is coerced."""
    return spark.read.schema(schema).json(path)


def read_json_array(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One array of records per file; files are the unit of parallel reading."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_json_folder(
    spark: SparkSession, path: str, schema: str, key: str = "dataset", arrays: bool = False,
    folders: bool = False,
) -> DataFrame:
    """All JSON files of a folder as one table, keyed by file name without its ending.

    With ``folders`` the key is the name of the folder a file lies in, without a ``column=`` before
    it, as partitioned writes leave them.
    """
    if folders:
        own = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
        name = F.url_decode(F.url_decode(F.regexp_replace(own, "^[^=]*=", "")))
        path = f"{path}/*"
    else:
        name = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    return (
        spark.read.schema(schema)
        .json(path, multiLine=arrays, pathGlobFilter="*.json")
        .select("*", name.alias(key))
    )


FILE, BROKEN = "source_file", "broken_record"


def read_json_checked(
    spark: SparkSession, path: str | list[str], schema: str, arrays: bool = False
) -> DataFrame:
    """JSON lines, or one array per file, with the file of each record and what is no JSON.

    ``broken_record`` holds the text of a line, or of a whole file of an array, that cannot be read;
    such a record has NULL in every other column and costs neither the job nor its neighbours.
    """
    lines = spark.read.text(path, wholetext=arrays).select(
        F.col("_metadata.file_path").alias(FILE), F.col("value")
    )
    lines = lines.where(F.rlike("value", F.lit(r"\S")))
    if not arrays:
        fields = f"{schema}, {BROKEN} string"
        options = {"columnNameOfCorruptRecord": BROKEN}
        return lines.select(F.from_json("value", fields, options).alias("r"), FILE).select("r.*", FILE)
    records = F.from_json("value", f"array<struct<{schema}>>", {"mode": "PERMISSIVE"})
    # a text that ends too early is no array, whatever could be read of it
    whole = records.isNotNull() & F.rlike("value", F.lit(r"\]\s*$"))
    parsed = lines.select(FILE, F.when(whole, records).alias("records"), "value")
    good = parsed.select(F.explode("records").alias("r"), FILE).select(
        "r.*", F.lit(None).cast("string").alias(BROKEN), FILE
    )
    bad = parsed.where(F.col("records").isNull()).select(F.col("value").alias(BROKEN), FILE)
    return good.unionByName(bad, allowMissingColumns=True)


def sound_records(checked: DataFrame) -> DataFrame:
    """Records that could be read, without the columns of the check."""
    return checked.where(F.col(BROKEN).isNull()).drop(BROKEN, FILE)


def file_report(checked: DataFrame) -> DataFrame:
    """``(file, records, broken)`` of every file that holds anything but blanks."""
    return checked.groupBy(F.col(FILE).alias("file")).agg(
        F.count_if(F.col(BROKEN).isNull()).alias("records"),
        F.count_if(F.col(BROKEN).isNotNull()).alias("broken"),
    )


def write_json_arrays(df: DataFrame, path: str, files: int, key: str = "id") -> None:
    """One array of records per file, in so many files by a hash of the key; each should be small
    enough for a reader to take it whole."""
    group = hash_bucket(F.coalesce(F.col(key).cast("string"), F.lit("")), files)
    arrays = df.select(group.alias("part"), F.struct(*df.columns).alias("record")).groupBy("part").agg(
        F.to_json(F.collect_list("record"), {"ignoreNullFields": "false"}).alias("value")
    )
    arrays.write.partitionBy("part").text(path)


def list_datasets(folder: DataFrame, key: str = "dataset") -> DataFrame:
    return folder.select(key).distinct()


def read_outputs(
    spark: SparkSession, path: str, prompt: str, models: Sequence[str]
) -> DataFrame:
    """Long outputs from a file with one text column per model."""
    wide = read_json_lines(spark, path, schemas.wide_outputs(list(models)))
    return wide.unpivot(["id", "label"], list(models), "model", "output").withColumn(
        "prompt", F.lit(prompt)
    )


def write_outputs(
    outputs: DataFrame, labels: DataFrame, models: Sequence[str], path: str
) -> None:
    """``(id, prompt, model, output)`` rows as files that ``read_outputs`` takes, one folder
    ``prompt=<name>`` for each prompt.

    All prompts are dealt out by id at once and meet their labels (id, label) where they lie. Texts of
    several models on one line are much alike, so the files are compressed.
    """
    of = lambda m: F.max(F.when(F.col("model") == m, F.col("output"))).alias(m)
    wide = outputs.repartition("id").groupBy("id", "prompt").agg(*[of(m) for m in models])
    conf, writers = outputs.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(writers)
    conf.set(writers, 32)  # so many prompts are written as they come, and not sorted by prompt first
    try:
        write_json_lines(wide.join(labels, "id"), path, partition=["prompt"], compression="gzip")
    finally:
        conf.set(writers, before)


def read_relabeled(spark: SparkSession, path: str, annotator: str | None = None) -> DataFrame:
    """Re-annotated labels with ordered entries, as the matching operators take them."""
    return read_json_array(spark, path, schemas.RELABELED).select(
        "id",
        F.lit(annotator).alias("annotator"),
        label_entries(F.col("label")).alias("entries"),
        "other_labels",
        F.transform("other_labels", lambda o: o["text"]).alias("other_texts"),
        "unanswerable",
        "erronous_question",
    )


def read_source_documents(spark: SparkSession, path: str, schema: str = schemas.SOURCE_DOCUMENTS) -> DataFrame:
    """Question documents with typed answers; the row ordinal comes from ``index``."""
    return read_json_array(spark, path, schema).withColumn(
        "questions", parse_question_pairs(F.col("questions"))
    )


def write_json_lines(
    df: DataFrame, path: str, mode: str = "errorifexists", partition: Sequence[str] = (),
    compression: str = "none",
) -> None:
    """One record per line, with explicit nulls; ``partition`` columns become folders."""
    writer = df.write.mode(mode).option("ignoreNullFields", "false").partitionBy(*partition)
    writer.json(path, compression=compression)


def write_samples(samples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A top-n sample, one small file."""
    write_json_lines(samples.coalesce(1), path, mode)


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` replace those of the same key; other rows stay."""
    return existing.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def replace_column(
    existing: DataFrame, new: DataFrame, keys: Sequence[str], partition: Sequence[str]
) -> DataFrame:
    """Upsert of whole columns (say a prompt and model): each must cover the same items.

    ``partition`` names the column keys. The check compares key sets, not only counts, and
    passes a partition the table does not have yet.
    """
    ids = [k for k in keys if k not in partition]
    new = materialise(new)
    touched = new.select(*partition).distinct()
    before = existing.join(touched, list(partition), "left_semi").select(*keys)
    known = touched.join(before.select(*partition).distinct(), list(partition), "left_semi")
    after = new.join(known, list(partition), "left_semi").select(*keys)
    signed = before.withColumn("sign", F.lit(1)).unionByName(after.withColumn("sign", F.lit(-1)))
    if signed.groupBy(*keys).agg(F.sum("sign").alias("sign")).where("sign != 0").limit(1).count():
        raise ValueError(f"the new column covers other {ids} than the stored one")
    # whole columns are replaced, so the few names of the touched ones tell old rows from kept ones
    kept = existing.join(touched, list(partition), "left_anti").select(existing.columns)
    return kept.unionByName(new)


def write_annotation_texts(
    documents: DataFrame, path: str, ordinal: str = "row", single_files: bool = False
) -> None:
    """One text per question as a table (id, value).

    ``single_files`` writes a folder ``id=<row>_<question>`` for each text instead, as annotation
    tools read them; it is meant for a small set.
    """
    texts = annotation_texts(documents, ordinal)
    if single_files:
        texts.write.partitionBy("id").option("lineSep", "\n").text(path)
    else:
        texts.write.parquet(path)
