"""Whole jobs over a project's stored tables.

A workspace is a folder of Parquet tables partitioned by dataset. Jobs overwrite only the
partitions they produce, so a score or a prompt can be computed again on its own.
"""

import hashlib
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce
from operator import and_, or_
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyframe.functions.prompts import MessageTemplate, chat_text, render_messages
from tallyframe.functions.parsing import is_valid_output, replace_empty_label
from tallyframe.operators import (
    agreement,
    annotations,
    curves,
    features,
    generation,
    learned,
    metrics,
    relational,
    sampling,
    search,
    textjobs,
    votes,
)
from tallyframe.session import materialise
from tallyframe.sources.annotations import NO_NAME, choose_annotator, opened_once, read_annotation_files
from tallyframe.sources.dealt import dealt_out
from tallyframe.sources.registry import (
    Model,
    Prompt,
    PromptRecord,
    names_in,
    prompt_records,
    prompt_records_table,
)

VOTE_METHODS = (
    "majority_vote",
    "unanimous_vote",
    "percentage_vote",
    "model_majority_prompt_unanimous_vote",
)

# Tables that can be dealt out by id, and how they are partitioned below the dataset.
BUCKETED = {"items": (), "outputs": ("prompt", "model")}

# If such a table has partitions below the dataset and is stored in buckets, all rows of one call of
# ``store`` stand in one folder, the texts of an id side by side, where zstd packs what is alike in
# them. The folder has the call's name, by time, and a table beside tells what each call has stored.
STORE_CALL = "store_call"
CALLS = "_calls"

# Texts of these tables are packed more tightly than by default.
PACKED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "6"}

# Dealt rows go from the disk as soon as they are stored.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Files a task keeps open at once, each with a row group of so many bytes: up to so many partitions,
# rows are written as they come and not sorted by partition first, which would spill long texts.
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
OPEN_FILES, ROW_GROUP = 32, 16 << 20

# Steps a prompt may name; items go through them before its messages are rendered.
STEPS: dict[str, relational.Step] = {
    "reduce_context": textjobs.reduce_contexts,
    "drop_empty_labels": relational.drop_empty_labels,
    "replace_empty_label": lambda items: items.withColumn(
        "label", replace_empty_label(F.col("label"))
    ),
}


class Workspace:
    def __init__(
        self, spark: SparkSession, root: str, models: Sequence[Model], prompts: Sequence[Prompt],
        buckets: int | None = None,
    ):
        """``buckets`` stores the tables of ``BUCKETED`` dealt out by id into so many files for each
        call of ``store``: texts are shuffled once, when they are stored, and not by joins on the id."""
        self.spark, self.root, self.buckets = spark, root, buckets
        self.models, self.prompts = list(models), list(prompts)

    def read(self, table: str, dataset: str | None = None) -> DataFrame:
        rows = self._current(table, self.spark.read.parquet(f"{self.root}/{table}"))
        return rows if dataset is None else rows.where(F.col("dataset") == dataset).drop("dataset")

    def by_id(self, table: str, dataset: str) -> DataFrame:
        """A table like ``read``; if it is stored in buckets, Spark knows how its ids are dealt out."""
        if self.buckets is None or table not in BUCKETED:
            return self.read(table, dataset)
        rows = self._current(table, self.spark.table(self._registered(table)))
        return rows.where(F.col("dataset") == dataset).drop("dataset")

    def _by_call(self, table: str) -> bool:
        """Whether a table stands, or is to stand, in a folder for each call of ``store``."""
        if not BUCKETED.get(table):
            return False
        if self._listed(f"{self.root}/{table}/dataset=*/{STORE_CALL}=*"):
            return True
        return self.buckets is not None and not self._listed(f"{self.root}/{table}/dataset=*/*=*")

    def _call_folders(self, table: str) -> dict[tuple[str | None, str], str]:
        """Folders of a table by dataset and call."""
        folders = {}
        for folder in self._listed(f"{self.root}/{table}/dataset=*/{STORE_CALL}=*"):
            dataset, call = (unquote(part.split("=", 1)[1]) for part in folder.split("/")[-2:])
            folders[None if dataset == NO_NAME else dataset, call] = folder
        return folders

    def _calls(self, table: str) -> dict[tuple[str | None, str], dict[tuple, bool]]:
        """For each dataset and call that stands: the partitions it has stored, and whether they are
        current, that is, in no later call. A call that broke off has none."""
        calls: dict[tuple, dict[tuple, bool]] = {place: {} for place in self._call_folders(table)}
        if self._listed(f"{self.root}/{CALLS}/{table}/*.parquet"):
            last: dict[tuple, str] = {}
            stored = self.spark.read.parquet(f"{self.root}/{CALLS}/{table}").collect()
            for dataset, call, *partition in sorted(stored, key=lambda r: r[STORE_CALL]):
                if (dataset, call) in calls:
                    calls[dataset, call][tuple(partition)] = True
                    if (key := (dataset, *partition)) in last:
                        calls[dataset, last[key]][tuple(partition)] = False
                    last[key] = call
        return calls

    def _current(self, table: str, rows: DataFrame) -> DataFrame:
        """Rows that no later call has replaced, without the name of the call."""
        if not BUCKETED.get(table) or STORE_CALL not in rows.columns:
            return rows
        same = lambda columns, values: reduce(
            and_, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(columns, values, strict=True)]
        )
        for place, stored in self._calls(table).items():
            gone = [same(BUCKETED[table], partition) for partition, current in stored.items() if not current]
            if gone or not stored:
                here = same(("dataset", STORE_CALL), place)
                rows = rows.where(~(here & reduce(or_, gone) if stored else here))
        return rows.drop(STORE_CALL)

    def _registered(self, table: str, schema: StructType | None = None) -> str:
        """Name in the session's catalog of a table stored in buckets under the root."""
        name = f"{table}_{hashlib.md5(self.root.encode()).hexdigest()}"
        if not self.spark.catalog.tableExists(name):
            stored = schema is None
            schema = schema or self.spark.read.parquet(f"{self.root}/{table}").schema
            parts = ["dataset", STORE_CALL] if self._by_call(table) else ["dataset", *BUCKETED[table]]
            kinds = {f.name: f.dataType.simpleString() for f in schema}
            if STORE_CALL in parts:  # names as they are, also those of digits
                kinds |= dict.fromkeys(parts, "string")
            last = [*(c for c in BUCKETED[table] if c not in parts), *parts]
            columns = ", ".join(f"`{c}` {kinds[c]}" for c in [*(f.name for f in schema if f.name not in last), *last])
            packed = ", ".join(f"'{k}' '{v}'" for k, v in PACKED.items())
            self.spark.sql(
                f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS ({packed}) PARTITIONED BY ({', '.join(parts)}) "
                f"CLUSTERED BY (id) SORTED BY (id) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{table}'"
            )
            if stored:
                self.spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
        return name

    def _overwrite_buckets(self, table: str, rows: DataFrame) -> None:
        stored = bool(self._listed(f"{self.root}/{table}/dataset=*"))
        name = self._registered(table, None if stored else rows.schema)
        call = f"c{time.time_ns():020d}-{uuid.uuid4().hex[:8]}" if self._by_call(table) else None
        if call is not None:
            rows = rows.withColumn(STORE_CALL, F.lit(call))
        dealt = dealt_out(rows.select(self.spark.table(name).columns), self.buckets, "id")
        with self._set("spark.sql.sources.partitionOverwriteMode", "dynamic"), self._set(CLEANUP, "true"):
            dealt.write.insertInto(name, overwrite=True)
        if call is not None:
            self._replace(table, name, call)

    def _replace(self, table: str, name: str, call: str) -> None:
        """A call's rows take the place of earlier ones; folders that are replaced altogether go."""
        keys = ["dataset", STORE_CALL, *BUCKETED[table]]
        stored = self.spark.table(name).where(F.col(STORE_CALL) == call).select(keys).distinct()
        stored.coalesce(1).write.mode("append").parquet(f"{self.root}/{CALLS}/{table}")
        folders = self._call_folders(table)
        for place, partitions in self._calls(table).items():
            if partitions and not any(partitions.values()):
                path, files = self._files(folders[place])
                files.delete(path, True)
        self.spark.catalog.refreshTable(name)

    @contextmanager
    def _set(self, setting: str, value: str | int) -> Iterator[None]:
        before = self.spark.conf.get(setting)
        self.spark.conf.set(setting, value)
        try:
            yield
        finally:
            self.spark.conf.set(setting, before)

    def _write(self, table: str, writer: DataFrameWriter, path: str) -> None:
        options = {"parquet.block.size": ROW_GROUP} | (PACKED if table in BUCKETED else {})
        with self._set(WRITERS, OPEN_FILES):
            writer.options(**options).parquet(path)

    def store(
        self, table: str, rows: DataFrame, dataset: str | None, *partition: str, staged: bool = False
    ) -> None:
        """Write the partitions the rows belong to; others stay as they are.

        Without a dataset the rows carry their own ``dataset`` column. Narrow rows are rebalanced
        by partition first, so that not every task writes a small file into every partition;
        outputs hold long texts and are written where they are.

        ``staged`` is for jobs that replace what they read: the rows go to a folder of their own
        first, which is complete before any partition is touched and stays until all are switched.
        A job that breaks off in between loses nothing: ``recover`` does the switch again.
        """
        if dataset is not None:
            rows = rows.withColumn("dataset", F.lit(dataset))
        if staged:
            folder = f"{self.root}/_staged/{table}/{uuid.uuid4().hex}"
            self._write(table, rows.write.partitionBy("dataset", *partition), folder)
            self._switch(table, folder)
            return
        bucketed = self.buckets is not None and table in BUCKETED
        if partition and table != "outputs" and not bucketed:
            rows = rows.hint("rebalance", *partition)
        self._overwrite(table, rows, ["dataset", *partition])

    def _overwrite(self, table: str, rows: DataFrame, partition: Sequence[str]) -> None:
        if self.buckets is not None and table in BUCKETED:
            self._overwrite_buckets(table, rows)
            return
        if self._by_call(table):
            raise ValueError(f"{table} is stored in buckets; the workspace needs their number")
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        self._write(table, writer.partitionBy(*partition), f"{self.root}/{table}")

    def _files(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _listed(self, pattern: str) -> list[str]:
        path, files = self._files(pattern)
        return [s.getPath().toString() for s in files.globStatus(path) or []]

    def _switch(self, table: str, folder: str) -> None:
        """Replace partitions by those of a complete staged folder, then drop the folder."""
        if self._listed(f"{folder}/dataset=*"):  # else it holds no rows
            rows = self.spark.read.option("inferSchema", "false").parquet(folder)
            levels = [part.split("=")[0] for part in self._first_leaf(folder)]
            self._overwrite(table, rows, levels)
        path, files = self._files(folder)
        files.delete(path, True)

    def _first_leaf(self, folder: str) -> list[str]:
        """Partition folders, as ``column=value``, from a folder down to its files."""
        below = [p for p in self._listed(f"{folder}/*=*")]
        return [below[0].rsplit("/", 1)[1], *self._first_leaf(below[0])] if below else []

    def drop(self, table: str, dataset: str) -> None:
        path, files = self._files(f"{self.root}/{table}/dataset={dataset}")
        files.delete(path, True)

    def recover(self) -> int:
        """Finish replacements that broke off; returns how many complete ones were found."""
        done = self._listed(f"{self.root}/_staged/*/*/_SUCCESS")
        for marker in done:
            folder = marker.rsplit("/", 1)[0]
            self._switch(folder.split("/")[-2], folder)
        return len(done)

    def group(self, model_group: str, prompt_group: str) -> tuple[list[str], list[Prompt]]:
        names = set(names_in(self.prompts, prompt_group.split(",")))
        chosen = [p for p in self.prompts if p.name in names]
        return names_in(self.models, model_group.split(",")), chosen

    def outputs(self, dataset: str, models: Sequence[str], prompts: Sequence[Prompt]) -> DataFrame:
        """Outputs of a group; every prompt must have every model."""
        names = [p.name for p in prompts]
        rows = self.read("outputs", dataset).where(
            F.col("model").isin(*models) & F.col("prompt").isin(*names)
        )
        if self._by_call("outputs"):
            calls = self._calls("outputs").items()
            present = {pair for (d, _call), pairs in calls if d == dataset for pair in pairs}
        else:  # the partition folders say which there are; no file is opened for it
            folders = self._listed(f"{self.root}/outputs/dataset={dataset}/prompt=*/model=*")
            present = {tuple(part.split("=", 1)[1] for part in f.split("/")[-2:]) for f in folders}
            present = {(unquote(p), unquote(m)) for p, m in present}
        missing = sorted({(p, m) for p in names for m in models} - present)
        if missing:
            raise ValueError(f"no outputs of {dataset} for (prompt, model) {missing}")
        return rows

    def save_prompts(self, records: Sequence[PromptRecord]) -> None:
        """Store the project's prompts with their messages and preprocessing, in place of others."""
        unknown = sorted({step for r in records for step in r.preprocessing} - set(STEPS))
        if unknown:
            raise ValueError(f"no preprocessing steps {unknown}")
        table = prompt_records_table(self.spark, records)
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/prompts")

    def prompt(self, name: str) -> PromptRecord:
        found = prompt_records(self.spark.read.parquet(f"{self.root}/prompts"))
        if name not in found:
            raise ValueError(f"no prompt {name} among {sorted(found)}")
        return found[name]

    def truth(self, dataset: str) -> DataFrame:
        return self.read("relabel_evaluation", dataset).select("id", "matches_original")


def prepared(items: DataFrame, prompt: Prompt) -> DataFrame:
    """Items after the preprocessing of a prompt record; a plain prompt has none."""
    for step in getattr(prompt, "preprocessing", ()):
        items = items.transform(STEPS[step])
    return items


def prompt_messages(items: DataFrame, prompt: PromptRecord) -> DataFrame:
    """``(id, messages)``: the prompt's messages for every item its preprocessing leaves."""
    return prepared(items, prompt).select("id", render_messages(prompt.templates).alias("messages"))


def run_generation(
    ws: Workspace,
    dataset: str,
    prompt: Prompt | str,
    model: str,
    templates: Sequence[MessageTemplate] | None,
    factory: Callable[[], generation.Generator],
    preprocess: Sequence[relational.Step] = (),
    filters: Sequence[relational.Step] = (),
    only_failed: bool = False,
    max_words: int | None = None,
    batch_size: int = 32,
    run: str | None = None,
) -> DataFrame:
    """Ask a model about every item, store its outputs, and return the over-long items.

    A prompt given by name is looked up among the project's stored ones; its messages stand in for
    ``templates``, and its preprocessing comes before ``preprocess``.

    Items a filter drops, over-long ones and final failures get a NULL output, so that every
    item has a row. ``only_failed`` asks again only where the stored output is invalid. With the
    name of a ``run`` answers are committed in parts as they come, and the same call after a break
    asks only about the rest; they go once the outputs are stored.
    """
    prompt = ws.prompt(prompt) if isinstance(prompt, str) else prompt
    templates = prompt.templates if templates is None else templates
    every = ws.read("items", dataset)
    items, kept = every, every.select("id", F.lit(None).cast("string").alias("kept"))
    if only_failed:
        stored = ws.read("outputs", dataset).where(
            (F.col("prompt") == prompt.name) & (F.col("model") == model)
        ).select("id", "output")
        items, _orphans = relational.invalid_rerun_set(items, stored, F.lit(prompt.family))
        kept = every.select("id").join(stored.withColumnRenamed("output", "kept"), "id", "left")
    items = prepared(items, prompt)
    for step in (*preprocess, *filters):
        items = items.transform(step)
    chats = items.select("id", render_messages(templates).alias("messages"))
    prompts = chats.withColumn("prompt_text", chat_text(F.col("messages")))
    skipped = prompts.select("id").limit(0).withColumn("n_words", F.lit(0))
    if max_words is not None:
        prompts, skipped = relational.over_long(prompts, "prompt_text", max_words)
    valid = lambda output: is_valid_output(F.lit(prompt.family), output)
    chats = prompts.select("id", "messages")
    folder = f"{ws.root}/_generation/{dataset}/{prompt.name}/{model}/{run}"
    if run is None:
        answers = generation.generate_with_retries(chats, factory, valid, batch_size=batch_size)
    else:
        rounds = generation.StoredRounds(ws.spark, folder)
        answers = generation.generate_resumably(chats, factory, valid, rounds, batch_size=batch_size)
    broken = answers.agg(
        F.count(F.lit(1)).alias("asked"), F.count_if(F.col("failures") == F.col("attempts")).alias("n")
    ).first()
    if broken.asked and broken.n == broken.asked:
        raise RuntimeError(f"the generator of {model} raised for all {broken.n} items")
    asked = answers.select("id", "output", F.lit(True).alias("asked"))
    rows = kept.join(asked, "id", "left").select(
        "id",
        F.when(F.col("asked"), F.col("output")).otherwise(F.col("kept")).alias("output"),
        F.lit(prompt.name).alias("prompt"),
        F.lit(model).alias("model"),
    )
    ws.store("outputs", rows, dataset, "prompt", "model", staged=only_failed)
    if run is not None:
        path, files = ws._files(folder)
        files.delete(path, True)
    return skipped


def store_scores(
    ws: Workspace, dataset: str, rows: DataFrame, method: Column | str,
    prompt_group: str = "", model_group: str = "", eval_method: str = "", run_id: str = "",
    no_nan: bool = False,
) -> None:
    """Store ``(id, score)`` rows, one partition per score name."""
    method = F.lit(method) if isinstance(method, str) else method
    keys = {
        "method": method, "prompt_group": F.lit(prompt_group), "model_group": F.lit(model_group),
        "eval_method": F.lit(eval_method), "run_id": F.lit(run_id), "no_nan": F.lit(no_nan),
    }
    named = rows.withColumns(keys).withColumn(
        "score_name", relational.score_name(*[F.col(k) for k in keys])
    )
    columns = ["id", *keys, F.col("score").cast("double").alias("score"), "score_name"]
    ws.store("scores", named.select(*columns), dataset, "score_name")


def aggregate_votes(
    ws: Workspace, dataset: str, model_group: str, prompt_group: str, strict: bool = False,
    compat: bool = False,
) -> None:
    """Outputs to verdicts, votes per prompt and merged vote scores of a group."""
    models, prompts = ws.group(model_group, prompt_group)
    outputs = ws.outputs(dataset, models, prompts)
    judged = votes.verdicts(
        outputs, prompts, ws.read("items", dataset)
    )
    ws.store("verdicts", judged, dataset, "prompt", "model")
    chosen = ws.read("verdicts", dataset).where(
        F.col("model").isin(*models) & F.col("prompt").isin(*[p.name for p in prompts])
    )
    per_prompt = votes.prompt_votes(chosen, strict).withColumn(
        "vote_group", F.lit(f"{prompt_group}-{model_group}")
    )
    ws.store("prompt_votes", per_prompt, dataset, "vote_group")
    merged = votes.merge_prompts_grouped(
        ws.read("prompt_votes", dataset).where(F.col("vote_group") == f"{prompt_group}-{model_group}"),
        strict, compat,
    )
    rows = merged.select("id", *[F.col(m).cast("double").alias(m) for m in VOTE_METHODS]).unpivot(
        "id", list(VOTE_METHODS), "m", "score"
    )
    store_scores(
        ws, dataset, rows, F.col("m"), prompt_group, model_group, no_nan=strict
    )


def _matrix(ws: Workspace, dataset: str, model_group: str, prompt_group: str, eval_method: str):
    models, prompts = ws.group(model_group, prompt_group)
    rows = features.feature_rows(
        ws.outputs(dataset, models, prompts), prompts, ws.read("items", dataset), eval_method,
    )
    names = features.feature_names(prompts, models, eval_method)
    return names, rows


def _classifier_path(ws: Workspace, kind, model_group, prompt_group, eval_method, run_id) -> str:
    return learned.model_path(
        f"{ws.root}/classifiers", kind, model_group, prompt_group, eval_method, run_id
    )


def train_classifier(
    ws: Workspace, dataset: str, kind: str, model_group: str, prompt_group: str,
    eval_method: str, run_id: str, **options,
) -> list[tuple[int, float]]:
    """Fit ``random_forest`` or ``mlp`` on the labelled items and store the model."""
    names, rows = _matrix(ws, dataset, model_group, prompt_group, eval_method)
    matrix = features.feature_matrix(rows, names, ws.truth(dataset)).persist()
    try:
        train = {"random_forest": learned.train_forest, "mlp": learned.train_perceptron}[kind]
        model, runs = train(matrix, names, **options)
    finally:
        matrix.unpersist()
    learned.save_model(
        model, _classifier_path(ws, kind, model_group, prompt_group, eval_method, run_id)
    )
    rows = ws.spark.createDataFrame(
        [(kind, f"{model_group}_{prompt_group}_{eval_method}", r, f1) for r, f1 in runs],
        "kind string, features string, run int, score double",
    )
    ws.store("training_runs", rows.withColumn("run_id", F.lit(run_id)), dataset, "run_id")
    return runs


def training_summary(ws: Workspace, dataset: str) -> DataFrame:
    """Best round and mean hold-out F1 of every stored training run."""
    return metrics.best_and_mean_run(
        ws.read("training_runs", dataset), by=["kind", "features", "run_id"]
    )


def score_with_classifier(
    ws: Workspace, dataset: str, kind: str, model_group: str, prompt_group: str,
    eval_method: str, run_id: str,
) -> None:
    names, rows = _matrix(ws, dataset, model_group, prompt_group, eval_method)
    model = learned.load_model(
        _classifier_path(ws, kind, model_group, prompt_group, eval_method, run_id)
    )
    store_scores(
        ws, dataset, learned.score(model, features.feature_matrix(rows, names)), kind,
        prompt_group, model_group, eval_method, run_id,
    )


def add_random_baseline(ws: Workspace, dataset: str, seed: int = 42) -> None:
    rows = sampling.random_baseline(ws.read("items", dataset).select("id"), seed=seed)
    store_scores(ws, dataset, rows.withColumnRenamed("baseline_random", "score"), "baseline_random")


def add_loss_baselines(ws: Workspace, dataset: str, losses: DataFrame) -> None:
    """Scores from ``(id, method, loss)`` rows, stored as ``baseline_<method>``."""
    rows = metrics.invert_losses(losses).withColumn(
        "baseline", F.concat(F.lit("baseline_"), "method")
    )
    store_scores(ws, dataset, rows.select("id", "baseline", "score"), F.col("baseline"))


def compared_scores(
    ws: Workspace, dataset: str, names: Sequence[str], complete: bool = False
) -> DataFrame:
    """``(curve, id, score)`` of the named scores; ``complete`` keeps ids all of them have."""
    rows = (
        ws.read("scores", dataset)
        .where(F.col("score_name").isin(*names))
        .select(F.col("score_name").alias("curve"), "id", "score")
    )
    return relational.complete_rows(rows, names) if complete else rows


def evaluate_auc_pr(
    ws: Workspace, dataset: str, names: Sequence[str], complete: bool = False
) -> DataFrame:
    rows = compared_scores(ws, dataset, names, complete)
    return curves.auc_pr(curves.curve_rows(rows, ws.truth(dataset)))


def evaluate_f1_ranking(ws: Workspace, dataset: str, names: Sequence[str]) -> DataFrame:
    return curves.f1_summary(
        curves.f1_sweep(compared_scores(ws, dataset, names), ws.truth(dataset))
    )


def evaluate_f1_at(
    ws: Workspace, dataset: str, names: Sequence[str], threshold: float = 0.5
) -> DataFrame:
    return metrics.f1_at(compared_scores(ws, dataset, names), ws.truth(dataset), threshold)


def search_ensembles(
    ws: Workspace, dataset: str, model_groups: str, prompt_groups: str
) -> dict[str, DataFrame]:
    """Vote metrics, best thresholds, thresholds at one half, areas and best subsets."""
    models, prompts = ws.group(model_groups, prompt_groups)
    names = [p.name for p in prompts]
    verdict_rows = ws.read("verdicts", dataset).where(
        F.col("model").isin(*models) & F.col("prompt").isin(*names)
    )
    found = search.subset_votes(verdict_rows, ws.truth(dataset), models, names)
    profile = materialise(search.subset_profile(found))  # its size does not grow with the items
    sweep = search.subset_sweep(profile)
    measured = search.subset_vote_metrics(profile)
    results = {
        "votes": measured,
        "best_threshold": curves.best_threshold(sweep, search.MASKS),
        "at_half": curves.at_half(sweep),
        "auc_pr": search.subset_auc_pr(verdict_rows, ws.truth(dataset), models, names),
        "best": search.best_subsets(measured),
    }
    return {k: search.named(df, models, names) for k, df in results.items()}


def count_missing(
    ws: Workspace, dataset: str, model_groups: str, prompt_groups: str
) -> DataFrame:
    models, prompts = ws.group(model_groups, prompt_groups)
    rows = ws.read("verdicts", dataset).where(
        F.col("model").isin(*models) & F.col("prompt").isin(*[p.name for p in prompts])
    )
    return votes.missing_counts(rows)


def correctness(ws: Workspace, dataset: str | None = None) -> DataFrame:
    rows = ws.read("relabel_evaluation")
    return metrics.match_rate(rows if dataset is None else rows.where(F.col("dataset") == dataset))


def import_relabeled(
    ws: Workspace, dataset: str, folder: str, annotator: str | Sequence[str] | None = None,
    partitioned: bool = False,
) -> None:
    """Annotation folders to the re-annotated table, under the annotator's name.

    With a list the rows stand under the joined names; ``chosen_annotator`` says whose file it was.
    ``partitioned`` says that the folders are those of ``write_annotation_files``.
    """
    found = opened_once(read_annotation_files(ws.spark, folder, partitioned))
    files = choose_annotator(found, annotator)
    name = annotator if isinstance(annotator, str) else "-".join(annotator or ["curated"])
    chosen = files.select("id", F.col("annotator").alias("chosen_annotator"))
    rows = annotations.import_annotations(files).join(chosen, "id").withColumn(
        "annotator", F.lit(name)
    )
    ws.store("relabeled", rows, dataset, "annotator")


def evaluate_relabeled(
    ws: Workspace, dataset: str, annotator: str, reviews: DataFrame | None = None,
    redo: bool = False, first: bool = False,
) -> DataFrame:
    """Compare re-annotations with the original labels, store the rows, return the share.

    ``first`` says that there is no earlier evaluation to take over.
    """
    relabeled = ws.read("relabeled", dataset).where(F.col("annotator") == annotator)
    prior = None if first else ws.read("relabel_evaluation", dataset)
    rows = agreement.evaluate_relabeling(
        relabeled, ws.read("items", dataset), prior, reviews, redo
    )
    ws.store("relabel_evaluation", rows, dataset, staged=not first)
    return agreement.matched_share(ws.read("relabel_evaluation", dataset))


def compare_annotators(ws: Workspace, dataset: str, first: str, second: str) -> DataFrame:
    rows = ws.read("relabeled", dataset).withColumn(
        "other_texts", F.transform("other_labels", lambda o: o["text"])
    )
    pairs = agreement.annotator_pairs(rows, first, second)
    return agreement.annotator_agreement(agreement.pair_scores(pairs))


def prediction_quality(
    ws: Workspace, dataset: str, model_group: str, prompt: Prompt, annotator: str | None = None
) -> DataFrame:
    """Exact match and F1 per model, against the original or an annotator's labels."""
    models = names_in(ws.models, model_group.split(","))
    answers = votes.parse_outputs(
        ws.outputs(dataset, models, [prompt]), [prompt]
    )
    if annotator is None:
        return agreement.prediction_scores(answers, ws.read("items", dataset))
    truth = ws.read("relabeled", dataset).where(F.col("annotator") == annotator)
    return agreement.relabeled_prediction_scores(answers, truth)


def sample_uncertain(ws: Workspace, dataset: str, score_name: str, n: int, run_id: str) -> None:
    """Store the n most uncertain items nobody has labelled yet."""
    rows = compared_scores(ws, dataset, [score_name]).select("id", "score")
    sample = sampling.most_uncertain(rows, ws.truth(dataset), n)
    ws.store(
        "al_samples", sample.withColumnsRenamed({"distance_from_0.5": "distance"}).withColumn("run_id", F.lit(run_id)),
        dataset, "run_id",
    )


def move_sampled(ws: Workspace, dataset: str, kept_as: str, moved_as: str) -> None:
    """Split the evaluated rows by whether a sample asked for them, under two names.

    Either name may be the dataset's own: both sides are staged before a partition is replaced.
    A side without rows leaves the partition of its name as it was, unless that is the dataset's
    own, which must not keep rows that have moved.
    """
    rows = relational.split_by_ids(
        ws.read("relabel_evaluation", dataset), ws.read("al_samples", dataset)
    )
    target = F.when(F.col("moved"), moved_as).otherwise(kept_as)
    rows = materialise(rows.withColumn("dataset", target).drop("moved"))
    ws.store("relabel_evaluation", rows, None, staged=True)
    if dataset in (kept_as, moved_as) and rows.where(F.col("dataset") == dataset).isEmpty():
        ws.drop("relabel_evaluation", dataset)  # all rows went to the other name


def finetuning_rows(
    ws: Workspace, dataset: str, template: MessageTemplate | None, prompt: Prompt | str,
    score_name: str | None = None, threshold: float | None = None,
    preferred_model: str | None = None,
) -> DataFrame:
    """``(id, input, output)`` rows of a project's stored tables.

    With a score only confident items; with a preferred model the raw output of the first
    correct model, that one being asked first, instead of the original label. A prompt given by name
    is looked up among the stored ones: its last message is the template where none is given, and its
    preprocessing is applied to the items.
    """
    prompt = ws.prompt(prompt) if isinstance(prompt, str) else prompt
    template = prompt.templates[-1] if template is None else template
    scores = None if score_name is None else compared_scores(ws, dataset, [score_name])
    reasoning = None
    if preferred_model is not None:
        order = [preferred_model] + [m.name for m in ws.models if m.name != preferred_model]
        of_prompt = F.col("prompt") == prompt.name
        reasoning = (
            ws.read("verdicts", dataset).where(of_prompt),
            ws.by_id("outputs", dataset).where(of_prompt),
            order,
        )
    items = prepared(ws.by_id("items", dataset), prompt)
    return sampling.finetune_rows(
        items, template, scores, "score", threshold, reasoning, ws.buckets
    )


def build_finetuning(
    ws: Workspace, dataset: str, template: MessageTemplate | None, prompt: Prompt | str,
    score_name: str | None = None, threshold: float | None = None,
    preferred_model: str | None = None,
) -> None:
    """Store the rows of ``finetuning_rows``."""
    rows = finetuning_rows(ws, dataset, template, prompt, score_name, threshold, preferred_model)
    name = prompt if isinstance(prompt, str) else prompt.name
    ws.store("finetune", rows.withColumn("prompt", F.lit(name)), dataset, "prompt")
