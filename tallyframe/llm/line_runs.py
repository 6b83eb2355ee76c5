"""Line dedup by levelled sorted runs of line hashes.

A run holds one row per line key, hash-dealt and sorted by key: in how many documents the key was
found and the largest of them. Each new batch of documents is merge-joined with the runs that
exist: keys none of them knows (the anti-join) become the batch's own run, keys already known are
kept apart as additions to older runs. Whenever a level holds ``fanout`` runs they are compacted
into one run of the next level, so a key is rewritten only once per level. Runs are checkpointed
with their partitioning and order, so later merges shuffle the new batch alone.
"""

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.shared import map_rows
from tallyframe.session import materialise


def _totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("digest").agg(F.sum("n").alias("n"), F.max("top").alias("top"))


def line_key(line: bytes) -> bytes:
    """A line without [\\x20\\x09-\\x0D] at its ends and with A-Z lower-cased."""
    return line.strip().lower()


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= 4 * min_chars or (
        len(key) >= min_chars and len(key.decode("utf-8", "replace")) >= min_chars
    )


def line_digests(documents: DataFrame, min_chars: int) -> DataFrame:
    """Distinct keys of each document's lines: (digest, doc_id). Shorter keys are left out."""

    def make():
        def work(batch):
            out = {"digest": [], "doc_id": []}
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                keys = {line_key(line) for line in (text or "").encode().split(b"\n")}
                found = [_digest(k) for k in keys if _long_enough(k, min_chars)]
                out["digest"] += found
                out["doc_id"] += [doc_id] * len(found)
            return out

        return work

    return map_rows(documents.select("doc_id", "text"), "digest binary, doc_id bigint", make)


class LineRuns:
    """Statistics of line keys over all batches added so far."""

    def __init__(self, fanout: int = 3):
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []
        self.known: DataFrame | None = None  # additions to keys of earlier batches

    def _sorted_run(self, counts: DataFrame) -> DataFrame:
        """Written out in the order it was grouped in: dealt and sorted by key."""
        return materialise(counts.sortWithinPartitions("digest"))

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, lines: DataFrame) -> None:
        """Merge one batch of (digest, doc_id) rows, each row one document holding the line."""
        fresh = materialise(
            lines.groupBy("digest").agg(
                F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top")
            )
        )
        for run in self.runs():
            again = fresh.join(run.select("digest"), "digest", "left_semi")
            self.known = again if self.known is None else self.known.unionByName(again)
        for run in self.runs():
            fresh = fresh.join(run.select("digest"), "digest", "left_anti")
        self._put(0, self._sorted_run(fresh))

    def _put(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            self._put_merged(level)

    def _put_merged(self, level: int) -> None:
        merged = self.levels[level][0]
        for run in self.levels[level][1:]:
            merged = merged.unionByName(run)
        self.levels[level] = []
        self._put(level + 1, self._sorted_run(_totals(merged)))

    def counts(self) -> DataFrame | None:
        """(digest, n, top) over all batches; None before the first batch."""
        rows = None
        for run in [*self.runs(), *([self.known] if self.known is not None else [])]:
            rows = run if rows is None else rows.unionByName(run)
        return None if rows is None else _totals(rows)


def repeated_lines(
    documents: DataFrame,
    min_chars: int = 20,
    min_documents: int = 3,
    batches: int = 4,
    fanout: int = 3,
) -> DataFrame:
    """Lines to drop: (doc_id, digest) of keys found in ``min_documents`` documents or more, but
    for the largest doc_id holding the key."""
    lines = materialise(
        line_digests(documents, min_chars).withColumn(
            "batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches))
        )
    )
    index = LineRuns(fanout)
    for batch in range(batches):
        index.add(lines.where(F.col("batch") == batch).select("digest", "doc_id"))
    often = materialise(index.counts().where(F.col("n") >= min_documents).select("digest", "top"))
    return lines.join(often, "digest").where(~F.col("doc_id").eqNullSafe(F.col("top"))).select(
        "doc_id", "digest"
    )


def _decided(documents: DataFrame, **parameters) -> DataFrame:
    """Every row as ``row_`` with its new text, its numbers of lines and the new text's digest."""
    dropped = (
        repeated_lines(documents, **parameters)
        .groupBy("doc_id")
        .agg(F.collect_set("digest").alias("dropped_"))
        .withColumnRenamed("doc_id", "id_")
    )
    joined = documents.select(F.struct("*").alias("row_"), "doc_id", "text").join(
        dropped, F.col("doc_id") == F.col("id_"), "left"
    )

    def make():
        def work(batch):
            out = {"row_": batch["row_"], "kept_": [], "n_lines": [], "n_dropped": []}
            out["kept_sha256"] = []
            for text, digests in zip(batch["text"].to_pylist(), batch["dropped_"].to_pylist()):
                lines = (text or "").encode().split(b"\n")
                kept = lines
                if digests:
                    gone = set(digests)
                    kept = [x for x in lines if _digest(line_key(x)) not in gone]
                joined_text = b"\n".join(kept)
                out["kept_"].append(None if text is None else joined_text.decode())
                out["n_lines"].append(len(lines))
                out["n_dropped"].append(len(lines) - len(kept))
                out["kept_sha256"].append(hashlib.sha256(joined_text).hexdigest())
            return out

        return work

    row_type = documents.schema.simpleString()
    return map_rows(
        joined.select("row_", "text", "dropped_"),
        f"row_ {row_type}, kept_ string, n_lines bigint, n_dropped bigint, kept_sha256 string",
        make,
    )


def line_decisions(documents: DataFrame, **parameters) -> DataFrame:
    """One row per document: doc_id, ``n_lines`` before, ``n_dropped`` and ``kept_sha256``, the
    digest of the new text's UTF-8 bytes. See ``drop_repeated_lines``."""
    return _decided(documents.select("doc_id", "text"), **parameters).select(
        "row_.doc_id", "n_lines", "n_dropped", "kept_sha256"
    )


def drop_repeated_lines(documents: DataFrame, **parameters) -> DataFrame:
    """Documents with their repeated lines taken out of ``text``; all other columns as they are.

    Parameters are those of ``repeated_lines``. Text splits at \\n; a null or empty text is one
    empty line, and a null stays null. Lines whose key is shorter than ``min_chars`` code points
    always stay, and so does a document that loses all its lines, with an empty text. Rows that
    repeat a doc_id count as one document each and share its decisions: a line goes from all of
    them or from none. Rows without a doc_id keep their lines if the id found largest is theirs.
    """
    done = _decided(documents, **parameters)
    return done.select(
        *[
            F.col("kept_").alias("text") if c == "text" else F.col(f"row_.`{c}`").alias(c)
            for c in documents.columns
        ]
    )
