"""Passages that repeat across documents, by hashing the units of every text.

Every line and every paragraph of a text is a unit, whatever its size. Lines alone are too coarse:
passages get pasted into the middle of lines, so that the lines around them differ. Every text is
therefore cut a second time, into small units of a few words at places that depend on the words
around them only (a word pair whose hash is the smallest of its neighbourhood), so the same passage
is cut alike wherever it stands. A unit's words, lower-cased and without punctuation, are digested,
digests are grouped over all documents, the occurrence in the smallest doc_id (there, the first) is
kept, and the other ones are removed: lines and paragraphs always, small units where neighbouring
repeated ones come to ``min_words`` words. Offsets are those of the original text.
"""

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.shared import BYTE_CODES, SpanHasher, map_rows, mix64
from tallyframe.session import materialise

UNITS = (
    "doc_id bigint, block boolean, digest bigint, first int, start int, end int, n_words int, "
    "again boolean"
)

# Turns the digest of words into that of a line or paragraph, which small units do not match.
_BLOCK = np.uint64(0xD6E8FEB86659FD93)

# Letters, digits and all bytes beyond ASCII make up words; A-Z count as a-z.
_WORD = np.array(
    [chr(b).isalnum() if b < 128 else True for b in range(256)], bool
)
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def _small(words: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of a text's small units, and the words after their last ones."""
    n = len(words)
    pairs = mix64(words ^ (np.concatenate((words[1:], words[:1])) * np.uint64(3)))
    # a word starts a unit if its pair is strictly the smallest within reach on both sides
    lowest = np.ones(n, bool)
    for d in range(1, reach + 1):
        lowest[d:] &= pairs[d:] < pairs[:-d]
        lowest[:-d] &= pairs[:-d] < pairs[d:]
    lowest[0] = True
    first = np.flatnonzero(lowest)
    return first, np.concatenate((first[1:], [n]))


def _blocks(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of its lines and paragraphs, from the line number of each word.

    Lines without a word set paragraphs apart. A line of one word counts if it is a paragraph; inside
    a longer one it is a word. A line that is a paragraph is listed once.
    """
    n = len(line)
    step = np.diff(line)
    found = []
    for gap, least in ((1, 2), (2, 1)):
        first = np.concatenate(([0], np.flatnonzero(step >= gap) + 1))
        last = np.concatenate((first[1:], [n]))
        found.append((first * (n + 1) + last)[last - first >= least])
    return np.divmod(np.unique(np.concatenate(found)), n + 1)


def cut_units(hasher: SpanHasher, text: str, reach: int):
    """Small units of a text, then its lines and paragraphs: whether they are the latter, digests,
    numbers of the first words, starts and ends in code points, and numbers of words."""
    codes = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.concatenate(([False], _WORD[codes], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return None
    words = hasher.spans(hasher.sums(BYTE_CODES[_FOLD[codes]]), starts, ends)
    small = _small(words, reach)
    blocks = _blocks(np.cumsum(codes == 10)[starts])
    first, last = (np.concatenate(both) for both in zip(small, blocks))
    block = np.arange(len(first)) >= len(small[0])
    digests = hasher.spans(hasher.sums(words), first, last)
    digests = np.where(block, mix64(digests ^ _BLOCK), digests)
    points = np.concatenate(([0], np.cumsum((codes & 0xC0) != 0x80)))
    return block, digests, first, points[starts[first]], points[ends[last - 1]], last - first


def units(documents: DataFrame, reach: int) -> DataFrame:
    """The units of every text; ``again`` marks those that the same text has held before."""

    def make():
        hasher = SpanHasher()
        names = [f.split()[0] for f in UNITS.split(", ")]
        kinds = (np.int64, bool, np.int64, np.int32, np.int32, np.int32, np.int32, bool)

        def work(batch):
            parts = [[np.zeros(0, kind)] for kind in kinds]
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                cut = cut_units(hasher, text, reach) if text and doc_id is not None else None
                if cut is None:
                    continue
                block, digests, *places = cut
                again = np.ones(len(digests), bool)
                again[np.unique(digests, return_index=True)[1]] = False
                values = (
                    np.full(len(block), doc_id), block, digests.view(np.int64), *places, again
                )
                for part, value, kind in zip(parts, values, kinds):
                    part.append(value.astype(kind))
            return {name: np.concatenate(part) for name, part in zip(names, parts)}

        return work

    return map_rows(documents.select("doc_id", "text"), UNITS, make)


def repeated_passages(
    documents: DataFrame, min_words: int = 20, reach: int = 3
) -> DataFrame:
    """Spans to remove: (doc_id, start, end, n_words, kept_doc_id), offsets in code points.

    Lines and paragraphs that repeat go whatever their size, each occurrence but the first in the
    smallest document. A passage inside a line loses at most about two small units at each end to
    its surroundings, and goes if ``min_words`` words are left: of 50 words practically all are found,
    of fewer only some. ``kept_doc_id`` is the smallest document holding the first unit of the span.
    Repeats within a document go as well. Spans of a document neither touch nor overlap. Null or
    empty texts and rows without a doc_id have no units; rows that repeat a doc_id count as one
    document.
    """
    found = materialise(units(documents, reach))
    held = (
        found.where(~F.col("again"))
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("kept_doc_id"))
        .where(F.col("n") > 1)
        .select("digest", "kept_doc_id")
    )
    columns = ["doc_id", "block", "first", "start", "end", "n_words", "kept_doc_id"]
    elsewhere = (
        found.where(~F.col("again"))
        .join(held, "digest")
        .where(F.col("doc_id") != F.col("kept_doc_id"))
        .select(columns)
    )
    within = found.where("again").withColumn("kept_doc_id", F.col("doc_id")).select(columns)
    repeated = elsewhere.unionByName(within).repartition("doc_id").distinct()
    # small units come first, a run of them for as long as each starts where the last one ended;
    # every line and paragraph is a run of its own
    order = Window.partitionBy("doc_id").orderBy("block", "first", "n_words")
    ended = F.lag(F.col("first") + F.col("n_words")).over(order)
    opens = F.col("block") | ended.isNull() | (ended != F.col("first"))
    runs = (
        repeated.withColumn("opens", opens.cast("int"))
        .withColumn("run", F.sum("opens").over(order))
        .groupBy("doc_id", "run", "block")
        .agg(
            F.min("first").alias("first"),
            F.max(F.col("first") + F.col("n_words")).alias("last"),
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.min_by("kept_doc_id", "first").alias("kept_doc_id"),
        )
        .where(F.col("block") | (F.col("last") - F.col("first") >= min_words))
    )
    # what overlaps or touches is one span
    along = Window.partitionBy("doc_id").orderBy("first", "last", "block")
    reached = F.max("last").over(along.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(reached < F.col("first"), F.lit(True))
    return (
        runs.withColumn("apart", apart.cast("int"))
        .withColumn("span", F.sum("apart").over(along))
        .groupBy("doc_id", "span")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            (F.max("last") - F.min("first")).alias("n_words"),
            F.min(F.struct("first", -F.col("last"), "kept_doc_id")).alias("head"),
        )
        .select(
            "doc_id", "start", "end", F.col("n_words").cast("bigint"),
            F.col("head.kept_doc_id").alias("kept_doc_id"),
        )
    )


def drop_passages(documents: DataFrame, min_words: int = 20, reach: int = 3) -> DataFrame:
    """Documents with repeated passages cut out of ``text`` and the ``removed`` spans beside it,
    as (start, end) in the original text; all other columns as they are."""
    spans = (
        repeated_passages(documents, min_words, reach)
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("removed_"))
        .withColumnRenamed("doc_id", "id_")
    )
    joined = documents.select(F.struct("*").alias("row_"), "doc_id", "text").join(
        spans, F.col("doc_id") == F.col("id_"), "left"
    )
    removed = F.coalesce("removed_", F.array().cast("array<struct<start:int,end:int>>"))
    # what stays are the stretches between one span's end and the next one's start
    starts = F.concat(F.array(F.lit(0)), F.transform(removed, lambda s: s["end"]))
    ends = F.concat(F.transform(removed, lambda s: s["start"]), F.array(F.length("text")))
    kept = F.concat_ws(
        "",
        F.transform(
            F.arrays_zip(starts.alias("a"), ends.alias("b")),
            lambda s: F.substring(F.col("text"), s["a"] + 1, s["b"] - s["a"]),
        ),
    )
    columns = [
        F.when(F.col("text").isNotNull(), kept).alias("text") if c == "text" else F.col(f"row_.`{c}`").alias(c)
        for c in documents.columns
    ]
    return joined.select(*columns, removed.alias("removed"))
