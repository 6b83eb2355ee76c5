"""Alignment of the tokens that two tokenizers make of the same text.

A token is known by the byte offset at which it ends. Offsets where tokens of both sides end cut a
text into groups: the list of fewer ends drives, and each of its ends is sought in the longer list by
a galloping search (steps that double from a guess, then binary search between the last two probes).
The ranks of the common ends in the two lists, and the differences of neighbouring ranks, say which
tokens of either side share a group. All texts of a batch search in step, on whole arrays.

Tokens sharing a group are linked. How many documents hold an id pair linked is counted over the
corpus: pairs are made distinct in the task, counted with map-side combining, and met again by the
documents on the packed pair. A hot pair is one row of the counts; the documents' side of that join
is split by adaptive execution where it is not a broadcast.
"""

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.shared import map_rows
from tallyframe.llm.tokens import TokenSide
from tallyframe.session import materialise

# A pair is packed as A id * 2^PAIR_BITS + B id.
PAIR_BITS = 24
# Texts are aligned together up to so many bytes; a longer text is aligned alone.
BATCH_BYTES = 1 << 20
# Groups of up to so many links are written out; of larger ones the distinct ids are paired.
PLAIN_LINKS = 64
# Pair counts are hinted as broadcast up to so many rows of two numbers and a flag (some 50 MB as a
# hash table); beyond, the join is left to adaptive execution.
BROADCAST_PAIRS = 1_000_000

PROFILE = (
    "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
    "groups_sha256 string, pairs array<bigint>, links array<bigint>"
)
ALIGNED = (
    "doc_id bigint, a_ids array<int>, b_ids array<int>, a_until array<int>, b_until array<int>, "
    "bytes_until array<bigint>"
)


def gallop(
    values: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray, guess: np.ndarray
) -> np.ndarray:
    """For each value the lowest place in ``ends[first..last]`` whose entry is not below it.

    ``ends`` rises within each range and its entry at ``last`` is not below the value. From its
    guess every value walks up or down in doubling steps until it is passed, then halves the span.
    """
    low, high = first - 1, last.copy()
    up = ends[guess] < values
    low[up], high[~up] = guess[up], guess[~up]
    open_, step = np.arange(len(values)), 1
    while len(open_):
        probe = guess[open_] + np.where(up[open_], step, -step)
        inside = (probe > low[open_]) & (probe < high[open_])
        open_, probe = open_[inside], probe[inside]
        below = ends[probe] < values[open_]
        low[open_[below]], high[open_[~below]] = probe[below], probe[~below]
        open_ = open_[below == up[open_]]
        step *= 2
    open_ = np.flatnonzero(high - low > 1)
    while len(open_):
        middle = (low[open_] + high[open_]) // 2
        below = ends[middle] < values[open_]
        low[open_[below]], high[open_[~below]] = middle[below], middle[~below]
        open_ = open_[high[open_] - low[open_] > 1]
    return high


def _until(counts: np.ndarray) -> np.ndarray:
    """Running totals with a leading zero."""
    return np.concatenate((np.zeros(1, np.int64), np.cumsum(counts, dtype=np.int64)))


@dataclass
class Aligned:
    """Texts of a batch, one after the other: ids, groups and where each text's part begins."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    a_from: np.ndarray  # per text and one more: first token of A
    b_from: np.ndarray
    groups_from: np.ndarray  # per text and one more: first group
    a_until: np.ndarray  # per group: tokens of A in the batch up to its end
    b_until: np.ndarray
    bytes_until: np.ndarray  # per group: byte offset of its end in its own text

    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        return np.diff(self.a_until, prepend=0), np.diff(self.b_until, prepend=0)


def align_texts(texts: list[str | None], a: TokenSide, b: TokenSide) -> Aligned:
    """Align whole texts. A text that is null or empty, or whose tokens of either side do not join
    to a space and the text, has no tokens."""
    a_lists, b_lists = a.encode([f" {t or ''}" for t in texts]), b.encode([t or "" for t in texts])
    for i, text in enumerate(texts):
        whole = f" {text}".encode("utf-8", "surrogatepass") if text else None
        if not text or a.joined(a_lists[i]) != whole or b.joined(b_lists[i]) != whole:
            a_lists[i] = b_lists[i] = ()
    a_from, b_from = (_until([len(ids) for ids in lists]) for lists in (a_lists, b_lists))
    a_ids, b_ids = (
        np.fromiter((i for ids in lists for i in ids), np.int64, int(start[-1]))
        for lists, start in ((a_lists, a_from), (b_lists, b_from))
    )
    # both sides join to the same bytes, so running ends of the batch agree at the ends of texts
    a_ends, b_ends = np.cumsum(a.sizes[a_ids]), np.cumsum(b.sizes[b_ids])
    ends = np.concatenate((a_ends, b_ends))
    a_count, b_count = np.diff(a_from), np.diff(b_from)
    a_drives = a_count <= b_count
    drive_from = np.where(a_drives, a_from[:-1], len(a_ends) + b_from[:-1])
    drive_count = np.minimum(a_count, b_count)
    seek_from = np.where(a_drives, len(a_ends) + b_from[:-1], a_from[:-1])
    seek_count = np.maximum(a_count, b_count)

    text_of = np.repeat(np.arange(len(texts)), drive_count)
    rank = np.arange(len(text_of)) - np.repeat(_until(drive_count)[:-1], drive_count)
    values = ends[drive_from[text_of] + rank]
    first, count = seek_from[text_of], seek_count[text_of]
    guess = first + rank * count // np.maximum(drive_count[text_of], 1)
    found = gallop(values, ends, first, first + count - 1, guess)
    common = np.flatnonzero(ends[found] == values)
    text_of, found = text_of[common], found[common] - first[common]
    rank = rank[common]
    a_until = a_from[text_of] + np.where(a_drives[text_of], rank, found) + 1
    b_until = b_from[text_of] + np.where(a_drives[text_of], found, rank) + 1
    before = np.concatenate((np.zeros(1, np.int64), a_ends))[a_from[:-1]]
    return Aligned(
        a_ids, b_ids, a_from, b_from,
        _until(np.bincount(text_of, minlength=len(texts))),
        a_until, b_until, values[common] - before[text_of],
    )


def group_texts(found: Aligned, a: TokenSide, b: TokenSide) -> list[str]:
    """Groups of every text as ``a1,a2|b1;a3|b2,b3``; no groups, an empty string."""
    a_size, b_size = found.sizes()
    words = np.empty(len(found.a_ids) + len(found.b_ids), object)
    # tokens of A stand behind those of B of earlier groups, tokens of B behind A's of their own too
    for ids, until, size, ahead, inner, outer in (
        (found.a_ids, found.a_until, a_size, found.b_until - b_size, a.written(","), a.written("|")),
        (found.b_ids, found.b_until, b_size, found.a_until, b.written(","), b.written(";")),
    ):
        last = np.zeros(len(ids), bool)
        last[until - 1] = True
        at = np.arange(len(ids)) + np.repeat(ahead, size)
        words[at] = np.where(last, outer[ids], inner[ids])
    starts = found.a_from + found.b_from
    words = words.tolist()
    return ["".join(words[i:j])[:-1] for i, j in zip(starts[:-1].tolist(), starts[1:].tolist())]


def linked_pairs(found: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct id pairs of every text: places per text and one more, packed pairs, links of each,
    and the number of links per text."""
    a_size, b_size = found.sizes()
    per_text = np.diff(found.groups_from)
    text_of = np.repeat(np.arange(len(per_text)), per_text)
    size = a_size * b_size
    totals = np.diff(_until(size)[found.groups_from])

    plain = np.flatnonzero(size <= PLAIN_LINKS)
    n = size[plain]
    group = np.repeat(plain, n)
    place = np.arange(len(group)) - np.repeat(_until(n)[:-1], n)
    a_at = (found.a_until - a_size)[group] + place // np.maximum(b_size[group], 1)
    b_at = (found.b_until - b_size)[group] + place % np.maximum(b_size[group], 1)
    texts = [text_of[group]]
    pairs = [(found.a_ids[a_at] << PAIR_BITS) + found.b_ids[b_at]]
    links = [np.ones(len(group), np.int64)]
    for g in np.flatnonzero(size > PLAIN_LINKS):
        ids, counts = zip(
            np.unique(found.a_ids[found.a_until[g] - a_size[g] : found.a_until[g]], return_counts=True),
            np.unique(found.b_ids[found.b_until[g] - b_size[g] : found.b_until[g]], return_counts=True),
        )
        packed = ((ids[0] << PAIR_BITS)[:, None] + ids[1]).ravel()
        texts.append(np.full(len(packed), text_of[g]))
        pairs.append(packed)
        links.append(np.outer(*counts).ravel())
    text, pair, link = (np.concatenate(parts) for parts in (texts, pairs, links))
    order = np.lexsort((pair, text))
    text, pair, link = text[order], pair[order], link[order]
    fresh = np.ones(len(pair), bool)
    fresh[1:] = (pair[1:] != pair[:-1]) | (text[1:] != text[:-1])
    starts = np.flatnonzero(fresh)
    summed = np.add.reduceat(link, starts) if len(starts) else link
    return _until(np.bincount(text[starts], minlength=len(per_text))), pair[starts], summed, totals


def _portions(texts: list[str | None]) -> Iterator[slice]:
    """Neighbouring texts of up to ``BATCH_BYTES`` bytes together, or one longer text."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        size = len((text or "").encode("utf-8", "surrogatepass"))
        if i > start and held + size > BATCH_BYTES:
            yield slice(start, i)
            start, held = i, 0
        held += size
    if texts:
        yield slice(start, len(texts))


def _map_aligned(
    documents: DataFrame,
    schema: str,
    make_a: Callable[[], TokenSide],
    make_b: Callable[[], TokenSide],
    columns: Callable[[Aligned, TokenSide, TokenSide], dict[str, list]],
) -> DataFrame:
    """Map documents in portions; ``columns`` turns an aligned portion into columns of ``schema``
    beside ``doc_id`` and a ``row`` that no other document has."""
    names = [field.split()[0] for field in schema.split(", ")]

    def make():
        a, b = make_a(), make_b()
        row = TaskContext.get().partitionId() << 40

        def work(batch):
            nonlocal row
            ids, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            out = {name: [] for name in names}
            for part in _portions(texts):
                size = part.stop - part.start
                made = columns(align_texts(texts[part], a, b), a, b)
                made |= {"doc_id": ids[part], "row": range(row, row + size)}
                for name in names:
                    out[name].extend(made[name])
                row += size
            return out

        return work

    return map_rows(documents.select("doc_id", F.col("text").cast("string")), schema, make)


def _cut(values: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    return [values[i:j] for i, j in zip(starts[:-1].tolist(), starts[1:].tolist())]


def align(
    documents: DataFrame, make_a: Callable[[], TokenSide], make_b: Callable[[], TokenSide]
) -> DataFrame:
    """The alignment itself, one row per document: token ids of both sides and, per group, how many
    tokens of A and B and how many bytes (of a space and the text) end with it.

    ``make_a`` and ``make_b`` run once in each task. Texts without tokens (null, empty, or not
    joined to a space and the text by both sides) have empty lists; repeated rows are aligned once
    each, an empty table gives no rows, a null doc_id is carried, and other columns are left out.
    A text is aligned whole in one task, whatever its length.
    """

    def columns(found, a, b):
        per_text = np.diff(found.groups_from)
        return {
            "a_ids": _cut(found.a_ids, found.a_from),
            "b_ids": _cut(found.b_ids, found.b_from),
            "a_until": _cut(found.a_until - np.repeat(found.a_from[:-1], per_text), found.groups_from),
            "b_until": _cut(found.b_until - np.repeat(found.b_from[:-1], per_text), found.groups_from),
            "bytes_until": _cut(found.bytes_until, found.groups_from),
        }

    return _map_aligned(documents, ALIGNED, make_a, make_b, columns)


def profiles(
    documents: DataFrame, make_a: Callable[[], TokenSide], make_b: Callable[[], TokenSide]
) -> DataFrame:
    """One row per document: its counts, the digest of its groups, and its distinct linked id pairs
    with the number of links of each. Edge cases as in ``align``."""

    def columns(found, a, b):
        starts, pairs, links, totals = linked_pairs(found)
        return {
            "n_a": np.diff(found.a_from),
            "n_b": np.diff(found.b_from),
            "n_groups": np.diff(found.groups_from),
            "n_links": totals,
            "groups_sha256": [
                hashlib.sha256(t.encode()).hexdigest() if t else "" for t in group_texts(found, a, b)
            ],
            "pairs": _cut(pairs, starts),
            "links": _cut(links, starts),
        }

    return _map_aligned(documents, PROFILE, make_a, make_b, columns)


def pair_counts(profile: DataFrame) -> DataFrame:
    """Documents that hold each linked pair (each row counts as a document), and whether that is
    the highest count of the pair's A id."""
    counts = profile.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(
        F.count(F.lit(1)).alias("held_by")
    )
    counts = materialise(counts.withColumn("a_id", F.shiftright("pair", PAIR_BITS)))
    highest = counts.groupBy("a_id").agg(F.max("held_by").alias("highest"))
    return counts.join(highest, "a_id").select(
        "a_id",
        F.col("pair").bitwiseAND(F.lit((1 << PAIR_BITS) - 1)).alias("b_id"),
        "pair",
        "held_by",
        (F.col("held_by") == F.col("highest")).alias("best"),
    )


def link_statistics(
    documents: DataFrame, make_a: Callable[[], TokenSide], make_b: Callable[[], TokenSide]
) -> DataFrame:
    """Alignment counts of every document, its links to the pair each A id most often has, and the
    sum of its links' counts. Edge cases as in ``align``; documents without tokens have zeros."""
    profile = materialise(profiles(documents, make_a, make_b))
    counts = materialise(pair_counts(profile).select("pair", "held_by", "best"))
    if counts.count() <= BROADCAST_PAIRS:
        counts = F.broadcast(counts)
    held = profile.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("p"))
    held = held.select("row", F.col("p.pairs").alias("pair"), F.col("p.links").alias("n"))
    sums = (
        held.join(counts, "pair")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("best"), F.col("n")).otherwise(F.lit(0))).alias("n_best"),
            F.sum(F.col("n") * F.col("held_by")).alias("count_sum"),
        )
    )
    return profile.drop("pairs", "links").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"),
        "groups_sha256",
    )
