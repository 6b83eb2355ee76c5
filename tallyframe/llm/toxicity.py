"""Severity grades of documents by cumulative-link ordinal regression.

Features are a text's words and the four- and five-letter beginnings of its words, each with the
logarithm of one plus its count. One weight vector is shared by all grades: the probability that a
document's grade is above j is sigmoid(w x - t_j), with ordered thresholds t_0 < t_1 < ...; the sum
of these probabilities is the expected severity.

Model and vocabulary are learned from a bounded sample of the labelled rows: features found in a
share of the sampled documents of grade 1 and above, and there significantly more or less often than
in grade 0, then the fit itself. Every document is graded from its whole text.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.shared import SpanHasher, map_rows, mix64
from tallyframe.session import materialise

FAMILIES = (0, 4, 5)  # whole words, and beginnings of so many letters


def _letters(codes: np.ndarray) -> np.ndarray:
    """Which code points make up words: ASCII letters and digits, and beyond Latin-1 signs all
    but general punctuation."""
    lower = (codes >= 97) & (codes <= 122)
    digit = (codes >= 48) & (codes <= 57)
    high = (codes >= 0xC0) & (codes != 0xD7) & (codes != 0xF7)
    punctuation = ((codes >= 0x2000) & (codes < 0x2070)) | ((codes >= 0x3000) & (codes < 0x3040))
    return lower | digit | (high & ~punctuation)


def text_features(hasher: SpanHasher, text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit features of a whole text and their counts."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.concatenate(([False], _letters(codes), [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sums = hasher.sums(mix64(codes.astype(np.uint64)))
    found = []
    for size in FAMILIES:
        if size:
            longer = ends - starts > size
            a, b = starts[longer], starts[longer] + size
        else:
            a, b = starts, ends
        found.append(mix64(hasher.spans(sums, a, b) ^ np.uint64(size)))
    return np.unique(np.concatenate(found), return_counts=True)


def _frequent(labelled: DataFrame, least: int) -> np.ndarray:
    """Features found in at least ``least`` documents of grade 1 and above, sorted."""

    def make():
        hasher = SpanHasher()

        def work(batch):
            found = [text_features(hasher, t)[0] for t in batch["text"].to_pylist()]
            values, counts = np.unique(
                np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True
            )
            return {"feature": values.view(np.int64), "n": counts}

        return work

    rows = (
        map_rows(labelled.where("grade > 0").select("text"), "feature bigint, n bigint", make)
        .groupBy("feature")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= least)
    )
    return np.sort(np.array([r.feature for r in rows.collect()], np.int64).view(np.uint64))


def _places(vocabulary: np.ndarray, values: np.ndarray, counts: np.ndarray):
    """Places in the sorted vocabulary of the values that it holds, and their counts."""
    at = np.searchsorted(vocabulary, values)
    at[at == len(vocabulary)] = 0
    held = vocabulary[at] == values if len(vocabulary) else np.zeros(len(values), bool)
    return at[held], counts[held]


def _document_counts(labelled: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Documents holding each feature, by grade 0 (first column) and above (second)."""

    def make():
        hasher = SpanHasher()

        def work(batch):
            table = np.zeros((len(vocabulary), 2), np.int64)
            for text, grade in zip(batch["text"].to_pylist(), batch["grade"].to_pylist()):
                values, counts = text_features(hasher, text)
                table[_places(vocabulary, values, counts)[0], int(grade > 0)] += 1
            at, above = np.nonzero(table)
            return {"at": at, "above": above, "n": table[at, above]}

        return work

    rows = map_rows(labelled.select("text", "grade"), "at bigint, above bigint, n bigint", make)
    out = np.zeros((len(vocabulary), 2))
    for r in rows.groupBy("at", "above").agg(F.sum("n").alias("n")).collect():
        out[r["at"], r["above"]] = r["n"]
    return out


def choose_vocabulary(
    labelled: DataFrame, max_features: int = 4096, min_share: float = 0.005, min_z: float = 6.0
) -> tuple[np.ndarray, np.ndarray]:
    """Significant features (sorted) and their log odds of grade 1 and above.

    A document has so many features, so at most (features of a document / ``min_share``) reach the
    share asked for; that, whatever the number of documents, bounds what comes to the driver.
    """
    totals = {r.above: r.n for r in labelled.groupBy((F.col("grade") > 0).alias("above")).agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, above = totals.get(False, 0), totals.get(True, 0)
    if not clean or not above:
        return np.zeros(0, np.uint64), np.zeros(0)
    vocabulary = _frequent(labelled, max(5, int(above * min_share)))
    if not len(vocabulary):
        return vocabulary, np.zeros(0)
    found = _document_counts(labelled, vocabulary)
    p, q = found[:, 1] / above, found[:, 0] / clean
    pooled = found.sum(axis=1) / (above + clean)
    spread = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / above + 1 / clean))
    z = np.abs(p - q) / spread
    p, q = (found[:, 1] + 0.5) / (above + 1), (found[:, 0] + 0.5) / (clean + 1)
    odds = np.log(p / (1 - p)) - np.log(q / (1 - q))
    best = np.sort(np.argsort(-z, kind="stable")[:max_features])
    best = best[z[best] >= min_z]
    return vocabulary[best], odds[best]


def sparse_rows(documents: DataFrame, vocabulary: np.ndarray, carried: list[str]) -> DataFrame:
    """The carried columns with places in the vocabulary and counts."""

    def make():
        hasher = SpanHasher()

        def work(batch):
            out = {c: batch[c] for c in carried} | {"places": [], "counts": []}
            for text in batch["text"].to_pylist():
                values, counts = text_features(hasher, text)
                at, held = _places(vocabulary, values, counts)
                out["places"].append(at.astype(np.int32))
                out["counts"].append(held.astype(np.int32))
            return out

        return work

    kinds = dict(documents.dtypes)
    schema = [f"{c} {kinds[c]}" for c in carried]
    return map_rows(
        documents.select(*carried, "text"),
        ", ".join([*schema, "places array<int>, counts array<int>"]),
        make,
    )


@dataclass
class OrdinalModel:
    vocabulary: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray  # increasing, one fewer than there are grades

    def above(self, scores: np.ndarray) -> np.ndarray:
        """Probability of a grade above each threshold, one row per document."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds, -30, 30)))


def _pack(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(r.places) for r in rows], np.int64)
    row = np.repeat(np.arange(len(rows)), sizes)
    at = np.array([p for r in rows for p in r.places], np.int64)
    value = np.log1p(np.array([c for r in rows for c in r.counts], float))
    return row, at, value


def fit(rows: list, grades: np.ndarray, vocabulary: np.ndarray, penalty: float = 1e-5,
        steps: int = 400, rate: float = 0.1) -> OrdinalModel:
    """Fit weights and thresholds to sparse rows by full-batch Adam on the mean log likelihood.

    With no rows or a single grade nothing can be learned, and every document gets grade 0.
    """
    levels = int(grades.max()) if len(grades) else 0
    if not levels or not (grades == 0).any():
        return OrdinalModel(vocabulary, np.zeros(len(vocabulary)), np.full(max(levels, 1), 30.0))
    row, at, value = _pack(rows)
    n, m = len(rows), len(vocabulary)
    share = np.array([(grades > j).mean() for j in range(levels)])
    start = np.log((1 - share) / share)
    # first threshold, then logarithms of the steps to the next ones
    gaps = np.log(np.maximum(np.diff(start), 0.05))
    params = np.concatenate((np.zeros(m), start[:1], gaps))
    first, second = np.zeros_like(params), np.zeros_like(params)
    each = np.arange(n)
    for step in range(1, steps + 1):
        thresholds = params[m] + np.concatenate(([0], np.cumsum(np.exp(params[m + 1 :]))))
        scores = np.bincount(row, value * params[at], n)
        p = 1 / (1 + np.exp(-np.clip(scores[:, None] - thresholds, -30, 30)))
        # P(grade) = P(above the threshold below it) - P(above its own threshold)
        full = np.concatenate((np.ones((n, 1)), p, np.zeros((n, 1))), axis=1)
        chance = np.maximum(full[each, grades] - full[each, grades + 1], 1e-9)
        slope = full * (1 - full)
        by_score = (slope[each, grades] - slope[each, grades + 1]) / chance / n
        by_threshold = np.zeros((n, levels + 2))
        by_threshold[each, grades] -= slope[each, grades] / chance / n
        by_threshold[each, grades + 1] += slope[each, grades + 1] / chance / n
        by_threshold = by_threshold[:, 1:-1].sum(axis=0)
        gradient = np.concatenate(
            (
                np.bincount(at, value * by_score[row], m) - penalty * params[:m],
                [by_threshold.sum()],
                np.cumsum(by_threshold[::-1])[::-1][1:] * np.exp(params[m + 1 :]),
            )
        )
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        params += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    thresholds = params[m] + np.concatenate(([0], np.cumsum(np.exp(params[m + 1 :]))))
    return OrdinalModel(vocabulary, params[:m], thresholds)


def learn(
    labelled: DataFrame,
    max_rows: int = 20_000,
    max_features: int = 4096,
    flag_grades: bool = True,
) -> OrdinalModel:
    """Learn from (doc_id, text, grade) rows; null grades are left out.

    The fit takes at most ``max_rows`` rows, those of the smallest hash of doc_id; see
    ``sample_labelled`` for a bounded sample to begin with. If the grades are a 0/1 flag and
    ``flag_grades`` is set, flagged documents are graded further: 1 below, 2 from the median number
    of clear features (log odds over 2) among the flagged documents. A rate per word would not do:
    the scores add up features, so length would only blur the grades.
    """
    labelled = labelled.where(F.col("grade").isNotNull()).select("doc_id", "text", "grade")
    vocabulary, odds = choose_vocabulary(labelled, max_features)
    rows = (
        sparse_rows(labelled, vocabulary, ["doc_id", "grade"])
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
        .collect()
    )
    grades = np.array([r.grade for r in rows], np.int64)
    if flag_grades and len(grades) and grades.max() == 1:
        marks = np.array(
            [sum(c for p, c in zip(r.places, r.counts) if odds[p] > 2) for r in rows]
        )
        flagged = grades == 1
        grades[flagged & (marks >= np.median(marks[flagged]))] = 2
        if not (grades == 1).any():
            grades = np.minimum(grades, 1)
    return fit(rows, grades, vocabulary)


def _above(model: OrdinalModel, hasher: SpanHasher, texts: list[str | None]) -> np.ndarray:
    scores = np.zeros(len(texts))
    for i, text in enumerate(texts):
        at, counts = _places(model.vocabulary, *text_features(hasher, text))
        scores[i] = np.log1p(counts) @ model.weights[at]
    return model.above(scores)


def grade_documents(documents: DataFrame, model: OrdinalModel, limit: float = 0.35) -> DataFrame:
    """One row per document: doc_id, expected_severity, p_toxic, grade and toxic.

    ``p_toxic`` is the probability of grade 1 or above, ``grade`` the likeliest grade (the lower
    one of equals), ``toxic`` says that ``p_toxic`` reaches ``limit``. A null or empty text has no
    features and gets the grade that the thresholds alone give. Null ids and repeated rows are
    graded like any other.
    """

    def make():
        hasher = SpanHasher()

        def work(batch):
            above = _above(model, hasher, batch["text"].to_pylist())
            full = np.pad(above, ((0, 0), (1, 1)))
            full[:, 0] = 1
            return {
                "doc_id": batch["doc_id"],
                "expected_severity": above.sum(axis=1),
                "p_toxic": above[:, 0],
                "grade": np.argmax(full[:, :-1] - full[:, 1:], axis=1).astype(np.int32),
                "toxic": above[:, 0] >= limit,
            }

        return work

    return map_rows(
        documents.select("doc_id", "text"),
        "doc_id bigint, expected_severity double, p_toxic double, grade int, toxic boolean",
        make,
    )


def clean_documents(documents: DataFrame, model: OrdinalModel, limit: float = 0.35) -> DataFrame:
    """The rows, with all their columns, whose ``p_toxic`` stays below ``limit``; no shuffle."""

    def keep(batches):
        hasher = SpanHasher()
        for batch in batches:
            above = _above(model, hasher, batch["text"].to_pylist())
            yield batch.filter(pa.array(above[:, 0] < limit))

    return documents.mapInArrow(keep, documents.schema)


def sample_labelled(documents: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """(doc_id, text, grade) of at most ``max_rows`` labelled ids, those of the smallest hash.

    The grade is the label's toxic flag (the greatest of several). The ids are bounded, so they are
    broadcast and no text is shuffled; the sampled texts are written out for the passes over them.
    """
    flags = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    return materialise(documents.select("doc_id", "text").join(F.broadcast(flags), "doc_id"))
