"""Language of texts by the nearest of several centroids per language.

A text is a vector of its letter n-grams (one to three letters, with word boundaries) hashed to a
fixed number of places, weighted by logarithmic counts and inverse document frequency, and scaled to
length one. Document frequencies cover all training documents. Each language's vectors are clustered
by cosine into a few centroids, from a bounded sample of its texts; a text gets the language of the
nearest centroid, and one farther from it than nearly all training texts is marked as rejected.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.shared import SpanHasher, map_rows, mix64

SIZES = (1, 2, 3)


class Vectors:
    """n-gram vectors of texts; one object per task keeps its tables."""

    def __init__(self, places: int):
        self.places = places
        self.hasher = SpanHasher()
        self.letter = np.zeros(0x110000, bool)
        self.letter[[c for c in range(0x30000) if chr(c).isalpha()]] = True

    def counts(self, text: str | None) -> np.ndarray | None:
        """Occurrences of n-grams by place; None without any letter."""
        codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = self.letter[codes]
        if not letter.any():
            return None
        # one gap for each run of other characters, and one at both ends
        codes = np.concatenate(([0], np.where(letter, codes, 0), [0])).astype(np.uint64)
        codes = codes[(codes != 0) | np.concatenate(([True], codes[:-1] != 0))]
        sums = self.hasher.sums(mix64(codes))
        out = np.zeros(self.places, np.int64)
        for size in SIZES:
            starts = np.arange(len(codes) - size + 1)
            hashes = self.hasher.spans(sums, starts, starts + size)
            out += np.bincount((hashes % np.uint64(self.places)).astype(np.int64), minlength=self.places)
        return out


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    vector = np.log1p(counts) * idf
    length = np.sqrt(vector @ vector)
    return (vector / length if length else vector).astype(np.float32)


def cluster(vectors: np.ndarray, groups: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from evenly spread starting rows; empty clusters vanish."""
    centres = vectors[np.linspace(0, len(vectors) - 1, min(groups, len(vectors))).astype(int)]
    for _ in range(rounds):
        nearest = np.argmax(vectors @ centres.T, axis=1)
        sums = [vectors[nearest == g].sum(axis=0) for g in range(len(centres))]
        centres = np.array([s / max(np.sqrt(s @ s), 1e-9) for s in sums if s.any()])
    return centres.astype(np.float32)


@dataclass
class LanguageModel:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    reach: float  # smallest cosine of a text that is not rejected


def _document_frequency(texts: DataFrame, places: int) -> tuple[np.ndarray, int]:
    def make():
        vectors = Vectors(places)

        def work(batch):
            table, n = np.zeros(places + 1, np.int64), 0
            for text in batch["text"].to_pylist():
                counts = vectors.counts(text)
                if counts is not None:
                    table[:-1] += counts > 0
                    n += 1
            table[-1] = n
            at = np.flatnonzero(table)
            return {"at": at, "n": table[at]}

        return work

    rows = map_rows(texts.select("text"), "at bigint, n bigint", make)
    out = np.zeros(places + 1)
    for r in rows.groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out[:-1], int(out[-1])


def learn(
    texts: DataFrame,
    places: int = 4096,
    per_language: int = 400,
    groups: int = 4,
    rejected: float = 0.005,
) -> LanguageModel:
    """Learn from (doc_id, text, lang) rows; rows of null language are left out.

    The clusters of a language come from an expected ``per_language`` texts, chosen by a hash of
    doc_id; all counts cover all rows. The share ``rejected`` of the sample with the smallest cosine
    to any centroid sets the distance from which texts are rejected.
    """
    texts = texts.where(F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    found, n = _document_frequency(texts, places)
    idf = np.log((n + 1) / (found + 1)) + 1
    # One row per language comes to the driver; only the sampled texts are moved.
    sizes = texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    buckets = 1 << 30
    place = F.pmod(F.xxhash64("doc_id", F.lit("clusters")), F.lit(buckets))
    kept = {r.lang: int(buckets * min(1.0, per_language / r.n)) for r in sizes} or {"und": 0}
    bounds = F.create_map(*[F.lit(x) for pair in kept.items() for x in pair])
    sample = texts.where(place < F.try_element_at(bounds, F.col("lang")))
    schema = "lang string, centroid array<float>, low array<float>"

    def of_language(key, rows):
        import pandas as pd

        vectors = Vectors(places)
        counted = [vectors.counts(t) for t in rows.sort_values("doc_id")["text"]]
        matrix = [_weigh(c, idf) for c in counted if c is not None]
        if not matrix:
            return pd.DataFrame(columns=["lang", "centroid", "low"], dtype=object)
        matrix = np.array(matrix)
        centres = cluster(matrix, groups)
        nearest = (matrix @ centres.T).max(axis=1)
        return pd.DataFrame(
            {"lang": [key[0]] * len(centres), "centroid": list(centres),
             "low": [nearest] + [np.zeros(0, np.float32)] * (len(centres) - 1)}
        )

    rows = (
        sample.select("doc_id", "lang", "text").groupBy("lang").applyInPandas(of_language, schema)
    ).collect()
    rows.sort(key=lambda r: r.lang)  # stable: centroids keep their order within a language
    near = np.concatenate([np.zeros(0), *[np.array(r.low) for r in rows]])
    return LanguageModel(
        [r.lang for r in rows],
        np.array([r.centroid for r in rows], np.float32).reshape(-1, places),
        idf,
        float(np.quantile(near, rejected)) if len(near) else 0.0,
    )


def predict(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """One row per document: doc_id, lang_pred, score and rejected.

    ``score`` is the cosine to the nearest centroid, within 0 and 1; ties go to the language first
    in order. A text that is null or has no letter, and any text if nothing was learned, gets
    ``und``, score 0 and rejected. A rejected text keeps the nearest language.
    """

    def make():
        vectors = Vectors(len(model.idf))

        def work(batch):
            out = {"doc_id": batch["doc_id"], "lang_pred": [], "score": [], "rejected": []}
            for text in batch["text"].to_pylist():
                counts = vectors.counts(text) if len(model.languages) else None
                if counts is None:
                    name, score = "und", 0.0
                else:
                    cosines = model.centroids @ _weigh(counts, model.idf)
                    best = int(np.argmax(cosines))
                    name, score = model.languages[best], float(min(max(cosines[best], 0.0), 1.0))
                out["lang_pred"].append(name)
                out["score"].append(score)
                out["rejected"].append(counts is None or score < model.reach)
            return out

        return work

    return map_rows(
        documents.select("doc_id", "text"),
        "doc_id bigint, lang_pred string, score double, rejected boolean",
        make,
    )


def fold(doc_id: Column, folds: int = 3) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))
