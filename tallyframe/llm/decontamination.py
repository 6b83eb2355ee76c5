"""Benchmark passages in documents, by spaced-seed hashing. DataFrame functions only.

Words are runs of letters and digits, lower-cased and hashed once. A mask is a short window of
which some places are ignored; every window of every benchmark item and document is hashed under
every mask over the places that count, so a changed word leaves hits at all windows where it falls
on an ignored place or outside. Test and training hashes are joined, a run of hits in one alignment
is followed up at its first hit only, and the aligned words around it are compared: the overlap is
the best stretch, one point for each equal word and one off for each changed one.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.session import materialise

# Three masks of ten places and six that count, chosen so that 15 words with three changed ones keep
# a hit in 97 of 100 cases and 30 words with six in practically all. A hit is not yet a report: the
# best stretch must score as well, which short items with changes often do not.
MASKS = ("1110011001", "1100001111", "1101100101")

# Tables up to this number of rows, of a few dozen bytes each, are broadcast; beyond it the joins
# are shuffled. Items carry all their words and are held to this number of bytes as well.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 2**20


def _hinted(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _hinted_items(items: DataFrame) -> DataFrame:
    """Items are broadcast by their counted rows and bytes: eight for each word's hash, and 64."""
    held = items.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(8 * F.size("item").cast("bigint") + 64), F.lit(0)).alias("size"),
    ).first()
    fits = held["n"] <= BROADCAST_ROWS and held["size"] <= BROADCAST_BYTES
    return F.broadcast(items) if fits else items


def word_hashes(text: Column) -> Column:
    """One 64-bit hash for each word; no words, or a null text, give an empty array."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.array_remove(words, ""), lambda w: F.xxhash64(w))


def _window_hash(words: Column, place: Column, mask: str) -> Column:
    """Hash of the window at a place; null if it reaches beyond either end of the text."""
    fits = (place >= 0) & (place + len(mask) <= F.size(words))
    return F.when(
        fits, F.xxhash64(*[F.get(words, place + i) for i, c in enumerate(mask) if c == "1"])
    )


def _windows(rows: DataFrame, masks: list[str], key: str) -> DataFrame:
    """Every window of every row under every mask: key, number of words, mask, place, hash, and the
    hash of the window one place before. The words themselves stay behind."""
    shortest = min(len(m) for m in masks)
    words, place = F.col("words"), F.col("place")
    seeds = F.array(
        *[
            F.struct(
                F.lit(i).alias("mask"),
                _window_hash(words, place, m).alias("hash"),
                _window_hash(words, place - 1, m).alias("before"),
            )
            for i, m in enumerate(masks)
        ]
    )
    return (
        rows.where(F.size("words") >= shortest)
        .select(key, "words", F.explode(F.expr(f"sequence(0, size(words) - {shortest})")).alias("place"))
        .select(key, F.size("words").alias("n"), "place", F.explode(seeds).alias("seed"))
        .select(key, "n", "place", "seed.*")
        .where(F.col("hash").isNotNull())
    )


def _best_stretch(words: Column, item: Column, start: Column) -> Column:
    """Largest sum over neighbouring places of the item, +1 for a word that stands at its place in
    the document and -1 for any other."""
    equal = F.transform(
        item,
        lambda w, i: F.when(
            (start + i >= 0) & (start + i < F.size(words)) & (F.get(words, start + i) == w),
            F.lit(1),
        ).otherwise(F.lit(-1)),
    )
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(total, point):
        now = F.greatest(total["now"] + point, F.lit(0))
        return F.struct(now.alias("now"), F.greatest(total["best"], now).alias("best"))

    return F.aggregate(equal, zero, step, lambda total: total["best"])


def contaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    masks: tuple[str, ...] = MASKS,
    min_overlap: int = 10,
    min_item_words: int = 8,
) -> DataFrame:
    """(doc_id, item_id, overlap, item_words, start_word): benchmark items found in documents.

    A pair is reported if its best stretch scores ``min_overlap`` or, for a shorter item, the whole
    item; ``start_word`` is the place in the document at which the item's first word would stand
    (negative if the document starts within the item) in the best alignment, the earliest of equal
    ones. Items of fewer words than a mask are sought whole; those under ``min_item_words`` words
    are too short to tell from chance and never found. Null and empty texts match nothing, null ids
    are carried along, repeated rows are reported once, empty tables give no rows.
    """
    items = materialise(
        benchmark.select("item_id", word_hashes(F.col("text")).alias("item"))
        .where(F.size("item") >= min_item_words)
        .distinct()
    )
    shortest = min(len(m) for m in masks)
    # At most as many sizes as a mask has places.
    short = [
        r.n
        for r in items.where(F.size("item") < shortest)
        .select(F.size("item").alias("n"))
        .distinct()
        .collect()
    ]
    all_masks = [*masks, *["1" * n for n in sorted(short)]]
    seeds = _windows(items.withColumnRenamed("item", "words"), all_masks, "item_id")
    for i, n in enumerate(sorted(short), len(masks)):  # such a mask is for items of just that size
        seeds = seeds.where((F.col("mask") != i) | (F.col("n") == n))
    seeds = materialise(
        seeds.select(
            "hash",
            F.col("mask").alias("item_mask"),
            "item_id",
            F.col("place").alias("item_place"),
            F.col("before").alias("item_before"),
        ).distinct()
    )
    texts = documents.select("doc_id", word_hashes(F.col("text")).alias("words"))
    windows = _windows(texts, all_masks, "doc_id")
    first = F.coalesce(F.col("before") != F.col("item_before"), F.lit(True))
    hits = materialise(
        windows.join(
            _hinted(seeds),
            (windows["hash"] == seeds["hash"]) & (windows["mask"] == seeds["item_mask"]) & first,
        )
        .select(
            F.col("doc_id").alias("hit_id"),
            F.col("item_id").alias("hit_item"),
            (F.col("place") - F.col("item_place")).alias("start_word"),
        )
        .distinct()
    )
    # only texts with hits are parsed again and moved
    hit_ids = _hinted(materialise(hits.select("hit_id").distinct()))
    followed = (
        documents.join(hit_ids, F.col("doc_id").eqNullSafe(F.col("hit_id")), "left_semi")
        .select("doc_id", word_hashes(F.col("text")).alias("words"))
        .join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")))
    )
    compared = followed.join(
        _hinted_items(items), F.col("hit_item").eqNullSafe(F.col("item_id"))
    ).select(
        "doc_id",
        "item_id",
        "start_word",
        F.size("item").alias("item_words"),
        _best_stretch(F.col("words"), F.col("item"), F.col("start_word")).alias("overlap"),
    )
    return (
        compared.where(F.col("overlap") >= F.least(F.lit(min_overlap), F.col("item_words")))
        .groupBy("doc_id", "item_id", "item_words")
        .agg(
            F.max("overlap").alias("overlap"),
            F.min(F.struct(-F.col("overlap"), "start_word")).alias("best"),
        )
        .select("doc_id", "item_id", "overlap", "item_words", F.col("best.start_word").alias("start_word"))
    )
