"""Near-duplicates by bottom-k sketches from one hash function.

A document's sketch is the ``k`` smallest hashes of its distinct word shingles. Equal sets are
collapsed first. Inverted lists of the retained values give candidate pairs, the sketch of the
union of two documents estimates their similarity, and the exact Jaccard index of the full shingle
sets decides.

Which retained values are listed. Two documents of similarity t share at least about t * k retained
values; ``least_shared`` sets how many are asked for at least (half of k and one for t = 0.8: five to
six standard deviations below the expected number, some 1e-8 of such pairs would fall short; sets
small enough to be retained whole with every partner use the exact bound and lose nothing). If two
sketches share c values, they share one of the first (size - c + 1) of each in any common order.
The order used is rarest first, so a value of a frequent passage is listed only for documents that
hold little else, and a document most of whose values occur nowhere else has no entry at all.
Entries meet only within neighbouring size classes, as similar sets have similar sizes.

Large groups. Entries of a list of up to ``SHORT_LIST`` meet one another. In a longer list they are
only compared with one of them, the hub (the set with most entries), and every set is written as its
difference from a reference: the shingles that most of some 32 of the hub's sets hold, which in a
group of copies is close to the common original even if every copy, the hub included, is changed.
Which sets are asked for the reference changes no result, only the size of the differences.
The lists of one group may have several hubs. A hub that a larger one much like it lists gives it all
its sets, so that a set is compared once, not once for each list; a list's sets stay together.

With p percent, set size A and difference size d(A), let w(A) = (100 + p) d(A) - (100 - p) A. Two
sets whose differences have c elements in common are similar if and only if
2 (100 + p) c >= w(A) + w(B). So sets with w(A) + w(B) <= 0 are linked as they are, each such one to
the set of the lowest w, and all others need common elements, the more the farther they are. Whatever
the partner, it differs from A in at most A (100 - p) / p elements, so c >= d(A) - A (100 - p) / p.

Only groups are asked for, so sets that already are in one group are not compared: the links found so
far give labels, the label that most sets of a hub have is its main one, and only sets of other labels
are listed, with one another and with those of the main label. Elements held by one set or by one
label only are left out, and the rarest-first listing is applied to the rest. Copies changed at
random places have hardly any element in common besides the reference's, so next to no pairs remain.
"""

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.components import components
from tallyframe.llm.shared import SpanHasher, map_rows, shingle_hashes
from tallyframe.session import materialise

# Members of an inverted list that meet one another; longer lists go by their hub.
SHORT_LIST = 32
# Percent of similarity that the sketches of two hubs must not rule out for one to take the other's sets.
ALIKE = 50
# Sets of a hub that are asked, expectedly, for its reference.
ASKED = 32
# Hubs up to which facts of some numbers each are sent to every task (some 10 MB).
BROADCAST_HUBS = 100_000
# Shingles of all hubs and references, in bytes, up to which they are sent to every task.
BROADCAST_BYTES = 32 << 20


def sketches(documents: DataFrame, words: int, k: int) -> DataFrame:
    """(doc_id, n_shingles, digest of the set, sketch) of every row."""

    def make():
        hasher = SpanHasher()

        def work(batch):
            out = {"doc_id": batch["doc_id"], "n_shingles": [], "digest": [], "sketch": []}
            for text in batch["text"].to_pylist():
                hashes = shingle_hashes(hasher, text, words)
                out["n_shingles"].append(len(hashes))
                out["digest"].append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                out["sketch"].append(hashes[:k].view(np.int64))
            return out

        return work

    return map_rows(
        documents.select("doc_id", "text"),
        "doc_id bigint, n_shingles bigint, digest binary, sketch array<bigint>",
        make,
    )


def _least_shared(percent: int, k: int):
    """Retained values that a similar pair shares at least, by set size ``n``."""
    exact = F.ceil(F.col("n") * percent / 100)
    usual = F.lit(math.floor(k * percent / 100 * 0.625) + 1)
    return F.when(F.col("n") * 100 <= k * percent, exact).otherwise(usual)


def _entries(sets: DataFrame, percent: int, k: int) -> DataFrame:
    """Inverted lists: (value, size class, id, n) of the listed values of every set."""
    postings = sets.select("id", "n", F.explode("sketch").alias("value"))
    often = (
        postings.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1)
    )
    listed = (
        postings.join(often, "value")
        .groupBy("id", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("shared"))
        # values that no other set retains come first in the order and take up their places
        .withColumn("room", F.size("shared") - _least_shared(percent, k).cast("int") + 1)
        .where(F.col("room") > 0)
    )
    size_class = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("int")
    return listed.select(
        "id",
        "n",
        "room",
        F.explode(F.slice("shared", F.lit(1), F.col("room"))).alias("entry"),
        size_class.alias("class"),
    ).select(
        F.col("entry.value").alias("value"),
        F.explode(F.array(F.col("class"), F.col("class") + 1)).alias("class"),
        "id",
        "n",
        "room",
    )


def _similar_sizes(percent: int):
    return F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent


def _estimated(pairs: DataFrame, sets: DataFrame, percent: int, k: int) -> DataFrame:
    """Pairs whose union sketch does not rule the similarity out."""
    side = sets.select("id", "sketch")
    both = pairs.join(
        side.select(F.col("id").alias("a"), F.col("sketch").alias("sketch_a")), "a"
    ).join(side.select(F.col("id").alias("b"), F.col("sketch").alias("sketch_b")), "b")

    def make():
        def work(batch):
            left, right = batch["sketch_a"], batch["sketch_b"]
            keep = []
            for i in range(batch.num_rows):
                x = left[i].values.to_numpy().view(np.uint64)
                y = right[i].values.to_numpy().view(np.uint64)
                joint = np.sort(np.concatenate((x, y)), kind="stable")
                twice = joint[1:] == joint[:-1]
                union = np.unique(joint)[:k]
                shared = np.count_nonzero(joint[1:][twice] <= union[-1])
                keep.append(shared * 100 >= len(union) * percent * 0.625)
            return {"a": batch["a"], "b": batch["b"], "keep": keep}

        return work

    return (
        map_rows(both.select("a", "b", "sketch_a", "sketch_b"), "a bigint, b bigint, keep boolean", make)
        .where("keep")
        .select("a", "b")
    )


def _sides(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    left = shingles.select(F.col("id").alias("a"), F.col("hashes").alias("hashes_a"))
    right = shingles.select(F.col("id").alias("b"), F.col("hashes").alias("hashes_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "hashes_a", "hashes_b")


def _confirmed(pairs: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the similarity."""

    def make():
        def work(batch):
            keep = []
            for x, y in zip(batch["hashes_a"], batch["hashes_b"]):
                x = np.frombuffer(x.as_buffer(), np.uint64)
                y = np.frombuffer(y.as_buffer(), np.uint64)
                joint = np.sort(np.concatenate((x, y)), kind="stable")
                shared = int(np.count_nonzero(joint[1:] == joint[:-1]))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            return {"a": batch["a"], "b": batch["b"], "keep": keep}

        return work

    return (
        map_rows(_sides(pairs, shingles), "a bigint, b bigint, keep boolean", make)
        .where("keep")
        .select("a", "b")
    )


def _by_hub(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts of the hubs beside the rows. A hub may have most of the rows, so few hubs are sent to
    every task; many are joined, where adaptive execution splits a hub's rows."""
    return rows.join(F.broadcast(facts) if facts.count() <= BROADCAST_HUBS else facts, "a")


def _fewer_hubs(stars: DataFrame, sets: DataFrame, k: int) -> DataFrame:
    """The stars, with the sets of a hub under the largest hub that lists it, is much like it and
    stays one itself. What shared a hub still shares one, so every pair is compared as before."""
    ranks = materialise(
        stars.groupBy("a")
        .agg(F.count(F.lit(1)).alias("members"))
        .select("a", F.struct("members", (-F.col("a")).alias("minus")).alias("rank"))
    )
    sketches_of = materialise(
        _by_hub(sets.select(F.col("id").alias("a"), "sketch"), ranks).select(F.col("a").alias("id"), "sketch")
    )
    inner = _by_hub(stars.select(F.col("b").alias("a"), F.col("a").alias("larger")), ranks)
    inner = inner.select(F.col("a").alias("b"), F.col("larger").alias("a"), F.col("rank").alias("rank_b"))
    pairs = _by_hub(inner, ranks).where(F.col("rank") > F.col("rank_b")).select("a", "b")
    alike = materialise(_estimated(pairs, sketches_of, ALIKE, k))
    staying = ranks.join(alike.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
    into = alike.join(staying, "a").groupBy("b").agg(F.max("rank").alias("rank"))
    into = into.select(F.col("b").alias("a"), (-F.col("rank.minus")).alias("into"))
    goes = materialise(ranks.join(into, "a", "left").select("a", F.coalesce("into", "a").alias("into")))
    return _by_hub(stars, goes).select(F.col("into").alias("a"), "b").distinct()


def _references(stars: DataFrame, shingles: DataFrame) -> DataFrame:
    """Per hub a the shingles that more than half of some ``ASKED`` of its sets hold."""
    sizes = materialise(stars.groupBy("a").agg(F.count(F.lit(1)).alias("members")))
    every = F.greatest(F.floor(F.col("members") / ASKED), F.lit(1))
    asked = _by_hub(stars, sizes).where(F.pmod(F.xxhash64("a", "b"), every) == 0).select("a", "b")
    sets = asked.unionByName(sizes.select("a", F.col("a").alias("b"))).join(
        shingles.select(F.col("id").alias("b"), "hashes"), "b"
    )

    def make():
        def work(batch):
            common = []
            for members in batch["members"]:
                held = [np.frombuffer(m.as_buffer(), np.uint64) for m in members.values]
                values, counts = np.unique(np.concatenate(held), return_counts=True)
                common.append(values[2 * counts > len(held)].tobytes())
            return {"a": batch["a"], "reference": common}

        return work

    gathered = sets.groupBy("a").agg(F.collect_list("hashes").alias("members"))
    return map_rows(gathered, "a bigint, reference binary", make)


def _differences(
    stars: DataFrame, references: DataFrame, shingles: DataFrame, percent: int
) -> DataFrame:
    """Hub a and set b: whether they are similar, size and w of the set, and its difference."""

    def make():
        def work(batch):
            out = {"a": batch["a"], "b": batch["b"], "linked": [], "n": [], "w": [], "elements": []}
            for hub, own, common in zip(batch["hashes_a"], batch["hashes_b"], batch["reference"]):
                hub, own, common = (np.frombuffer(x.as_buffer(), np.uint64) for x in (hub, own, common))
                shared = len(np.intersect1d(hub, own, assume_unique=True))
                out["linked"].append(100 * shared >= percent * (len(hub) + len(own) - shared))
                apart = np.setxor1d(own, common, assume_unique=True)
                out["n"].append(len(own))
                out["w"].append((100 + percent) * len(apart) - (100 - percent) * len(own))
                out["elements"].append(apart.view(np.int64))
            return out

        return work

    own = shingles.select(F.col("id").alias("b"), F.col("hashes").alias("hashes_b"))
    hubs = materialise(
        references.join(shingles.select(F.col("id").alias("a"), F.col("hashes").alias("hashes_a")), "a")
    )
    size = hubs.agg(F.sum(F.length("hashes_a") + F.length("reference")).alias("bytes")).first()
    if (size.bytes or 0) <= BROADCAST_BYTES:  # a hub may have most of the sets
        hubs = F.broadcast(hubs)
    return map_rows(
        stars.join(own, "b").join(hubs, "a").select("a", "b", "hashes_a", "hashes_b", "reference"),
        "a bigint, b bigint, linked boolean, n bigint, w bigint, elements array<bigint>",
        make,
    )


def _near_links(differences: DataFrame) -> DataFrame:
    """Links that need no comparison: to the hub, and to the set nearest to the reference."""
    nearest = materialise(
        differences.groupBy("a").agg(F.min(F.struct("w", "b")).alias("nearest"))
    )
    near = _by_hub(differences.select("a", "b", "w"), nearest).where(
        (F.col("w") + F.col("nearest.w") <= 0) & (F.col("b") != F.col("nearest.b"))
    )
    return differences.where(F.col("linked") & (F.col("a") != F.col("b"))).select("a", "b").unionByName(
        near.select(F.col("nearest.b").alias("a"), "b")
    )


def _pairs_by_difference(differences: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets of one hub in different groups whose differences may share enough."""
    whole = 2 * (100 + percent)
    named = differences.select("a", "b", "n", "w", "elements").join(
        labels.select(F.col("node").alias("b"), F.col("component").alias("label")), "b", "left"
    )
    named = materialise(named.withColumn("label", F.coalesce("label", "b")))
    sizes = materialise(
        named.groupBy("a", "label").agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("w"))
    )
    mains = sizes.groupBy("a").agg(
        F.max_by("label", F.struct("n", -F.col("label"))).alias("main"), F.count(F.lit(1)).alias("labels")
    )
    # hubs whose sets are all in one group are done
    mains = mains.where("labels > 1").select("a", "main")
    least = (
        _by_hub(sizes, materialise(mains))
        .groupBy("a", "main")
        .agg(
            F.min(F.when(F.col("label") == F.col("main"), F.col("w"))).alias("w_main"),
            F.min(F.when(F.col("label") != F.col("main"), F.col("w"))).alias("w_other"),
        )
    )
    sets = _by_hub(named, materialise(least)).withColumn("other", F.col("label") != F.col("main"))
    # a partner lacks at most n (100 - p) / p of a set's elements
    apart = F.floor(F.col("n") * (100 - percent) / percent)
    sets = sets.withColumn("least", F.size("elements") - apart)
    columns = ["a", "b", "n", "w", "least", "w_main", "w_other", "other", "label"]
    # an element matters if a set of another label than the main one holds it, and two labels do
    single = materialise(sets.select(*columns, F.explode("elements").alias("element")))
    often = (
        single.groupBy("a", "element")
        .agg(
            F.count(F.lit(1)).alias("df"), F.min("label").alias("low"), F.max("label").alias("high"),
        )
        .where(F.col("low") != F.col("high"))
        .select("a", "element", "df")
    )
    listed = materialise(
        single.join(often, ["a", "element"])
        .groupBy(*columns)
        .agg(F.sort_array(F.collect_list(F.struct("df", "element"))).alias("shared"))
    )

    def entries(side: str, other: bool, partner: str) -> DataFrame:
        """Listed elements of sets that meet partners of at least the w in the column ``partner``;
        ``left`` counts a set's elements from the listed one on."""
        must = F.greatest(F.ceil((F.col("w") + F.col(partner)) / whole), "least", F.lit(1))
        room = (F.size("shared") - must + 1).cast("int")
        rows = listed.where("other" if other else "NOT other").withColumn("room", room)
        return rows.where(F.col("room") > 0).select(
            "a", F.col("b").alias(f"id_{side}"), F.col("n").alias(f"n_{side}"), F.col("w").alias(f"w_{side}"),
            F.col("label").alias(f"label_{side}"), F.size("shared").alias("size"),
            F.posexplode(F.slice("shared", F.lit(1), F.col("room"))).alias("place", "entry"),
        ).select(
            "a", F.col("entry.element").alias("element"), f"id_{side}", f"n_{side}", f"w_{side}", f"label_{side}",
            (F.col("size") - F.col("place")).alias(f"left_{side}"),
        )

    # At their first common element, as many elements must be left as the two have to share.
    enough = F.least("left_x", "left_y") * whole >= F.col("w_x") + F.col("w_y")
    enough = enough & (F.col("label_x") != F.col("label_y"))
    enough = enough & (F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * percent)
    on = ["a", "element"]
    both = entries("x", True, "w_other").join(entries("y", True, "w_other"), on)
    mixed = entries("x", True, "w_main").join(entries("y", False, "w_other"), on)
    return (
        both.where((F.col("id_x") < F.col("id_y")) & enough)
        .select("id_x", "id_y")
        .unionByName(mixed.where(enough).select("id_x", "id_y"))
        .select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b"))
        .distinct()
    )


def _full_sets(documents: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    def make():
        hasher = SpanHasher()

        def work(batch):
            texts = batch["text"].to_pylist()
            return {
                "id": batch["id"],
                "hashes": [shingle_hashes(hasher, t, words).tobytes() for t in texts],
            }

        return work

    wanted = documents.select(F.col("doc_id").alias("id"), "text").join(ids, "id", "left_semi")
    return map_rows(wanted, "id bigint, hashes binary", make)


def near_duplicates(
    documents: DataFrame, words: int = 5, percent: int = 80, k: int = 64
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and kept.

    Words are runs outside [\\x20\\x09-\\x0D] with A-Z lower-cased. A document's set holds its
    distinct ``words``-word shingles, the whole word sequence if it is shorter, and nothing for null
    or blank texts, which link with nothing. Two documents are linked if 100 * common shingles >=
    ``percent`` * all shingles; ``component_id`` is the smallest doc_id reachable over links, and
    ``kept`` marks the document with that id. Rows repeating a doc_id should repeat its text; each
    gets its row. A null doc_id takes part in nothing, has a null component and is kept.
    """
    rows = materialise(sketches(documents, words, k))
    sets = materialise(
        rows.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
        .groupBy("digest")
        .agg(
            F.min("doc_id").alias("id"),
            F.first("n_shingles").alias("n"),
            F.first("sketch").alias("sketch"),
        )
    )
    entries = materialise(_entries(sets, percent, k))
    ids = entries.select("id").distinct()
    shingles = materialise(_full_sets(documents, ids, words))

    lists = entries.groupBy("value", "class").agg(
        F.count(F.lit(1)).alias("members"),
        F.min(F.struct(-F.col("room"), "n", "id")).alias("hub"),
    )
    met = materialise(
        entries.join(lists.where(F.col("members") > 1), ["value", "class"]).select(
            "value", "class", "id", "n", "members", F.col("hub.id").alias("hub")
        )
    )
    short = met.where(F.col("members") <= SHORT_LIST).select("value", "class", "id", "n")
    pairs = (
        short.withColumnsRenamed({"id": "a", "n": "n_a"})
        .join(short.withColumnsRenamed({"id": "b", "n": "n_b"}), ["value", "class"])
        .where((F.col("a") < F.col("b")) & _similar_sizes(percent))
        .select("a", "b")
        .distinct()
    )
    likely = _estimated(pairs, sets, percent, k)
    stars = materialise(
        met.where(F.col("members") > SHORT_LIST)
        .select(F.col("hub").alias("a"), F.col("id").alias("b"))
        .distinct()
    )
    stars = materialise(_fewer_hubs(stars, sets, k))
    references = _references(stars, shingles)
    differences = materialise(_differences(stars, references, shingles, percent))
    found = materialise(
        _confirmed(likely, shingles, percent).unionByName(_near_links(differences))
    )
    labels = components(found)
    more = _pairs_by_difference(differences, labels, percent)
    later = materialise(_confirmed(_estimated(more, sets, percent, k), shingles, percent))
    if not later.isEmpty():
        # what the groups found first are joined to, by their labels
        labels = components(later.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    groups = sets.join(labels, sets["id"] == labels["node"], "left").select(
        "digest", F.coalesce("component", "id").alias("component")
    )
    return rows.join(groups, "digest", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNull(), F.lit(None))
        .otherwise(F.coalesce("component", "doc_id"))
        .cast("bigint")
        .alias("component_id"),
        F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
