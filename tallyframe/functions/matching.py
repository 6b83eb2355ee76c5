"""Order-dependent list matching, written as folds over arrays.

Label entries are ``array<struct<key, label, alternatives: array<string>, type>>`` in the
order of the re-annotation.
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.text import let, split_list, strip, words

ENTRY_TYPE = "array<struct<key:string,label:string,alternatives:array<string>,type:string>>"


def label_entries(labels: Column) -> Column:
    """Entries of a ``map<text, struct<label, alternative_labels, type>>`` in map order."""
    return F.transform(
        F.map_entries(labels),
        lambda e: F.struct(
            e["key"].alias("key"),
            e["value"]["label"].alias("label"),
            F.coalesce(
                e["value"]["alternative_labels"], F.array().cast("array<string>")
            ).alias("alternatives"),
            e["value"]["type"].alias("type"),
        ),
    )


def word_f1(predicted: Column, truth: Column) -> Column:
    """F1 of two word lists: shared distinct words over the list lengths."""
    common = F.size(F.array_intersect(predicted, truth)).cast("double")
    shares = F.struct(
        F.coalesce(F.try_divide(common, F.size(predicted)), F.lit(0.0)).alias("p"),
        F.coalesce(F.try_divide(common, F.size(truth)), F.lit(0.0)).alias("r"),
    )
    return let(
        shares,
        lambda s: F.coalesce(
            F.try_divide(F.lit(2.0) * (s["p"] * s["r"]), s["p"] + s["r"]), F.lit(0.0)
        ),
    )


def _greedy(predicted: Column, truths: Column) -> Column:
    """Give each predicted text, in order, the best still free truth.

    ``truths`` holds structs of a ``key`` and ``forms`` (word lists); the first of equally
    good ones wins and a truth without a shared word is never taken. Returns the taken keys
    and the summed F1.
    """
    start = F.struct(
        F.array().cast("array<string>").alias("taken"), F.lit(0.0).cast("double").alias("total")
    )

    def best(bound: Column, acc: Column, text: Column) -> Column:
        return let(
            words(F.lower(text)),
            lambda w: F.array_max(
                F.transform(
                    bound,
                    lambda t, i: F.struct(
                        F.when(F.array_contains(acc["taken"], t["key"]), F.lit(0.0))
                        .otherwise(F.array_max(F.transform(t["forms"], lambda f: word_f1(w, f))))
                        .alias("f1"),
                        (-i).alias("order"),
                        t["key"].alias("key"),
                    ),
                )
            ),
        )

    def step(bound: Column) -> Callable[[Column, Column], Column]:
        return lambda acc, text: let(
            best(bound, acc, text),
            lambda b: F.when(
                b["f1"] > 0,
                F.struct(
                    F.array_append(acc["taken"], b["key"]).alias("taken"),
                    (acc["total"] + b["f1"]).alias("total"),
                ),
            ).otherwise(acc),
        )

    return let(truths, lambda bound: F.aggregate(predicted, start, step(bound)))


def entity_f1(prediction: Column, label: Column) -> Column:
    """Greedy best-match F1 of two ``;`` lists over the longer length; NULL prediction is 0."""
    truths = F.transform(
        split_list(label),
        lambda t: F.struct(t.alias("key"), F.array(words(F.lower(t))).alias("forms")),
    )
    longer = F.greatest(F.size(split_list(prediction)), F.size(split_list(label)))
    return F.when(prediction.isNull(), F.lit(0.0)).otherwise(
        _greedy(split_list(prediction), truths)["total"] / longer
    )


def relabeled_f1(prediction: Column, entries: Column, unanswerable: Column) -> Column:
    """Greedy F1 against re-annotated labels and their alternatives.

    Labels nobody matched lengthen the denominator unless they are mere candidates.
    """
    truths = F.transform(
        entries,
        lambda e: F.struct(
            e["key"].alias("key"),
            F.transform(
                F.concat(F.array(e["key"]), e["alternatives"]), lambda t: words(F.lower(t))
            ).alias("forms"),
        ),
    )
    predicted = split_list(prediction)

    def average(result: Column) -> Column:
        missed = F.filter(
            entries,
            lambda e: (e["type"] != "label_candidate")
            & ~F.array_contains(result["taken"], e["key"]),
        )
        return result["total"] / (F.size(predicted) + F.size(missed))

    return (
        F.when((prediction == "") & unanswerable, F.lit(1.0))
        .when((prediction == "") & ~unanswerable, F.lit(0.0))
        .when(prediction.isNull(), F.lit(0.0))
        .otherwise(let(_greedy(predicted, truths), average))
    )


def label_matches(original: Column, entries: Column, unanswerable: Column) -> Column:
    """Does an original ``;`` label agree with its re-annotation?

    Each entry consumes every equal original, by its key or else by its alternatives. An
    entry without a match is a mismatch unless it is a candidate; so is a left-over original.
    """
    start = F.struct(split_list(original).alias("rest"), F.lit(True).alias("ok"))

    def step(acc: Column, entry: Column) -> Column:
        key = strip(entry["key"])
        forms = F.when(F.array_contains(acc["rest"], key), F.array(key)).otherwise(
            F.transform(entry["alternatives"], strip)
        )
        return let(
            forms,
            lambda f: F.struct(
                F.filter(acc["rest"], lambda r: ~F.array_contains(f, r)).alias("rest"),
                (
                    acc["ok"]
                    & (F.arrays_overlap(acc["rest"], f) | (entry["type"] == "label_candidate"))
                ).alias("ok"),
            ),
        )

    flagged = F.coalesce(unanswerable, F.lit(False))
    return (
        F.when(original.isNull(), F.lit(False))
        .when((original == "") & flagged, F.lit(True))
        .when((original != "") & flagged & (F.size(entries) == 0), F.lit(False))
        .otherwise(
            let(
                F.aggregate(entries, start, step), lambda r: r["ok"] & (F.size(r["rest"]) == 0)
            )
        )
    )


def flat_labels(entries: Column, other_texts: Column) -> Column:
    """All label texts of a re-annotation, stripped, lower-cased and distinct."""
    none = F.array().cast("array<string>")
    texts = F.concat(
        F.transform(entries, lambda e: e["key"]),
        F.flatten(F.transform(entries, lambda e: e["alternatives"])),
        F.coalesce(other_texts, none),
    )
    return F.array_distinct(F.transform(texts, lambda t: F.lower(strip(t))))


def set_iou(a: Column, b: Column) -> Column:
    """Shared over united size of two distinct lists; NULL if both are empty."""
    return let(
        F.struct(a.alias("a"), b.alias("b")),
        lambda s: F.try_divide(
            F.size(F.array_intersect(s["a"], s["b"])).cast("double"),
            F.size(F.array_union(s["a"], s["b"])).cast("double"),
        ),
    )


def contained_pair_ratio(a: Column, b: Column) -> Column:
    """Pairs equal or contained either way, over the united size. May exceed 1."""

    def ratio(s: Column) -> Column:
        pairs = F.aggregate(
            s["a"],
            F.lit(0),
            lambda n, x: n
            + F.size(F.filter(s["b"], lambda y: F.contains(x, y) | F.contains(y, x))),
        )
        return F.try_divide(
            pairs.cast("double"), F.size(F.array_union(s["a"], s["b"])).cast("double")
        )

    return let(F.struct(a.alias("a"), b.alias("b")), ratio)


def entity_iou(a: Column, b: Column, labels_only: bool = False) -> Column:
    """Greedy one-to-one entity overlap by containment between any two forms; 0 if empty."""

    def forms(entries: Column) -> Column:
        kept = F.filter(entries, lambda e: e["type"] == "label") if labels_only else entries
        return F.transform(
            kept,
            lambda e: F.transform(F.concat(F.array(e["label"]), e["alternatives"]), F.lower),
        )

    def touches(x: Column, y: Column) -> Column:
        return F.exists(
            x, lambda p: F.exists(y, lambda q: F.contains(p, q) | F.contains(q, p))
        )

    def overlap(pair: Column) -> Column:
        def step(used: Column, entity: Column) -> Column:
            free = F.filter(
                F.transform(
                    pair["b"],
                    lambda other, j: F.when(
                        ~F.array_contains(used, j) & touches(entity, other), j
                    ),
                ),
                lambda j: j.isNotNull(),
            )
            return let(
                F.array_min(free),
                lambda j: F.when(j.isNull(), used).otherwise(F.array_append(used, j)),
            )

        used = F.aggregate(pair["a"], F.array().cast("array<int>"), step)
        return let(
            F.size(used),
            lambda n: F.coalesce(
                F.try_divide(
                    n.cast("double"), (F.size(pair["a"]) + F.size(pair["b"]) - n).cast("double")
                ),
                F.lit(0.0),
            ),
        )

    return let(F.struct(forms(a).alias("a"), forms(b).alias("b")), overlap)
