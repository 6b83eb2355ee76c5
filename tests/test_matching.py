"""List matching against rules written independently as plain functions."""

import random

from pyspark.sql import functions as F

from tallyframe.functions import matching

WORDS = ["red", "Blue", "green", "tea", "red tea", "green Tea cup", "", "cup of tea", "blue blue"]
PAIR = "p string, l string"


def parts(value):
    return [x.strip() for x in value.split(";")]


def f1_of(a, b):
    a, b = a.lower().split(), b.lower().split()
    common = len(set(a) & set(b))
    if not a or not b or not common:
        return 0.0
    p, r = common / len(a), common / len(b)
    return 2 * (p * r) / (p + r)


def greedy(predicted, truths):
    """truths: list of (key, forms). Returns taken keys and total."""
    taken, total = [], 0.0
    for text in predicted:
        scored = [
            (0.0 if key in taken else max(f1_of(text, f) for f in forms), -i, key)
            for i, (key, forms) in enumerate(truths)
        ]
        top = max(scored, default=(0.0, 0, None))
        if top[0] > 0:
            taken.append(top[2])
            total += top[0]
    return taken, total


def random_list(rng):
    return " ; ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4)))


def random_entries(rng):
    keys = rng.sample([w for w in WORDS if w], rng.randint(0, 3))
    return [
        (
            rng.choice([k, f" {k} "]), k,
            [rng.choice(WORDS) for _ in range(rng.randint(0, 2))],
            rng.choice(["label", "label", "label_candidate", "label_candidate_part"]),
        )
        for k in keys
    ]


def test_entity_f1(evaluate):
    rng = random.Random(1)
    rows = [(random_list(rng), random_list(rng)) for _ in range(400)] + [(None, "a"), ("", "")]

    def rule(p, label):
        if p is None:
            return 0.0
        _, total = greedy(parts(p), [(t, [t]) for t in parts(label)])
        return total / max(len(parts(p)), len(parts(label)))

    got = evaluate(rows, PAIR, matching.entity_f1(F.col("p"), F.col("l")))
    assert got == [rule(*r) for r in rows]


REL = f"o string, e {matching.ENTRY_TYPE}, u boolean"


def relabeled_rows(seed):
    rng = random.Random(seed)
    rows = [
        (random_list(rng), random_entries(rng), rng.choice([True, False, None]))
        for _ in range(400)
    ]
    return rows + [("", [], True), ("", [], False), (None, [], False), ("x", [], True)]


def matches(original, entries, unanswerable):
    if original is None:
        return False
    if unanswerable and original == "":
        return True
    if unanswerable and not entries:
        return False
    rest = parts(original)
    for key, _label, forms, kind in entries:
        wanted = {key.strip()} if key.strip() in rest else {f.strip() for f in forms}
        hit = wanted & set(rest)
        rest = [x for x in rest if x not in wanted]
        if not hit and kind != "label_candidate":
            return False
    return not rest


def test_label_matches(evaluate):
    rows = relabeled_rows(2)
    got = evaluate(rows, REL, matching.label_matches(F.col("o"), F.col("e"), F.col("u")))
    assert got == [matches(*r) for r in rows]
    assert 0 < sum(got) < len(got)


def test_label_match_by_hand(evaluate):
    rows = [
        ("a", [("a", "a", [], "label")], False),
        ("b", [("a", "a", ["b"], "label")], False),
        ("a", [("a", "a", [], "label"), ("c", "c", [], "label_candidate")], False),
        ("a ; d", [("a", "a", [], "label")], False),
        ("a ; a", [("a", "a", [], "label")], False),
        ("", [], True),
        ("x", [], True),
    ]
    got = evaluate(rows, REL, matching.label_matches(F.col("o"), F.col("e"), F.col("u")))
    assert got == [True, True, True, False, True, True, False]


def test_relabeled_f1(evaluate):
    rows = relabeled_rows(3)

    def rule(prediction, entries, unanswerable):
        if prediction is None:
            return 0.0
        if prediction == "" and unanswerable is not None:
            return 1.0 if unanswerable else 0.0
        taken, total = greedy(parts(prediction), [(e[0], [e[0], *e[2]]) for e in entries])
        missed = [e for e in entries if e[3] != "label_candidate" and e[0] not in taken]
        return total / (len(parts(prediction)) + len(missed))

    got = evaluate(rows, REL, matching.relabeled_f1(F.col("o"), F.col("e"), F.col("u")))
    assert got == [rule(*r) for r in rows]


def test_agreement_values(evaluate):
    rng = random.Random(4)
    rows = [
        (random_entries(rng), random_entries(rng), rng.choice([None, [" Tea", "other"]]))
        for _ in range(300)
    ]
    schema = f"a {matching.ENTRY_TYPE}, b {matching.ENTRY_TYPE}, o array<string>"

    def flat(entries, others):
        texts = [e[0] for e in entries] + [f for e in entries for f in e[2]] + (others or [])
        return {t.strip().lower() for t in texts}

    def rule(a, b, others):
        x, y = flat(a, others), flat(b, None)
        size = len(x | y)
        iou = len(x & y) / size if size else None
        near = sum(1 for p in x for q in y if p in q or q in p)
        return iou, near / size if size else None

    def entity_rule(a, b, only):
        keep = [
            [[f.lower() for f in [e[1], *e[2]]] for e in side if not only or e[3] == "label"]
            for side in (a, b)
        ]
        free = list(range(len(keep[1])))
        n = 0
        for forms in keep[0]:
            hit = next(
                (j for j in free if any(p in q or q in p for p in forms for q in keep[1][j])), None
            )
            if hit is not None:
                free.remove(hit)
                n += 1
        union = len(keep[0]) + len(keep[1]) - n
        return n / union if union else 0.0

    none = F.lit(None).cast("array<string>")
    fa, fb = matching.flat_labels(F.col("a"), F.col("o")), matching.flat_labels(F.col("b"), none)
    values = F.struct(
        matching.set_iou(fa, fb),
        matching.contained_pair_ratio(fa, fb),
        matching.entity_iou(F.col("a"), F.col("b")),
        matching.entity_iou(F.col("a"), F.col("b"), labels_only=True),
    )
    got = [tuple(g) for g in evaluate(rows, schema, values)]
    want = [
        (*rule(*r), entity_rule(r[0], r[1], False), entity_rule(r[0], r[1], True)) for r in rows
    ]
    assert got == want


def test_map_entries_keep_order(spark):
    from tallyframe import schemas

    text = (
        '{"label": {"z": {"label": "z", "alternative_labels": ["q"], "type": "label"}, '
        '"a": {"label": "a", "type": "label_candidate"}}}'
    )
    df = spark.createDataFrame([(text,)], "j string").select(
        F.from_json("j", f"label {schemas.LABEL_MAP}").alias("r")
    )
    entries = df.select(matching.label_entries(F.col("r.label"))).first()[0]
    assert [(e.key, e.alternatives, e.type) for e in entries] == [
        ("z", ["q"], "label"), ("a", [], "label_candidate"),
    ]
