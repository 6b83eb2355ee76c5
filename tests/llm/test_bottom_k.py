import random
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import bottom_k
from tallyframe.llm.components import components
from tallyframe.llm.shared import SpanHasher, shingle_hashes


def words_of(text):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    text = (text or "").translate(fold)
    for c in "\x09\x0a\x0b\x0c\x0d":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def shingles(text, width):
    w = words_of(text)
    return {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set()


def groups(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain(texts, width):
    sets = {i: shingles(t, width) for i, t in texts}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    label = groups(sets, links)
    return sorted((i, len(s), label[i], label[i] == i) for i, s in sets.items())


def sample(seed=3):
    """Copies, chains of near copies, a large group around one text, and a frequent passage."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = text(25)
    out = []
    for _ in range(12):
        base = text(rng.choice([3, 6, 30, 80, 200]))
        for _ in range(rng.randint(1, 6)):
            changed = list(base)
            for _ in range(rng.randint(0, 3)):
                changed[rng.randrange(len(changed))] = rng.choice(vocabulary)
            out.append(changed)
            if rng.random() < 0.3:
                base = changed
    hub = text(120)
    for i in range(60):
        changed = list(hub)
        for place in rng.sample(range(120), 3):
            changed[place] = f"x{i}"
        out.append(changed)
    out += [text(20) + passage + text(10) for _ in range(40)]
    out += [hub] * 5
    texts = [(7 * i % 1009, rng.choice([" ", "\n", " \t"]).join(t)) for i, t in enumerate(out)]
    return texts + [(2000, None), (2001, ""), (2002, " \n "), (2003, "One Word"), (2004, "one word"), (2005, "ÀÉ word"), (2006, "àé word")]


@pytest.mark.parametrize(("width", "seed"), [(4, 3), (5, 4)])
def test_against_all_pairs(spark, width, seed):
    texts = sample(seed)
    df = spark.createDataFrame(texts, "doc_id bigint, text string").selectExpr("*", "'x' AS id", "1 AS n", "2 AS digest", "true AS kept")
    rows = bottom_k.near_duplicates(df, words=width).collect()
    assert sorted(tuple(r) for r in rows) == plain(texts, width)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_links_inside_large_groups(spark, monkeypatch, seed):
    """Clouds of copies around an original, near the limit of similarity, all compared by hubs."""
    monkeypatch.setattr(bottom_k, "SHORT_LIST", 3)
    monkeypatch.setattr(bottom_k, "ASKED", 5)
    rng = random.Random(seed)
    texts, number = [], 0
    for size in (30, 45, 60):
        original = [f"o{seed}{size}{i}" for i in range(size)]
        for k in range(45):
            changed = list(original)
            # places from a few, so that copies share changes; some words from a few, too
            for place in rng.sample(range(0, size, rng.choice([2, 5, 9])), rng.randint(0, 3)):
                changed[place] = rng.choice([f"n{rng.randrange(3)}", f"x{number}"])
            if rng.random() < 0.2:
                changed += [f"t{rng.randrange(9)}" for _ in range(rng.randint(1, 12))]
            texts.append((number, " ".join(changed)))
            number += 1
    texts += [(5000 + i, " ".join(f"o{seed}30{k}" for k in range(30)) + f" z{i}") for i in range(30)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    for width in (2, 5):
        rows = bottom_k.near_duplicates(df, words=width).collect()
        assert sorted(tuple(r) for r in rows) == plain(texts, width)


def changed_copies(size, seed):
    """Copies of one text changed at so many places, by words of a few, that hardly two are linked."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(150)]
    texts = [[w if rng.random() > 0.05 else f"v{rng.randrange(3)}{w}" for w in base] for _ in range(size)]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_sets_of_many_lists_are_compared_once(spark, monkeypatch):
    """A group's lists have several hubs; its elements are listed for one of them, not for each."""
    monkeypatch.setattr(bottom_k, "SHORT_LIST", 8)
    listed = []

    def materialise(df, kept=bottom_k.materialise):
        df = kept(df)
        if "element" in df.columns:
            listed.append(df.count())
        return df

    monkeypatch.setattr(bottom_k, "materialise", materialise)
    texts = changed_copies(size=60, seed=1)
    rows = bottom_k.near_duplicates(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    expected = plain(texts, 5)
    assert sorted(tuple(r) for r in rows) == expected
    assert len(listed) == 1 and listed[0] <= sum(n for _, n, _, _ in expected)


def test_hubs_unlike_each_other_stay(spark):
    """Hubs 1 and 2 are alike; 3 shares a list with both, but no shingles to speak of."""
    values = {1: range(64), 2: range(10, 74), 3: range(500, 564)}
    sets = spark.createDataFrame([(i, list(v)) for i, v in values.items()], "id bigint, sketch array<bigint>")
    under = {1: [1, 2, 3, 4, 5], 2: [1, 2, 6], 3: [3, 7]}
    stars = spark.createDataFrame([(a, b) for a, bs in under.items() for b in bs], "a bigint, b bigint")
    found = sorted(tuple(r) for r in bottom_k._fewer_hubs(stars, sets, 64).collect())
    assert found == [(1, b) for b in (1, 2, 3, 4, 5, 6)] + [(3, 3), (3, 7)]


def test_long_texts(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(9000)}" for _ in range(20000)]
    near = list(base)
    for i in range(0, 20000, 120):
        near[i] = "other"
    texts = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base[:9000]))]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    assert sorted(tuple(r) for r in bottom_k.near_duplicates(df).collect()) == plain(texts, 5)


def test_repeats_nulls_and_empty_table(spark):
    df = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (9, "A b c d e f")], "doc_id bigint, text string")
    rows = bottom_k.near_duplicates(df).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in rows) == [(0, None, True), (5, 5, True), (5, 5, True), (9, 5, False)]
    assert bottom_k.near_duplicates(df.limit(0)).collect() == []


def test_components_of_random_links(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, k) for k in range(501, 560)]
    found = dict(components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert found == groups(nodes, links)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("abAB é\n\t\x0b\x85\xa0"), max_size=60), st.integers(1, 5))
def test_hashed_shingles_count_the_same(text, width):
    found = shingle_hashes(SpanHasher(), text, width)
    assert len(found) == len(shingles(text, width))
    assert np.array_equal(found, shingle_hashes(SpanHasher(), "  " + text.replace(" ", "\r\n"), width))
