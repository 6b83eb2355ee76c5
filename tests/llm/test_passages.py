import random

from tallyframe.llm import decontamination, passages


def words(rng, n, vocabulary=3000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def test_planted_passages_are_found_inside_lines(spark):
    rng = random.Random(4)
    planted = [words(rng, n) for n in (52, 60, 90)]
    texts, held = {}, {}
    for i in range(120):
        own = words(rng, rng.randint(40, 200))
        if i % 4 == 0:
            k, place = rng.randrange(3), rng.randint(0, len(own))
            own[place:place] = planted[k]
            held[i] = k
        sep = rng.choice([" ", "\n", ". "])
        texts[i] = sep.join(w.upper() if rng.random() < 0.2 else w for w in own)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").selectExpr("*", "'d' AS digest", "1 AS unit", "2 AS start")
    rows = passages.repeated_passages(df).collect()
    first = {k: min(i for i in held if held[i] == k) for k in set(held.values())}
    assert {r.doc_id for r in rows} == {i for i in held if i != first[held[i]]}
    for r in rows:
        cut = texts[r.doc_id][r.start : r.end].lower().replace(".", "").split()
        whole = planted[held[r.doc_id]]
        assert len(cut) == r.n_words >= len(whole) - 26
        assert any(whole[i : i + len(cut)] == cut for i in range(len(whole)))
        assert r.kept_doc_id < r.doc_id and held[r.kept_doc_id] == held[r.doc_id]


def test_cut_texts_and_edges(spark):
    rng = random.Random(6)
    copy = " ".join(words(rng, 80)) + " é\U0001f600 end"
    own = " ".join(words(rng, 40))
    rows = [(3, copy, 1), (4, f"{own} {copy} {own[::-1]}", 2), (5, None, 3), (6, "", 4), (3, copy, 5), (None, copy, 6), (8, "word " * 40000, 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, row_ int")
    out = {r.row_: r for r in passages.drop_passages(df).collect()}
    assert list(passages.drop_passages(df).columns) == ["doc_id", "text", "row_", "removed"]
    for k in (1, 3, 4, 5, 6, 7):
        assert out[k].text == rows[k - 1][1] and not out[k].removed
    ((start, end),) = out[2].removed
    whole = rows[1][1]
    assert out[2].text == whole[:start] + whole[end:]
    assert end - start > 0.8 * len(copy) and whole[start:end] in whole
    assert passages.repeated_passages(df.limit(0)).collect() == []


def test_repeats_within_a_text_go_after_the_first(spark):
    rng = random.Random(7)
    part = words(rng, 60)
    text = " ".join(words(rng, 30) + part + words(rng, 30) + part + words(rng, 30))
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    (row,) = passages.repeated_passages(df).collect()
    assert row.start > text.index(part[10]) and row.n_words >= 34


def test_lines_and_paragraphs_go_whatever_their_size(spark):
    rng = random.Random(9)
    own = [" ".join(words(rng, 40, 10**9)) for _ in range(12)]
    lines = [" ".join(words(rng, n, 10**9)) for n in (2, 10, 19, 30)]
    poem = "Rose\nis\n" + lines[1]
    texts = {
        1: "\n".join([own[0], *lines, own[1]]),
        2: "\n".join([own[2], lines[0], own[3], lines[1].upper() + ".", lines[2], own[4], "- " + lines[3]]),
        3: f"{own[5]}\n\n{poem}\n \n{own[6]}",
        4: f"{own[7]}\n--\n{poem}",
        5: "Short", 6: " short!\n", 7: "Short\n" + own[8], 8: lines[1], 9: f"{own[9]} {lines[1]} {own[10]}",
        10: f"{own[11]}\n{lines[2]}\n{lines[2]}",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    found = sorted(passages.repeated_passages(df).collect())
    cuts = [(r.doc_id, texts[r.doc_id][r.start : r.end], r.n_words, r.kept_doc_id) for r in found]
    assert cuts == [
        (2, lines[0], 2, 1),
        (2, f"{lines[1].upper()}.\n{lines[2]}", 29, 1),
        (2, lines[3], 30, 1),
        (3, lines[1], 10, 1),
        (4, poem, 12, 3),
        (6, "short", 1, 5),
        (8, lines[1], 10, 1),
        (10, f"{lines[2]}\n{lines[2]}", 38, 1),
    ]
    left = {r.doc_id: r.text for r in passages.drop_passages(df).collect()}
    assert left[6] == " !\n" and left[8] == "" and left[4] == own[7] + "\n--\n"
    assert all(left[i] == texts[i] for i in (1, 5, 7, 9))


def test_benchmark_with_changed_words(spark):
    rng = random.Random(8)
    items = [words(rng, n) for n in (15, 15, 24, 40, 59)] + [words(rng, 8), words(rng, 4), []]
    texts, planted = {}, set()
    for i in range(90):
        own = words(rng, rng.randint(0, 120))
        k = i % 9
        if k < 5:
            changed = list(items[k])
            for place in rng.sample(range(len(changed)), min(2, len(changed) // 10)):
                changed[place] = "changed"
            place = rng.randint(0, len(own))
            own[place:place] = changed
            planted.add((i, k))
        elif k == 5:
            own += items[5]
            planted.add((i, 5))
        elif k == 6:
            own += items[6]
        elif k == 7:
            own += items[4][20:34]
            planted.add((i, 4))
        texts[i] = ", ".join(own).title()
    texts |= {200: None, 201: "", 202: " ".join(items[3]) + " word" * 30000}
    planted.add((202, 3))
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").selectExpr("*", "'h' AS hash", "1 AS item_id", "2 AS words")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(90, None), (4, " ".join(items[4]))], "item_id bigint, text string").selectExpr("*", "0 AS place")
    rows = decontamination.contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == planted and len(rows) == len(planted)
    assert all(r.overlap >= min(10, r.item_words) for r in rows)
    assert decontamination.contaminated(df.limit(0), bench).collect() == []
    assert decontamination.contaminated(df, bench.limit(0)).collect() == []


def test_shuffled_seeds_give_the_same(spark, monkeypatch):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    df = spark.createDataFrame([(1, f"before {item} after"), (1, f"before {item} after"), (None, item)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, item), (None, item)], "item_id bigint, text string")
    want = sorted(map(str, decontamination.contaminated(df, bench).collect()))
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", -1)
    assert sorted(map(str, decontamination.contaminated(df, bench).collect())) == want
    assert len(want) == 4


def test_few_long_items_are_not_broadcast(spark, monkeypatch):
    rng = random.Random(10)
    texts = [words(rng, n, 10**9) for n in (20, 400)]
    df = spark.createDataFrame([(i, " ".join(["before"] * i + t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "item_id bigint, text string")

    def run():
        found = decontamination.contaminated(df, bench)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("strategy=broadcast"), sorted(found.collect())

    hints, want = run()
    assert hints == 2 and [(r.doc_id, r.item_id, r.overlap) for r in want] == [(0, 0, 20), (1, 1, 400)]
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 2000)
    assert run() == (1, want)
