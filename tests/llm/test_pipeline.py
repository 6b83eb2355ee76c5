"""The whole pipeline against plain versions of its stages, on a small set of planted texts."""

import random

import corpus_pipeline
from test_bottom_k import plain as near_plain
from test_line_runs import FOLD
from test_packing import check_packing

SLURS = ["vilest", "awful", "rotten"]
LICENCE = "this text may be copied by anyone under these terms"


def corpus():
    rng = random.Random(9)
    text = lambda n: [f"w{rng.randrange(2500)}" for _ in range(n)]
    benchmark = [(i, " ".join(text(25))) for i in range(6)]
    docs, toxic, leaked = {}, set(), set()
    for i in range(240):
        words = text(rng.randint(30, 120))
        if i % 6 == 0:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(SLURS))
            toxic.add(i)
        elif i % 17 == 0:
            words += benchmark[i % 6][1].split()
            leaked.add(i)
        docs[i] = " ".join(words)
    for i in range(240, 300):  # near copies of clean documents, or one line in common
        if i % 2:
            words = docs[rng.choice([k for k in range(1, 240, 6)])].split()
            words[rng.randrange(len(words))] = "changed"
            docs[i] = " ".join(words)
        else:
            docs[i] = " ".join(text(40)) + "\n" + LICENCE.title()
    docs |= {301: None, 302: "", 303: docs[1]}
    return docs, benchmark, toxic


def test_pipeline(spark, tmp_path):
    docs, benchmark, toxic = corpus()
    folder = f"{tmp_path}/tables"
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i in toxic), 1) for i in range(0, 240)], "doc_id bigint, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")

    seen = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = seen.columns, []
    for name, stage in corpus_pipeline.STAGES:
        seen = stage(spark, seen, folder)
        if name != "packing":
            assert seen.columns == columns
        seen.write.parquet(f"{tmp_path}/{name}")
        seen = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(seen.collect())

    want = {i: t for i, t in docs.items() if i not in toxic}
    assert {r.doc_id: r.text for r in kept[0]} == want
    holders = [i for i, t in want.items() if LICENCE in (t or "").translate(FOLD)]
    want = {i: t if i not in holders or i == max(holders) else t.rsplit("\n", 1)[0] for i, t in want.items()}
    assert {r.doc_id: r.text for r in kept[1]} == want
    assert all(r.n_chars == len(r.text or "") for r in kept[1])
    want = {i: want[i] for i, _, _, keep in near_plain(list(want.items()), 5) if keep}
    assert {r.doc_id: r.text for r in kept[2]} == want
    want = {i: t for i, t in want.items() if not any(b in (t or "") for _, b in benchmark)}
    assert {r.doc_id: r.text for r in kept[3]} == want
    check_packing(kept[4], want, 1024)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in corpus_pipeline.run(spark, folder).collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in kept[4])


def test_empty_and_odd_tables(spark, tmp_path):
    folder = f"{tmp_path}/tables"
    docs = spark.createDataFrame([(None, None, "a"), (1, None, None), (2, "x y z", "b"), (2, "x y z", "b")], "doc_id bigint, text string, kept string").selectExpr("*", "1 AS digest", "array(2) AS row_")
    spark.createDataFrame([], "doc_id bigint, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    for start, sizes in ((docs, [4, 4, 3, 3, 3]), (docs.limit(0), [0] * 5)):
        seen = start
        for (_, stage), size in zip(corpus_pipeline.STAGES, sizes):
            seen = stage(spark, seen, folder)
            assert seen.count() == size
            if stage is not corpus_pipeline.pack:
                assert seen.columns == docs.columns
