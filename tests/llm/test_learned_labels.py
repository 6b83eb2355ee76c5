import random
import zlib
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import centroids, toxicity
from tallyframe.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def graded_texts(n=900, seed=1):
    rng = random.Random(seed)
    plain = [f"w{i}" for i in range(300)]
    mild, strong = ["dull", "silly"], ["awful", "vilest", "vilely"]
    rows = []
    for i in range(n):
        grade = rng.choice([0, 0, 0, 1, 2])
        text = rng.choices(plain, k=rng.randint(20, 80))
        for _ in range(2 if grade else 0):
            text.insert(rng.randrange(len(text)), rng.choice(mild if grade == 1 else strong))
        rows.append((i, " ".join(text), grade))
    return rows


def test_grades_of_unseen_texts(spark):
    rows = graded_texts()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, grade int")
    model = toxicity.learn(df.where("doc_id < 600"), flag_grades=False)
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    found = {r.doc_id: r for r in toxicity.grade_documents(df, model).collect()}
    late = [(found[i], g) for i, _, g in rows if i >= 600]
    assert np.mean([r.grade == g for r, g in late]) > 0.93
    assert np.mean([r.toxic == (g > 0) for r, g in late]) > 0.97
    severity = [np.mean([r.expected_severity for r, g in late if g == k]) for k in range(3)]
    assert severity[0] < 0.3 < severity[1] < severity[2] <= 2


def test_edges_of_grading(spark):
    rows = graded_texts(300)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, grade int")
    model = toxicity.learn(df.unionByName(df.limit(3).withColumn("grade", F.lit(None).cast("int"))))
    odd = [(1, None), (2, ""), (None, "vilest awful dull silly"), (2, ""), (5, "vilest " * 40000), (6, "¡¿ — 42")]
    texts = spark.createDataFrame(odd, "doc_id bigint, text string").selectExpr("*", "'g' AS grade", "1 AS toxic")
    out = toxicity.grade_documents(texts, model).collect()
    assert len(out) == 6
    assert {r.doc_id for r in out if r.toxic} >= {None, 5} and not any(r.toxic for r in out if r.doc_id in (1, 2))
    kept = toxicity.clean_documents(texts, model)
    assert kept.columns == texts.columns and {r.doc_id for r in kept.collect()} == {1, 2, 6}
    assert toxicity.grade_documents(texts.limit(0), model).collect() == []
    for nothing in (df.limit(0), df.where("grade = 0"), df.where("grade = 1")):
        model = toxicity.learn(nothing)
        assert not any(r.toxic for r in toxicity.grade_documents(texts, model).collect())


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(3)
    rows = [SimpleNamespace(places=list(np.flatnonzero(rng.random(6) < 0.4)), counts=None) for _ in range(400)]
    for r in rows:
        r.counts = [1] * len(r.places)
    truth = np.array([2.0, -1.0, 0.5, 0.0, 1.0, -2.0])
    scores = np.array([np.log(2) * truth[r.places].sum() for r in rows])
    grades = (scores + rng.logistic(size=400) > 0.2).astype(int) + (scores + rng.logistic(size=400) > 1.5)
    model = toxicity.fit(rows, grades, np.arange(6).astype(np.uint64), steps=1500)

    def loss(weights, thresholds):
        s = np.array([np.log(2) * weights[r.places].sum() for r in rows])
        above = 1 / (1 + np.exp(-(s[:, None] - thresholds)))
        full = np.concatenate((np.ones((400, 1)), above, np.zeros((400, 1))), axis=1)
        i = np.arange(400)
        return -np.log(full[i, grades] - full[i, grades + 1]).mean()

    best = loss(model.weights, model.thresholds)
    for _ in range(40):  # no small step is better
        assert loss(model.weights + rng.normal(0, 0.05, 6), model.thresholds + rng.normal(0, 0.05, 2)) > best - 1e-4


def test_severity_from_flags(spark):
    df = spark.createDataFrame([(i, t, int(g > 0)) for i, t, g in graded_texts()], "doc_id bigint, text string, toxic int")
    labels = df.select("doc_id", "toxic").unionByName(df.limit(0).select("doc_id", "toxic"))
    labelled = toxicity.sample_labelled(df.select("doc_id", "text"), labels)
    model = toxicity.learn(labelled)
    out = toxicity.grade_documents(df, model).join(labels.withColumnRenamed("toxic", "truth"), "doc_id").collect()
    assert np.mean([r.toxic == (r.truth == 1) for r in out]) > 0.98


def test_language_of_held_out_texts(spark):
    found = QUERIES["op6_language_id"](spark, FOLDER).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert len(found) == len(truth)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
    held = [r for r in found if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98


@pytest.fixture(scope="module")
def model(spark):
    texts = [(i, f"the house and the garden number {i} of this street", "en") for i in range(40)]
    texts += [(100 + i, f"das Haus und der Garten Nummer {i} in dieser Straße", "de") for i in range(40)]
    texts += [(300, None, "en"), (301, "42", "xx"), (302, "quelque chose", None)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string, lang string").selectExpr("*", "1 AS rows_", "2 AS centroid")
    return centroids.learn(df, places=512, groups=3)


def test_edges_of_language(spark, model):
    odd = [(1, None), (2, ""), (3, "12 ... 42!"), (4, "der Garten"), (4, "der Garten"), (None, "THE GARDEN"), (6, "日本語の文"), (7, "the house " * 30000)]
    df = spark.createDataFrame(odd, "doc_id bigint, text string").selectExpr("*", "'fr' AS lang", "0.5 AS score")
    rows = centroids.predict(df, model).collect()
    assert [(r.doc_id, r.lang_pred) for r in rows if r.doc_id != 6] == [(1, "und"), (2, "und"), (3, "und"), (4, "de"), (4, "de"), (None, "en"), (7, "en")]
    assert [r.rejected for r in rows if r.doc_id in (1, 6)] == [True, True]
    assert all(0 <= r.score <= 1 for r in rows)
    assert centroids.predict(df.limit(0), model).collect() == []
    none = centroids.learn(df.limit(0).select("doc_id", "text", "lang"), places=64)
    assert {r.lang_pred for r in centroids.predict(df, none).collect()} == {"und"}


def test_clusters_part_what_is_apart():
    rng = np.random.default_rng(0)
    centres = np.eye(6)[:3]
    rows = np.concatenate([c + rng.normal(0, 0.02, (30, 6)) for c in centres]).astype(np.float32)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    found = centroids.cluster(rows, 3)
    assert np.allclose(np.sort((found @ centres.T).max(axis=0)), 1, atol=0.01)
