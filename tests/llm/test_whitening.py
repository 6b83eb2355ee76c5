"""Whitening against numpy on whole arrays with exact integers."""

from pathlib import Path

import numpy as np
import pytest

from tallyframe.llm import whitening
from tallyframe.llm.queries import QUERIES


def plain(points, components=32):
    """points: {id: list of ints}. Exact deviations and double-precision components."""
    keys = list(points)
    n = len(keys)
    sums = [sum(points[k][d] for k in keys) for d in range(len(points[keys[0]]))]
    spread = {k: [n * v - s for v, s in zip(points[k], sums)] for k in keys}
    rows = np.array([[v / n for v in spread[k]] for k in keys])
    covariance = rows.T @ rows / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    kept = min(int((values > values[0] * 1e-11).sum()), components)
    whitened = rows @ axes[:, :kept] / np.sqrt(values[:kept])
    return {
        "n": n,
        "deviation": {k: sum(v * v for v in spread[k]) for k in keys},
        "whitened": {k: whitened[i] for i, k in enumerate(keys)},
        "explained": values[:kept] / np.trace(covariance),
    }


def check(rows, points, components=32, **close):
    want = plain(points, components)
    kept = len(want["explained"])
    assert len(rows) == len(points) * kept
    found = np.zeros((len(points), kept))
    place = {k: i for i, k in enumerate(points)}
    for r in rows:
        assert r.n == want["n"] and r.deviation == want["deviation"][r.vec_id]
        assert r.explained == pytest.approx(want["explained"][r.component - 1], rel=1e-9)
        assert r.identity_error < 1e-9
        found[place[r.vec_id], r.component - 1] = r.whitened
    wanted = np.array([want["whitened"][k] for k in points])
    signs = np.sign((found * wanted).sum(axis=0))
    np.testing.assert_allclose(found * signs, wanted, atol=1e-6, rtol=0)


def random_points(n, width, seed=0, shift=1_000_000):
    draw = np.random.default_rng(seed)
    mixed = draw.normal(size=(n, width)) @ (draw.normal(size=(width, width)) * np.linspace(1, 9, width))
    return {i: [int(v) + shift for v in row] for i, row in enumerate(mixed)}


def frame(spark, points, parts):
    rows = [(k, v, "x", 1) for k, v in points.items()]
    return spark.createDataFrame(rows, "vec_id bigint, x array<bigint>, block string, n int").repartition(parts)


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_whole_result_is_that_of_numpy(spark, parts):
    points = random_points(300, 12)
    check(whitening.whiten(frame(spark, points, parts), 8).collect(), points, 8)


def test_many_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ENTRIES", 60)  # ten rows to a block
    points = random_points(205, 6, seed=3)
    check(whitening.whiten(frame(spark, points, 4)).collect(), points)


def test_entries_beyond_64_bits_of_products(spark):
    points = random_points(40, 3, seed=5, shift=2**52)
    points[0] = [2**53 + 5, -(2**53), 7]
    rows = whitening.whiten(frame(spark, points, 2)).collect()
    want = plain(points)["deviation"]
    assert all((r.deviation is None and want[r.vec_id] >= 10**38) or r.deviation == want[r.vec_id] for r in rows)
    assert rows[0].identity_error < 1e-6


def test_directions_without_variance_are_left_out(spark):
    points = {i: [i, 2 * i, 5, -i] for i in range(20)}
    rows = whitening.whiten(frame(spark, points, 2)).collect()
    assert {r.component for r in rows} == {1} and len(rows) == 20
    assert rows[0].explained == pytest.approx(1) and rows[0].identity_error < 1e-9


def test_equal_points_single_points_and_no_points(spark):
    same = frame(spark, {i: [4, 4] for i in range(5)}, 2)
    assert whitening.whiten(same).collect() == []
    assert whitening.whiten(same.limit(1)).collect() == []
    assert whitening.whiten(same.limit(0)).collect() == []


def test_other_lengths_null_and_repeated_ids(spark):
    rows = [(1, [1, 2]), (1, [1, 2]), (None, [5, 0]), (2, [7, 7]), (3, [1]), (4, [1, 2, 3])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, x array<bigint>")).collect()
    assert len(got) == 4 * 2 and {r.n for r in got} == {4}
    assert sum(r.vec_id is None for r in got) == 2 and sum(r.vec_id == 1 for r in got) == 4


def test_quantise_drops_rows_without_finite_entries(spark):
    rows = [
        (1, [0.5, -0.01]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 0.0]),
        (5, [float("inf"), 0.0]), (6, []), (None, [1.0, 2.0]), (7, [3e38, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, e array<float>").selectExpr("*", "1 AS x", "'a' AS v")
    got = {r.vec_id: r.x for r in whitening.quantise(df, "e", 64, 1_000_000).collect()}
    assert got == {1: [1_000_032, 999_999], None: [1_000_064, 1_000_128]}


def test_query_is_that_of_numpy(spark):
    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("driver tables not here")
    table = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    points = {
        r.vec_id: [int(np.floor(64 * float(c))) + 1_000_000 for c in r.embedding]
        for r in table
        if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding)
    }
    df = QUERIES["op11_block_whitening"](spark, folder)
    assert dict(df.dtypes)["deviation"] == "bigint"
    check(df.collect(), points)
