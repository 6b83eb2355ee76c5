import random

import pytest

from tallyframe.llm import multi_index

NAN = float("nan")


def plain(rows, wanted, k, dimensions):
    code = {}
    for i, v in rows:
        if i is not None:
            bits = [(v or [])[d : d + 1] for d in range(dimensions)]
            value = sum(1 << d for d, b in enumerate(bits) if b and b[0] is not None and b[0] > 0)
            signed = value - (1 << 64) if value >> 63 else value
            code[i] = min(code.get(i, signed), signed)
    out = []
    for q in sorted(wanted & set(code)):
        near = sorted((((code[q] ^ c) & (2**64 - 1)).bit_count(), i) for i, c in code.items() if i != q)
        out += [(q, i, d, n) for n, (d, i) in enumerate(near[:k], 1)]
    return out


def run(spark, rows, wanted, k, dimensions):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS code", "2 AS value", "3 AS segment")
    out = multi_index.top_k(df, df.where(df.vec_id.isin(list(wanted))), k, dimensions)
    assert out.columns == ["query_id", "vec_id", "distance", "rank"]
    return sorted((r.query_id, r.vec_id, r.distance, r["rank"]) for r in out.collect())


@pytest.mark.parametrize(("n", "k", "dimensions"), [(300, 5, 64), (40, 3, 16)])
def test_against_all_rows(spark, n, k, dimensions):
    rng = random.Random(n)
    rows = [(i, [rng.gauss(0, 1) for _ in range(dimensions)]) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(25)]  # one code many times
    rows += [(2000, None), (2001, []), (2002, [NAN, 1.0, None]), (None, [1.0]), (3, rows[4][1])]
    wanted = {0, 3, 10, 20, 1005, 1006, 2000, 2002}
    assert run(spark, rows, wanted, k, dimensions) == sorted(plain(rows, wanted, k, dimensions))


def test_few_rows(spark):
    rows = [(1, [1.0, -1.0]), (2, [-1.0, 1.0]), (3, [1.0, 1.0])]
    assert run(spark, rows, {1, 2}, 10, 2) == sorted(plain(rows, {1, 2}, 10, 2))
    assert run(spark, rows[:1], {1}, 10, 2) == []
    assert run(spark, rows, {9}, 10, 2) == []
    assert run(spark, [(None, [1.0])], {1}, 10, 2) == []
