"""Exact nearest binary codes by incremental multi-index hashing. DataFrame functions throughout.

A vector's code has one bit per dimension, its sign. Codes are cut into segments, and a query is
looked up in an index of (segment, value) at all values within a radius of its own, a radius for
each segment. By the pigeonhole principle a code that no lookup meets differs from the query by more
than the segment's radius in every segment, so its distance is at least the sum of (radius + 1)
over the segments. Every code met is verified by its full distance, radii grow until the kth
verified distance lies below that sum, and only queries still open go on. Cheap radii grow in all
segments at once, dear ones in one segment after the other. The best distances met so far are part
of the lookup join, so codes that cannot enter a result never leave it.

Rows of equal codes share one entry of the index, with the first ``k + 1`` of their ids: a query
needs no more of them. Queries of equal codes are looked up once.
"""

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.session import materialise

# Radii with up to this many values grow in all segments at once.
CHEAP = 600


def sign_codes(vectors: DataFrame, dimensions: int = 64) -> DataFrame:
    """(vec_id, code) with bit i set if dimension i is above zero.

    Missing dimensions, nulls and NaN count as zero, so a null vector has code 0. Rows without an id
    have no place in a result and are left out.
    """
    code = F.lit(0).cast("bigint")
    for i in range(dimensions):
        value = F.get("embedding", F.lit(i))
        bit = F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint")
        above = (value > 0) & ~F.isnan(value)
        code = code.bitwiseOR(F.when(above, bit).otherwise(F.lit(0).cast("bigint")))
    return vectors.where(F.col("vec_id").isNotNull()).select("vec_id", code.alias("code"))


def _cuts(dimensions: int, codes: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment; wider ones for more codes."""
    parts = round(dimensions / (math.log2(codes + 2) + 2))
    parts = min(max(parts, 2, math.ceil(dimensions / 32)), dimensions)
    edges = [dimensions * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _segment(code: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(code, low).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))


def _flips(width: int, radius: int) -> Column:
    """Array of all masks of so many bits."""
    masks = [sum(1 << i for i in places) for places in combinations(range(width), radius)]
    return F.from_json(F.lit(str(masks)), "array<bigint>")


def _steps(cuts: list[tuple[int, int]]):
    """Lists of (segment, radius) to look up together; radii 0 to 2 are the first."""
    widest = max(width for _, width in cuts)
    layers = [[(s, r) for s, (_, w) in enumerate(cuts) if r <= w] for r in range(widest + 1)]
    yield [x for layer in layers[:3] for x in layer]
    for radius, layer in enumerate(layers[3:], 3):
        if math.comb(widest, radius) <= CHEAP:
            yield layer
        else:
            yield from ([x] for x in layer)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, dimensions: int = 64) -> DataFrame:
    """The ``k`` nearest other rows of each query: (query_id, vec_id, distance, rank).

    ``queries`` names rows of ``vectors`` by vec_id. Order is by Hamming distance of the codes, then
    vec_id; a query never finds itself. Fewer than k other rows give fewer results. Rows that
    repeat a vec_id count once, with the smallest code.
    """
    rows = materialise(
        sign_codes(vectors, dimensions).groupBy("vec_id").agg(F.min("code").alias("code"))
    )
    # Spark limits ranks before it shuffles, so all rows of a code never meet in one task.
    of_code = Window.partitionBy("code").orderBy("vec_id")
    codes = materialise(
        rows.withColumn("place", F.row_number().over(of_code))
        .where(F.col("place") <= k + 1)
        .groupBy("code")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )
    total, distinct = rows.count(), codes.count()
    cuts = _cuts(dimensions, distinct)
    keys = F.array(
        *[
            F.struct(F.lit(s).alias("segment"), _segment(F.col("code"), low, w).alias("value"))
            for s, (low, w) in enumerate(cuts)
        ]
    )
    index = materialise(
        codes.select(F.explode(keys).alias("key"), "code", "ids").select(
            "key.segment", "key.value", "code", "ids"
        )
    )
    asked = rows.join(queries.select("vec_id").distinct(), "vec_id", "left_semi")
    asked = materialise(asked.select(F.col("vec_id").alias("query_id"), F.col("code").alias("query")))
    # worst: the distance of the (k + 1)th row met so far; the query's own row is one of them
    todo = materialise(asked.select("query", F.lit(dimensions).alias("worst")).distinct())
    needed = min(k + 1, total)
    done, best = [], None
    radii = [-1] * len(cuts)
    nearest = Window.partitionBy("query").orderBy("distance", "vec_id")
    for step in _steps(cuts):
        probes = None
        for segment, radius in step:
            low, width = cuts[segment]
            part = todo.select(
                "query", "worst", F.lit(segment).alias("segment"),
                F.explode(_flips(width, radius)).alias("flip"),
            ).withColumn("value", _segment(F.col("query"), low, width).bitwiseXOR(F.col("flip")))
            probes = part if probes is None else probes.unionByName(part)
            radii[segment] = radius
        distance = F.bit_count(F.col("query").bitwiseXOR(F.col("code")))
        met = (
            probes.join(
                index.withColumnsRenamed({"segment": "segment_", "value": "value_"}),
                (F.col("segment") == F.col("segment_"))
                & (F.col("value") == F.col("value_"))
                & (distance <= F.col("worst")),
            )
            .select("query", "code", "ids", distance.alias("distance"))
            .select("query", "distance", F.explode("ids").alias("vec_id"))
        )
        if best is not None:
            met = met.unionByName(best.join(todo.select("query"), "query", "left_semi"))
        best = materialise(
            met.distinct()
            .withColumn("rank", F.row_number().over(nearest))
            .where(F.col("rank") <= k + 1)
            .select("query", "distance", "vec_id")
        )
        covered = sum(radius + 1 for radius in radii)
        everything = all(radius == width for radius, (_, width) in zip(radii, cuts))
        state = best.groupBy("query").agg(
            F.count(F.lit(1)).alias("n"), F.max("distance").alias("last")
        )
        state = materialise(
            todo.join(state, "query", "left").select(
                "query",
                F.when(F.col("n") >= k + 1, F.col("last")).otherwise(dimensions).alias("worst"),
                # all rows are met, or the last needed one is nearer than any row not met
                (
                    F.lit(everything)
                    | ((F.col("n") >= needed) & ((F.lit(total) <= k + 1) | (F.col("last") < covered)))
                ).alias("closed"),
            )
        )
        done.append(best.join(state.where("closed").select("query"), "query", "left_semi"))
        todo = materialise(state.where(~F.coalesce("closed", F.lit(False))).select("query", "worst"))
        if todo.isEmpty():
            break
    results = done[0]
    for part in done[1:]:
        results = results.unionByName(part)
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return (
        asked.join(results, "query")
        .where(F.col("vec_id") != F.col("query_id"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "vec_id", "distance", "rank")
    )
