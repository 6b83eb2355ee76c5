"""Connected components of a link table, by alternating stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.session import materialise


def _open_nodes(edges: DataFrame) -> int:
    """Nodes that hang under several others, or under one and have others under them."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    found = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return found.where(F.col("up") + F.col("down") > 1).count()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); component is its smallest node.

    Each round hangs the larger neighbours of a node, then its smaller ones, under the smallest
    neighbour. A node's minimum is combined map-side, and a hub's links are joined to one row, so
    AQE can split them. Rounds grow with the logarithm of the longest path; each is checkpointed,
    and only the number of nodes not yet in place comes to the driver. No links give no rows.
    """
    edges = materialise(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where(F.col("a") > F.col("b"))
        .distinct()
    )
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.join(least, "a")
            .where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        large = materialise(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = (
            joined.select("a", F.col("m").alias("b"))
            .unionByName(
                joined.where(F.col("b") > F.col("m")).select(
                    F.col("b").alias("a"), F.col("m").alias("b")
                )
            )
            .distinct()
        )
        edges = materialise(small)
        if not _open_nodes(edges):
            break
    roots = edges.groupBy("b").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("b").alias("node"), F.col("b").alias("component")
    )
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
