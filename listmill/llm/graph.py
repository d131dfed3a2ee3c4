"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listmill.llm.common import written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(neighbours: DataFrame, larger_only: bool) -> DataFrame:
    """Ties each node's neighbours to the smallest among them and the node itself.

    The smallest ones are written before the join, whose sides are then plain exchanges:
    adaptive execution can split the rows of a node with very many neighbours.
    """
    least = written(neighbours.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    joined = neighbours.join(least, "u")
    if larger_only:
        tied = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        tied = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return tied.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (smallest node reachable) for all nodes of edges ``u``, ``v``.

    A large-star step ties larger neighbours to the smallest, a small-star step ties smaller
    ones; at the end every node points to its component's smallest. No step makes more edges
    than it got, and a node with many neighbours is only ever the smaller end of rows that
    are keyed by the others. Every round is written to the shared folder. Loops and repeated
    edges do not matter; without edges the result is empty.
    """
    edges = written(edges.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        large = _star(_both_ways(edges), larger_only=True)
        small = written(_star(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), larger_only=False).select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        # Done when each node has one edge and no smaller end is itself a larger one.
        state = small.groupBy("u").agg(F.count("*").alias("n"))
        loose = state.where("n > 1").limit(1).count()
        if not loose and not small.join(small.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
            break
        edges = small
    return small.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        small.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
