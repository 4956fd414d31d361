"""Connected components by alternating star contraction, one stored edge table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearwell.llm.blocks import stored


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    least = _both_ways(edges).groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
    return edges.join(least.hint("merge"), "v").select("u", F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.repartition("u")  # one shuffle for the smallest neighbours and for the join with them
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    # the row of the smallest neighbour itself links the node
    return down.join(least.hint("merge"), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, and none if it has larger ones."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").count()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v: long) to (node, component), the smallest node of each; nodes without an edge are not listed.

    A node's neighbours are only reduced by ``min`` and joined with that one row, by sort-merge joins at every size. Rounds
    grow with the logarithm of the longest path and end when all edges lead to a smallest node; edges that do from the start
    need no round. Empty edges give an empty table; loops are ignored.
    """
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _are_stars(edges):
        edges = stored(_small_star(_large_star(edges)), "edges")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
