"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.session import written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the least node reachable.

    Large-star and small-star steps in turn (Kiveris et al., 2014) until all
    edges are stars: each node has one edge, to a root that has none. Each step
    is an aggregation and a join; the least neighbour of a node comes from the
    aggregation, so that adaptive execution may split the join where one node
    has very many. Null ends and loops are ignored.
    """
    now = written(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name
    )
    while not _are_stars(now):
        # Large star: every larger neighbour of a node moves to the least of the node's neighbours.
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: the smaller neighbours of a node, and itself, move to the least of them.
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(small.union(smallest.select("a", F.col("m").alias("b"))).distinct(), name)
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select("b", "b").distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether no node has two edges down, nor one to a node that has one."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("b", F.lit(0), F.lit(1))
    ).groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.filter("up > 1 or (up = 1 and down = 1)").isEmpty()
