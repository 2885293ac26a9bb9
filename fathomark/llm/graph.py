"""Connected components by alternating large-star and small-star passes.

Each pass is a grouped minimum (combined map side) and one join; the edge set of a pass is written to the
shared folder, so a lost executor costs one pass. The edges end as stars around the smallest node; edges that are
stars need no pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomark.sources.scratch import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("low"))
    moved = down.join(low, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.union(low.select("u", F.col("low").alias("v"))).distinct()


def components(edges: DataFrame, passes: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge. Columns u, v of type long.

    Self loops and repeated or reversed edges are harmless; an empty frame gives an empty frame.
    """
    edges = materialise(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(passes):
        if _stars(edges):
            break
        edges = materialise(_small_star(_large_star(edges)), "edges")
    else:
        raise RuntimeError(f"components did not settle in {passes} passes")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def stars_of(group: DataFrame) -> DataFrame:
    """(u, v): the edges of :func:`components`' result, each node with the smallest of its component."""
    return group.select(F.col("node").alias("u"), F.col("component").alias("v"))


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one smaller neighbour, which has none itself. Edges are distinct and have u > v."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.sum("up").alias("up")).filter("down > 1 or (down > 0 and up > 0)").isEmpty()
