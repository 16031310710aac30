"""Connected components by alternating star contractions.

Each step points the neighbours of a node to the smallest node known nearby, with one grouping
and one join; the edges turn into stars around the smallest node of each component in a number of steps
that grows with the logarithm of the longest path. Every step is a written table, so a lost executor
costs one step, and no node's neighbours ever meet in one list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.session import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node point to the smallest of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and itself, point to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``(cls, root)`` for every node of the ``(a, b)`` links; the root is the smallest node of the component."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stage(edges, "edges")
    before = _state(edges)
    while True:
        edges = stage(_small_star(_large_star(edges)), "edges")
        after = _state(edges)
        if after == before:
            roots = edges.select(F.col("u").alias("cls"), F.col("v").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("cls"), "root").distinct())
        before = after
