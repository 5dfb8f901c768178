"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (itself counts)."""
    both = _both(edges)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of these. Edges run from larger u to smaller v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _is_forest(edges: DataFrame) -> bool:
    """Whether every node hangs on one node that hangs on none: then the links are the components."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select(F.col("v"), F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node that has a link; component is the smallest node reachable.

    Each step is a table in the shared folder; the driver only learns whether one is left to do.
    Minima are taken before the shuffle, so a node with many links costs a row per task.
    """
    edges = written(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    while not _is_forest(edges):
        edges, old = written(_small_star(_large_star(edges)), "edges"), edges
        release(old)
    pairs = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
