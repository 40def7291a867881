"""Connected components of links between ids, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id in a link: the smallest id it reaches.

    Alternates two steps until nothing changes: every neighbour is linked to the smallest
    neighbour of its node (larger neighbours first, then smaller ones), which ends in one
    star per component after a number of rounds that grows with the logarithm of the
    longest path. Only sums per node are gathered, so a hub with millions of links is
    combined before the shuffle, and each round is cut with a checkpoint.
    """
    edges = materialize(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct())
    while True:
        large = _to_smallest(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "v > u")
        small = materialize(_to_smallest(large, "v < u"))
        if small.exceptAll(edges).isEmpty() and edges.exceptAll(small).isEmpty():
            break
        edges = small
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("id"), "component").distinct())


def _to_smallest(edges: DataFrame, moved: str) -> DataFrame:
    """Links the ``moved`` neighbours of each node, and the node itself, to the smallest of them all."""
    best = materialize(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    joined = edges.join(best, "u")  # AQE splits the links of a hub
    links = joined.where(moved).select(F.col("v").alias("u"), F.col("m").alias("v")).union(best.select("u", F.col("m").alias("v")))
    return links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
