"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.session import stage


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0])


def _least(edges: DataFrame) -> DataFrame:
    """Smallest of each node and its neighbours; staged, so that the join with it can split a hub."""
    return stage(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every node of ``links`` (columns a, b): the smallest id reachable.

    Each round points the larger neighbours of a node at its smallest one, then the
    smaller neighbours; the number of rounds grows with the logarithm of the longest
    path. Every round is written to the shared folder.
    """
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _mark(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stage(both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = large.join(_least(large), "u")
        edges = stage(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        after = _mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots.select("v", "v"))
