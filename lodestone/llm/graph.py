"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import written


def _least(pairs: DataFrame) -> DataFrame:
    """(u, m): the least of each u and its neighbours. Written, so that the join after it sees plain tables and can split a hub."""
    return written(pairs.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")), "least_neighbours")


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u, v), u < v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = both.where("v > u").join(_least(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    large = written(large, "large_star")  # (larger, smaller)
    starred = large.join(_least(large), "u")
    small = starred.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(starred.select("u", F.col("m").alias("v")))
    return small.select(F.col("v").alias("u"), F.col("u").alias("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, root): the smallest node of its component for every node with a link.

    Each round keeps the components and takes every node nearer to its least
    one; rounds grow with the logarithm of the longest chain. Nothing but two
    numbers a round reaches the driver.
    """
    edges = written(links.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
    before = _state(edges)
    while before[0]:
        edges = written(_round(edges), "edges")
        if (now := _state(edges)) == before:
            break
        before = now
    roots = edges.groupBy("u").agg(F.lit(None)).select(F.col("u").alias("node"), F.col("u").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("u").alias("root")))
