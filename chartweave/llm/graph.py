"""Connected components of an edge table, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartweave.session import cut_lineage


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges (a, b)``: the smallest node reachable.

    Alternates large-star and small-star steps: a node's neighbours are hung on its
    smallest neighbour until each component is one star.  No step gathers a node's
    neighbours, so a hub may have any number; rounds grow with the logarithm of the
    longest path.  Null ends and loops are left out.
    """
    e = cut_lineage(
        edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .filter("hi > lo")
        .distinct()
    )
    seen = _digest(e)
    for _ in range(rounds):
        both = e.select(F.col("hi").alias("v"), F.col("lo").alias("u")).union(e.select("lo", "hi"))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = (
            both.filter("u > v").join(least, "v").select(F.col("u").alias("hi"), F.col("m").alias("lo")).distinct()
        )
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(low, "hi").filter("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(low)
        )
        e = cut_lineage(small.distinct())
        now = _digest(e)
        if now == seen:
            stars = e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
            return stars.union(e.select("lo", "lo").distinct())
        seen = now
    raise RuntimeError("components did not settle")


def _digest(e: DataFrame):
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())
