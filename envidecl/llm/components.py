"""Connected components of a graph too large for one machine, by alternating stars.

Each round hangs every node's larger neighbours on its smallest neighbour (large star), then
its smaller ones (small star); edges stay as many as nodes at most, and a path of any length
shrinks to a star in a number of rounds about logarithmic in it. A node with very many
neighbours is an ordinary skewed join; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for all nodes of edges (a, b) of long; the component is its smallest node."""
    stars = scratch.keep(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = _state(stars)
    while before[0]:
        both = stars.union(stars.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.keep(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = scratch.keep(small.union(least.select("a", "m")).distinct())
        scratch.drop(stars, large)
        stars, after = new, _state(new)
        if after == before:
            break
        before = after
    pairs = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return pairs.union(stars.select(F.col("b").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(
        F.min("component").alias("component")
    )


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(
        F.count("*"), F.sum(F.xxhash64("a", "b") % 1000003), F.sum(F.xxhash64("b", "a", F.lit(1)) % 998244353)
    ).first()
    return tuple(r)
