"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import cut_lineage


def _pointed(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """Every node's neighbours are linked to the smallest of them (and itself)."""
    both = pairs if larger_only else pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_m"))
    least = least.select("a", F.least("a", "_m").alias("_m"))
    moved = both.join(least, "a")
    if larger_only:  # small star: a > b; neighbours and the node itself go to the smallest
        out = moved.select(F.col("b").alias("a"), F.col("_m").alias("b")).unionByName(
            least.select("a", F.col("_m").alias("b")))
    else:  # large star: only larger neighbours move
        out = moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
    return out.where(F.col("a") != F.col("b")).distinct()


def _state(links: DataFrame) -> tuple:
    mark: Column = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return tuple(links.agg(F.count(F.lit(1)), mark).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of a link (a, b); the component is its smallest node.

    The number of rounds grows with the logarithm of the nodes; each is written to the checkpoint folder, so lost
    executors cost one round at most. A hot centre is pre-aggregated and its join is split by adaptive execution.
    """
    links = cut_lineage(links.where(F.col("a") != F.col("b"))
                        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(links)
    while before[0]:
        links = cut_lineage(_pointed(_pointed(links, False), True))
        after = _state(links)
        if after == before:
            break
        before = after
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component")).distinct()
