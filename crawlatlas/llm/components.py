"""Connected components of links, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlatlas.llm.common import materialize


def _state(edges: DataFrame):
    """A number of rows and a sum of hashes, which change with the edges."""
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (the smallest node reachable) for every node that has a link.

    Large-star and small-star steps take turns until nothing changes: each node's larger neighbours,
    then its smaller ones, are linked to the smallest of them. A step is one map-side combined minimum
    and one join, so a node with very many links is never gathered in one place. Rounds grow with the
    logarithm of the longest path.
    """
    edges = (links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct())
    edges = materialize(edges, "links")
    before = _state(edges)
    while True:
        # Large star: the larger neighbours of each node go to its smallest neighbour or itself.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u != v").distinct())
        # Small star: each node's smaller neighbours, and the node, go to the smallest of them.
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_least, "u")
        small = (joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(small_least.select("u", F.col("m").alias("v"))).distinct())
        edges = materialize(small, "links")
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
