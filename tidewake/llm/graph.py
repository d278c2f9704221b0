"""Connected components of an edge table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(node, label): label is the smallest node reachable. links has a and b, any order, repeats allowed.

    Alternating large-star and small-star rounds; every round ends in a written table, so lineage stays short. Stars shrink to depth one
    in a number of rounds that grows with the logarithm of the largest component.
    """
    edges = scratch.table(f"{tag}-0", _oriented(links))
    last, n = f"{tag}-0", 0
    state = _state(edges)
    while True:
        n += 1
        now = f"{tag}-{n}"
        edges = scratch.table(now, _small_star(_large_star(edges)))
        scratch.drop(last)
        last, before = now, state
        state = _state(edges)
        if state == before:
            break
    labels = edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("label"))
    return labels.unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct().join(labels.select("node"), "node", "left_anti"))


def _oriented(links: DataFrame) -> DataFrame:
    return links.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the smallest of the node and its neighbours."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("v0")).select("u", F.least("u", "v0").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to its smallest neighbour."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    tied = edges.join(least, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return tied.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()
