"""Connected components of an edge table by alternating large and small stars, all in joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(edges: DataFrame) -> DataFrame:
    """node, root for each node of edges(a, b) that isn't its component's smallest node; root is that smallest node.

    Each half round writes its edges to the shared folder; only a count and a checksum reach the driver. Nodes with many
    edges are met by grouped minima with partial aggregation and by joins that adaptive execution can split.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    pairs = staged(pairs, "edges")
    state = _state(pairs)
    while state[0]:
        both = pairs.union(pairs.select("lo", "hi")).toDF("u", "v")
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")), "least").select("u", F.least("u", "m").alias("m"))
        large = staged(both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), "edges")
        least = staged(large.groupBy("hi").agg(F.min("lo").alias("m")), "least")
        near = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        pairs = staged(near.union(least).distinct(), "edges")
        state, before = _state(pairs), state
        if state == before:
            break
    return pairs.toDF("node", "root")


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())
