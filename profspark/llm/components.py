"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profspark.llm.scratch import Scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) of every node in `edges` (u, v); label is the smallest node of its component.

    Alternating large-star and small-star steps: each node points its larger neighbours, then its smaller ones, at the
    smallest. Every step is one aggregation, which is written, and one join with it on the node, so that Spark can split
    the join's shuffles where a node is hot. The number of steps grows with the logarithm of the graph's diameter. No edges
    give no rows; loops are ignored.
    """
    edges = scratch.keep(edges.select("u", "v").where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.keep(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = scratch.keep(large)
        scratch.drop(least)
        least = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = scratch.keep(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        after = _state(small)
        scratch.drop(edges, large, least)
        edges = small
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
