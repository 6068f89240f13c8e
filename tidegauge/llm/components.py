"""Connected components of a graph as DataFrame joins, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import saved


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.select(F.count(F.lit(1)), F.bit_xor(F.xxhash64("high", "low"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (the smallest node reachable) for every node that has an edge; loops and nulls are ignored.

    Each round links the larger neighbours of a node to its smallest neighbour, then the smaller ones; the rounds needed
    grow with the logarithm of the longest path. A node with very many neighbours is only ever pre-aggregated, or one
    side of a join that can be split.
    """
    now = saved(edges.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).where("high > low").distinct(), "edges")
    before = _print(now)
    while before[0]:
        ends = now.select(F.col("high").alias("u"), F.col("low").alias("v")).unionByName(now.select(F.col("low").alias("u"), F.col("high").alias("v")))
        least = ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = now.join(least, F.col("low") == F.col("u")).select("high", F.col("m").alias("low")).distinct()
        root = large.groupBy(F.col("high").alias("u")).agg(F.min("low").alias("m"))
        small = large.join(root, F.col("high") == F.col("u")).where("low > m").select(F.col("low").alias("high"), F.col("m").alias("low"))
        now = saved(small.unionByName(root.select(F.col("u").alias("high"), F.col("m").alias("low"))).distinct(), "edges")
        after = _print(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("low").alias("node")).distinct()
    return now.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
