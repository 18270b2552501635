"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a partial-aggregated minimum per node and an equi-join, so a node with very many neighbours is one
pre-aggregated row and a join side that AQE can split. The number of rounds grows with the logarithm of the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdown.llm.common import written


def _star(e: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v). large: each node's larger neighbours go to the smallest of its neighbourhood; small: its smaller ones."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else \
        e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    j = both.join(low, "u")
    if large:
        out = j.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the smallest node reachable."""
    e = written(edges.select("u", "v").where(F.col("u") != F.col("v")).distinct())
    before = None
    while True:
        e = written(_star(_star(e, True), False))
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
