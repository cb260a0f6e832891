"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Rounds


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), u > v. Each round is an aggregate with partial sums and an equi-join, which AQE can split for hubs."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    near = both.join(least, "u")
    if large:
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) in any order -> (node, component), component being the smallest node reachable. Nodes are of any type that Spark orders and hashes.

    Nodes that are on no edge aren't returned; loops, nulls and repeated edges are harmless; no edges give an empty frame.
    Every round is written in the shared folder, in place of the one before; two numbers a round reach the driver.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    cut = Rounds(edges.sparkSession, "edges")
    e, before = cut(e), None
    while True:
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
        e = cut(_star(_star(e, True), False))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
