"""Connected components over an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citespark.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, tag: str = "cc", max_rounds: int = 60) -> DataFrame:
    """edges (a long, b long) -> (node, component) with component the smallest node reachable, for nodes that have an edge.

    Self-edges and repeated edges do no harm; no edges give no rows. Each step is an aggregation with partial
    sums and an equi-join that Spark may split where a node has very many neighbours. Every round is written to
    the shared folder. Raises RuntimeError when max_rounds do not suffice (the rounds needed grow with the
    logarithm of the number of nodes).
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = scratch.put(f"{tag}0", e)
    state = _state(e)
    for i in range(1, max_rounds + 1):
        e = scratch.put(f"{tag}{i}", _small_star(_large_star(e)))
        if i > 1:
            scratch.drop(f"{tag}{i - 1}")
        now = _state(e)
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first())


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (both.where("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
