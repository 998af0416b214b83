"""Connected components of an edge table, by alternating large-star and small-star steps.

Each round is two grouped minima and joins; nodes and edges never leave
the executors. A hub's minimum is pre-aggregated map-side, and its rows
meet it in a join that adaptive execution can split."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._common import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with u > v. Large: every larger neighbour of a node goes to the node's minimum; small: every smaller one, and the node."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, label) for every node of an edge; label is the smallest node of its component."""
    now = materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    sign = _sign(now)
    for _ in range(rounds):
        now = materialise(_star(_star(now, True), False), "stars")
        got = _sign(now)
        if got == sign:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        sign = got
    raise RuntimeError("components did not settle")


def _sign(edges: DataFrame) -> tuple:
    """Equal for equal edge tables; small."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
