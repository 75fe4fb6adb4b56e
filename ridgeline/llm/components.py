"""Connected components of an edge table, as Spark joins: alternating large and small stars.

Every round sends each node's neighbours to the smallest node that it knows; after O(log n) rounds each node hangs
on the smallest node of its component. Rounds are written to the shared folder, so plans stay short and lost
executors cost a round at most. Hot nodes are joined, never gathered: Spark may split them.

Defined results: an edge with a null end joins nothing and gives no row; an edge from a node to itself gives no row;
repeated edges count once; without edges there are no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u > v, distinct)."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        moved = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u")
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) of every node that has an edge; edges: a, b (long)."""
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    now = common.written(now, "edges")
    before = state(now)
    for _ in range(rounds):
        if not before[0]:
            break
        now = common.written(star(star(now, True), False), "edges")
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
