"""Connected components of an edge table, by alternating large and small stars.

Edges are pairs of longs.  Each round joins every edge with the least neighbour
of one end; rounds are written to the shared folder, so a lost executor costs
one round at most.  Tables are joined as plain exchanges of written tables, so
that adaptive execution can split a hub's edges over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle


def _mark(edges: DataFrame) -> tuple[int, int]:
    found = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return found[0], int(found[1] or 0)


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a, b); the root is the least node of its component."""
    state = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(state)
    while mark[0]:
        # Large star: greater neighbours of a node move to its least neighbour.
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settle(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = settle(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        discard(least)
        # Small star: a node and its lesser neighbours move to the least of them.
        least = settle(large.groupBy("a").agg(F.min("b").alias("m")))
        down = large.join(least, "a")
        nearer = down.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        following = settle(nearer.distinct())
        for old in (least, large, state):
            discard(old)
        state, before = following, mark
        mark = _mark(state)
        if mark == before:
            break
    roots = state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
