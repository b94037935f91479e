"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from foliant.operators.skew import join_unique
from foliant.session import cut_lineage, forget

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the lowest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"), F.max("v").alias("top"), F.count("*").alias("n")).where("top > u").drop("top")
    total = edges.agg(2 * F.count("*")).scalar()
    up = join_unique(both.where("v > u"), low, ["u"], "n", total, F.xxhash64("v"))
    return up.select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it are linked to the lowest of them; in every edge u > v."""
    low = edges.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("top"), F.count("*").alias("n"))
    total = edges.agg(F.count("*")).scalar()
    # where one neighbour is all, nothing is left to link
    several = low.where("top > low").drop("top")
    down = join_unique(edges, several, ["u"], "n", total, F.xxhash64("v")).where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return down.unionByName(low.select("u", F.col("low").alias("v"))).distinct()


def _state(edges: DataFrame) -> Row:
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each node of an edge with the lowest node of its component.

    Nodes are of any type that has an order. Edges may repeat, run either way, loop or be null at an end (then they are no edge); no edges give no rows.
    Each half of a round is written to the shared folder, and each round compared with the one before by count and sum of hashes on the
    executors; only those two numbers reach the driver. The number of rounds grows with the logarithm of the longest path; stars take one.
    """
    start = cut_lineage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null").distinct())
    e, loops = start.where("u <> v"), start.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("component"))
    state = _state(e)
    for done in range(MAX_ROUNDS):
        linked = cut_lineage(_large_star(e))
        last, e = e, cut_lineage(_small_star(linked))
        forget(linked)
        if done:
            forget(last)
        before, state = state, _state(e)
        if state == before:
            break
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))
