"""Connected components by alternating large and small stars, each round a few joins and aggregations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.staging import stage, unstage


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what the edges (a, b) join: each node with the least of its component."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        root = root[root]
        if (root == before).all():
            break
    tied = root != np.arange(len(nodes))
    return nodes[tied], nodes[root[tied]]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: every neighbour above u is tied to the least of u and its neighbours. Small: u and its neighbours below it are tied to the least of them.

    The least ones are staged, so that the join's both sides are plain exchanges and Spark's skew join can split a node with many edges.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = stage(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
    tied = both.join(least, "u")
    if large:
        made = tied.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
    else:
        made = tied.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
    made = stage(made, "stars")
    unstage(least)
    return made


def _settled(edges: DataFrame) -> bool:
    """Whether every component is a star round its least node: no node above another has two below it or is below one itself."""
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("below")).unionByName(edges.select(F.col("b").alias("node"), F.lit(None).cast("long").alias("below")))
    seen = ends.groupBy("node").agg(F.min("below").alias("lo"), F.max("below").alias("hi"), F.max(F.col("below").isNull()).alias("centre"))
    return seen.where("lo is not null and (centre or lo < hi)").isEmpty()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame | None:
    """edges: a, b (long), in a table that is cheap to read again. Returns node and root, the least node reachable, for every node with an edge, staged; None if there are none."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    if edges.isEmpty():
        return None
    given = True
    for _ in range(rounds):
        if _settled(edges):
            found = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")))
            found = stage(found.distinct(), "roots")
            if not given:
                unstage(edges)
            return found
        larger = _star(edges, True)
        smaller = _star(larger, False)
        unstage(larger)
        if not given:
            unstage(edges)
        edges, given = smaller, False
    raise RuntimeError(f"components did not settle in {rounds} rounds")
