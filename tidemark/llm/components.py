"""Connected components of an undirected graph held as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import materialise


def _toward_smallest(edges: DataFrame, both_ways: bool) -> DataFrame:
    """One star step on (a, b): link each node's neighbours to the smallest of
    them and itself. ``both_ways``: larger neighbours only (the large star),
    else smaller ones only (the small star). A node's smallest neighbour is an
    aggregate that is combined before the shuffle; neighbours are never
    gathered in a list."""
    swapped = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    near = edges.unionByName(swapped) if both_ways else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    if both_ways:
        moved = near.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = near.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of ``edges`` (columns a, b: long), where
    label is the smallest node that links reach; nodes without links and
    loops give no row. Alternates large and small stars until the edge table
    no longer changes; each round is materialised.

    Raises RuntimeError if ``max_rounds`` do not suffice (rounds grow with the
    logarithm of the longest chain).
    """
    now = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
        mark = state
        if state[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
        now = materialise(_toward_smallest(_toward_smallest(now, True), False))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
