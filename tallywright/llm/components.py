"""Connected components of a graph whose edges are a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm import tables


def _large_star(edges: DataFrame) -> DataFrame:
    """Each neighbour above a node moves to the least node around."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return (
        both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    ).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its neighbours below move to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return moved.unionByName(own).where("a > b").distinct()


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """node and component (the least node reachable), for every node with an edge.

    `edges` has two columns a and b of one number type, in any direction, repeated or
    not; loops and nulls count for nothing. Large-star and small-star steps take
    turns until every edge points at the least node of its component. Each turn is
    written to the shared folder in place of the one before, and only a count and a
    checksum come to the driver.
    """
    current = tables.settled(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        name,
    )
    before = None
    while True:
        state = current.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b"))).first()
        if state == before:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before, last = state, current
        current = tables.settled(_small_star(_large_star(last)), name)
        tables.dropped(last)
