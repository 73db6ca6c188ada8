"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round: link the neighbours of each node to the smallest of them."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    near = both if large else both.filter("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    moved = near.filter("v > u") if large else near
    links = moved.join(least, "u").select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b"))
    if not large:
        links = links.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return links.filter("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Of edges (a, b) of longs: a row (node, root) for each node that any edge has; root is the smallest node that it reaches.

    Each round aggregates before it joins, so a node of many links is one row on the small side of the join and Spark
    splits the other side. The table of links shrinks towards one link for each node; an empty table gives no rows.
    Raises RuntimeError if `rounds` do not suffice (they grow with the logarithm of the number of nodes).
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    seen = None
    for _ in range(rounds):
        now = written(_stars(_stars(now, True), False), "links")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = mark
    raise RuntimeError("the links did not settle")
