"""Connected components of an edge list by alternating large and small stars.

The public map-reduce method of large-star and small-star steps: each step
only takes minima and joins on node, so no component is ever gathered in one
place, and the number of steps grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.shared import written


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours join the node's smallest neighbour (or itself)."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours and the node itself join its smallest neighbour."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return moved.union(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, label): the smallest node of each component of edges (a, b), nodes with an edge only.

    Null ends and loops are left out; repeated edges count once; no edges give no rows.
    """
    now = written(edges.select("a", "b").dropna().filter("a <> b").distinct(), "edges")
    before = None
    while True:
        after = written(_small(_large(now)), "edges")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, now = state, after
    stars = after.select(F.col("b").alias("node"), F.col("a").alias("label"))
    return stars.union(after.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
