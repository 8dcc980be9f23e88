"""Connected components as Spark joins: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinespark.session import stage


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Tie the neighbours of every node (large: the greater ones, else the smaller ones and itself) to the least."""
    seen = _both(edges) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = seen.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("low", "a"))
    tied = seen.join(least, "a")
    if large:
        tied = tied.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        tied = tied.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            least.select("a", F.col("low").alias("b"))
        )
    return tied.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b); a component is named by its least node.

    The number of rounds grows with the logarithm of the longest path. Each round is a stored table.
    """
    current = stage(edges.filter(F.col("a") != F.col("b")).select("a", "b").distinct(), "edges")
    mark = None
    while True:
        current = stage(_star(_star(current, True), False), "edges")
        found = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == mark:
            break
        mark = found
    roots = current.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
