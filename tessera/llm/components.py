"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs below one root, and no root below another."""
    if not edges.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return False
    return edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) of every id in edges (a, b). Each round hangs the neighbours of a node
    below its least neighbour, until all hang below roots; rounds grow with the logarithm of the longest path. Least neighbours are
    pre-aggregated before the shuffle, and a node with very many neighbours only meets them in joins, which Spark splits."""
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.where("a <> b").distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "node")
        small = large.join(least, F.col("a") == F.col("node"))
        hung = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("node").alias("a"), F.col("m").alias("b")))
        now = materialise(hung.where("a <> b").distinct(), "edges")
    rooted = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return rooted.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
