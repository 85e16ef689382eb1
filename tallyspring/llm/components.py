"""Connected components of a graph given by its edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspring.llm.storage import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Each round hangs every larger neighbour of a node, then every smaller one, on the least neighbour. Edges never
    grow in number; rounds grow with the logarithm of the longest path. Minima are pre-aggregated and written before
    they are joined, so that a node with very many edges can be split. Nothing but counts comes to the driver.
    """
    now = cut(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a != b").distinct())
    while not is_stars(now):
        both = now.union(now.select(F.col("b"), F.col("a")))
        least = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")).withColumnRenamed("a", "c"))
        large = cut(both.join(least, F.col("a") == F.col("c")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "c"))
        small = large.join(least, F.col("a") == F.col("c")).filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(small.union(least.select(F.col("c"), F.col("m"))).distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())


def is_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one node, and no node that others hang on hangs itself."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(edges.select("b", F.lit(0), F.lit(1)))
    by_node = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return by_node.filter("hangs + holds > 1").isEmpty()
