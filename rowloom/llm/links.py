"""Connected components of a table of links, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of `links` (a long, b long); the label is the smallest node of its component.

    Each round hangs nodes under smaller ones, first larger neighbours
    under the least neighbour, then all smaller neighbours under their
    least; it ends when every component is a star around its smallest node. A round shuffles the
    links by node twice and drops repeated ones once; the links of one node meet in one task,
    two numbers each, which spills. Each round reads a written table.
    """
    least = F.min("b").over(Window.partitionBy("a"))
    edges = written(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _is_settled(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.withColumn("m", F.least("a", least)).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = large.withColumn("m", least)
        edges = written(small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
                        .where("a != b").distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select("b", "b")).distinct()


def _is_settled(edges: DataFrame) -> bool:
    """Whether every node hangs under one node, and none hangs under a node that hangs itself."""
    roles = edges.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(
        edges.select("b", F.lit(0), F.lit(1)))
    return roles.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 or below = 1 and above = 1").isEmpty()
