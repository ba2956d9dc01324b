"""Connected components of a link table by alternating star contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cpgloom.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the undirected links (a, b), component being the smallest node reachable.

    Each round sends every node's neighbours, and the node, to the smallest
    among them (published large-star and small-star steps); only counts come to
    the driver. Rounds grow with the logarithm of the number of nodes.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct()
    edges = materialize(edges, "links")
    while True:
        # large star: each larger neighbour of a node goes to the smallest of node and neighbours
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        # small star: each node and its smaller neighbours go to the smallest
        large = large.where(F.col("a") != F.col("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
        small = materialize(small.where(F.col("a") != F.col("b")).distinct(), "links")
        # done when every node has one smaller neighbour that has none itself
        one = small.groupBy("a").agg(F.count("*").alias("n"))
        many = one.where(F.col("n") > 1).limit(1).count()
        if not many and not small.join(small.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count():
            return small.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(small.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        edges = small
