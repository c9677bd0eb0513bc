"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, materialize


def connected(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of links (a, b).

    A large star ties a node's larger neighbours to its smallest one, a small star its smaller neighbours; after a
    number of rounds logarithmic in the longest path every component is one star. Hubs cost no more than their links:
    minima are pre-aggregated, and the joins are split where a key is skewed.
    """

    def large(edges: DataFrame) -> DataFrame:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()

    def small(edges: DataFrame) -> DataFrame:
        down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        tied = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
        return tied.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()

    def mark(edges: DataFrame):
        return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    with Scratch(links.sparkSession) as scratch:
        edges = scratch.keep(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
        before, now = None, mark(edges)
        while now != before and now[0]:
            rounds = scratch.keep(small(large(edges)), "stars")
            scratch.drop(edges)
            edges, before, now = rounds, now, mark(rounds)
        stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        return materialize(stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct()), "components")
