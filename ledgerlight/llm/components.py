"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import settle


def _is_settled(links: DataFrame) -> bool:
    """True if each node hangs under one node that hangs under none."""
    ends = links.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        links.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.filter("up + down > 1").isEmpty()


def connected(links: DataFrame) -> DataFrame:
    """node and root, the smallest node it is linked with over any number of links, for
    all nodes of `links` (u, v: long) but the roots themselves.

    Each round hangs a node's larger neighbours, then its smaller ones, under its
    smallest neighbour. Rounds grow with the logarithm of the longest chain. Every
    round is written to shared storage; they end when all links are stars. Nulls and
    links of a node with itself are left out.
    """
    ordered = links.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = settle(ordered.distinct())
    while not _is_settled(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        # large star: v > u hangs under u's smallest neighbour
        large = now.join(least, F.col("v") == F.col("w")).select("u", F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: all smaller neighbours of u, and u itself, hang under the smallest
        small = large.join(low.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = settle(small.filter(F.col("u") != F.col("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
