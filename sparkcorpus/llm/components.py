"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcorpus.llm.scratch import Scratch


def stars(links: DataFrame) -> bool:
    """Whether every node has one link down, to a node that has none."""
    ups = links.groupBy("u").agg(F.count("*").alias("c"))
    roots = links.select(F.col("v").alias("u")).distinct().withColumn("root", F.lit(1))
    return ups.join(roots, "u", "left").filter("c > 1 or root = 1").isEmpty()


def connected_components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """`links` has columns a and b (long).  Returns (node, component): the smallest node that
    links lead to, for every node with a link to another; nodes without links have no row.

    Each step rewrites links as (larger, smaller) towards the smallest neighbour, until nothing
    changes; that takes about the logarithm of the number of nodes.  A node with very many links is
    summed up in each task first and its links are split by the adaptive join.
    """
    now = scratch.keep(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    step = 0
    while not stars(now):
        step += 1
        # large star: neighbours above a node move to the smallest of its neighbourhood
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.keep(large, f"{name}-{step}-half")
        # small star: neighbours below a node, and the node, move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        small = large.join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        nxt = small.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()
        before, now = f"{name}-{step - 1}", scratch.keep(nxt, f"{name}-{step}")
        scratch.drop(before, f"{name}-{step}-half")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
