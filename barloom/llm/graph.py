"""Connected components of a link table by repeated stars; every step is an aggregation and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.session import settle


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): component is the smallest node reachable.

    Rounds of large stars (larger neighbours move to the smallest neighbour) and small stars (smaller ones and
    the node itself do) end in one star per component, in about log-squared many rounds; links that are stars
    already need none. Each round is written, so lost executors repeat one round at most. The driver sees one
    answer a round. Links are never expanded, and a node with very many links is split by adaptive execution,
    as only joins meet it.
    """
    at = settle(_ordered(links.select(F.col("a").cast("long"), F.col("b").cast("long"))))
    while not _all_stars(at):
        at = settle(_small_star(_large_star(at)))
    return (at.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(at.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct())


def _ordered(links: DataFrame) -> DataFrame:
    """Each link once, the larger node first."""
    return (links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def _all_stars(links: DataFrame) -> bool:
    """Whether every node is a centre or hangs on exactly one."""
    ends = links.select(F.inline(F.array(
        F.struct(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("centre")),
        F.struct(F.col("b").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("centre")))))
    per_node = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("centre").alias("centre"))
    return per_node.where("hangs + centre > 1").isEmpty()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return _ordered(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _ordered(moved.unionByName(least.select("a", F.col("m").alias("b"))))
