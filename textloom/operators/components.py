"""Distributed union-find: connected components by large-star and small-star joins.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Each round is a pre-aggregated minimum over
neighbours and an equi-join, so a node with very many neighbours is dealt over tasks by Spark's skew handling, and each
round's links are saved as a table. A chain of n links settles in rounds that grow with log n.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.sources.storage import checkpointed


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(pairs: DataFrame, up: bool) -> DataFrame:
    """pairs(a, b): links of a to b. m is the least of a and its neighbours; neighbours over a (up) or all that pairs holds link to m."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    met = pairs.join(least, "a")
    if up:
        return met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    own = least.select("a", F.col("m").alias("b"))
    return met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own).where("a <> b").distinct()


def _ordered(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def connected(links: DataFrame, save: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """links(a, b) -> node, root: each linked node with the least node of its component. save: writes a round's links and reads them back."""
    now = save(_ordered(links).where("a <> b").distinct())
    while not _settled(now):
        now = save(_star(_ordered(_star(_both(now), up=True)), up=False))
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _settled(links: DataFrame) -> bool:
    """Whether the links are stars: no node links to two others, and none that is linked to links on."""
    if links.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        return False
    return not links.join(links.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
