"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


#: Links that a file of a round holds, about.
LINKS_A_FILE = 100_000


def _large_star(links: DataFrame, total: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour instead."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return common.join_hot(both.where("b > a"), least, "a", "n", 2 * total).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame, total: int) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them. Links go from the larger to the smaller node."""
    least = links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = common.join_hot(links, least, "a", "n", total).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b): each node that has a link, other than the least of its component, with that least one.

    links (a, b) of any orderable type; direction, repeats and self-links don't matter, null nodes are dropped. Each
    round is written to the shared folder; the rounds grow with the logarithm of the longest path. Only two numbers a round go to the driver. The middles of
    large stars are hot keys, whose rows aren't shuffled by them.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = common.cut(links)
    seen = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return links
        seen = state
        links = common.cut(_small_star(_large_star(links, state[0]), state[0]), max(8, state[0] // LINKS_A_FILE))
