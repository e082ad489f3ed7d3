"""Connected components of a table of links, without holding links on the driver.

Alternates the large-star and small-star steps: every node hands its larger
neighbours to its smallest one, then its smaller ones, until each component is
one star around its smallest node.  A round is aggregates and joins on the node,
written to the shared folder.  The links of one node meet in one task, as rows
of two numbers; equal sets are one node before this.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pin


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b")


def _small_star(links: DataFrame) -> DataFrame:
    """Links come as a < b; each b joins its smallest a, and so do its other ones."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    others = links.join(least, "b").filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return least.select(F.col("m").alias("a"), "b").union(others)


def _settled(links: DataFrame) -> bool:
    """Whether every node is a root or has one link, to a root."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        links.select("b", F.lit(0), F.lit(1)))
    roles = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return not roles.filter("down > 1 or (up > 0 and down > 0)").limit(1).collect()


def components(links: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``links``: a and b, longs that differ.  Returns node and root (the
    smallest node of its component) of every node that isn't its own root."""
    now = pin(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "links")
    rounds = 0
    while not _settled(now):
        if rounds == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        now = pin(_small_star(_large_star(now).distinct()).distinct(), "links")
        rounds += 1
    return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
