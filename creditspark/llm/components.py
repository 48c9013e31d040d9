"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditspark.session import materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Point the neighbours of each node at the smallest node around it: the larger ones, or the smaller ones."""
    if large:
        ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        ways = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    lowest = ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    # a hub's rows are split by adaptive execution: nothing above this join needs them together
    pointed = ways.join(lowest, "a")
    if large:
        moved = pointed.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        moved = pointed.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            lowest.select("a", F.col("low").alias("b")))
    return moved.filter("a <> b").distinct()


def components(links: DataFrame, limit: int = 100) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) of every node with a link in ``a``, ``b``.

    Rounds grow with the logarithm of the longest chain; each is written to the shared folder. An empty table, or
    links from a node to itself, give no rows.
    """
    now = materialize(links.filter("a <> b").select("a", "b").distinct())
    before = None
    for _ in range(limit):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        now = materialize(_star(materialize(_star(now, True)), False))
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    linked = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return linked.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
