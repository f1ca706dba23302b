"""Connected components of a link table by alternating large and small stars; joins and minima only, no group is gathered.

A node's minimum is one row, written before it meets the node's links: both sides then come through plain exchanges, and
adaptive execution splits a node that very many links have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pavewise.llm.common import discard, stored


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    out = stored(both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct(), "links")
    discard(links, least)
    return out


def _small_star(links: DataFrame) -> DataFrame:
    least = stored(links.groupBy("b").agg(F.min("a").alias("m")), "least")
    moved = links.join(least, "b").filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    out = stored(moved.union(least.select(F.col("m").alias("a"), "b")).distinct(), "links")
    discard(links, least)
    return out


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) of every node that has a link: label is the smallest node reachable.

    links: columns a < b of one ordered type, no nulls. A table after each step is written to the shared folder and the one before deleted, so
    lineage stays short and a lost executor costs one round at most. The rounds grow with the logarithm of the longest
    chain; RuntimeError if they do not suffice (never a partial result).
    """
    now, seen = stored(links.select("a", "b").distinct(), "links"), None
    for _ in range(rounds):
        now = _small_star(_large_star(now))
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            return now.select(F.col("b").alias("node"), F.col("a").alias("label")).union(now.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
        seen = mark
    raise RuntimeError("components did not settle")
