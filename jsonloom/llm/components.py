"""Connected components of a distributed graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, first_row


def components(links: DataFrame, work: Work | None = None) -> DataFrame:
    """Columns node, component (its smallest node), of the links' ends; links have columns a, b.

    A node's neighbours are never gathered: each star is a minimum by node,
    summed up before the shuffle, and a join. Every round is written as a table,
    and the one before deleted.
    """
    work = work or Work(links.sparkSession)
    pairs = work.store(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    state = digest(pairs)
    while state[0]:
        # large star: larger neighbours go to the smallest one around
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(least.where("m < a").select("a", F.col("m").alias("b"))).where("a > b")
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        done, pairs = pairs, work.store(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        work.drop(done)
        before, state = state, digest(pairs)
        if state == before:
            break
    nodes = pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def digest(pairs: DataFrame) -> tuple[int, int]:
    """Number of the pairs and a hash of their set."""
    return tuple(first_row(pairs.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)))))
