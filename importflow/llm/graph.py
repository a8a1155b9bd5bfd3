"""Connected components of links held in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from importflow.llm.rows import Scratch


def components(links: DataFrame, scratch: Scratch, left: str = "a", right: str = "b") -> DataFrame:
    """node, root (the least node of its component) for every node with a link.

    Alternating star steps: every node is tied to the least of its neighbours, first its larger
    neighbours, then its smaller ones, until nothing moves.  Minima combine before the shuffle, and
    a node with many neighbours is a side of a join that can be split.
    """
    pairs = links.select(F.greatest(left, right).alias("node"), F.least(left, right).alias("root"))
    pairs = scratch.store(pairs.where("node <> root").distinct())
    while True:
        both = pairs.unionByName(pairs.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.min("root").alias("low")).withColumn("low", F.least("low", "node"))
        large = both.where("root > node").join(least, "node").select(F.col("root").alias("node"), F.col("low").alias("root"))
        large = large.distinct()
        low = large.groupBy("node").agg(F.min("root").alias("low"))
        small = large.join(low, "node")
        tied = small.select("node", F.col("low").alias("root")).unionByName(
            small.select(F.col("root").alias("node"), F.col("low").alias("root")).where("node <> root")
        )
        following = scratch.store(tied.distinct())
        if _mark(following) == _mark(pairs):
            return following
        pairs = following


def _mark(pairs: DataFrame):
    return pairs.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))
    ).first()
