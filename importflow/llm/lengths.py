"""Token counts from an exact histogram of lengths.

Each task counts its documents by encoded length; the sums by length are all that is shuffled.
For every length the answers come from suffix sums: what is left of the total when documents are
cut there, how many are longer, and the share of documents up to it (so any quantile).

NULL and empty texts: length 0.  Repeated rows count each.  Empty table: empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from importflow.llm import rows, tokens

BLOCK = 1024    # lengths that are summed up together; blocks number the longest text / BLOCK


def histogram(df: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """n_tokens, n_docs: how many documents have each length."""

    def count(unit):
        lengths = [len(x) for x in tokens.encoder(vocabulary)(unit.column(text).fill_null("").to_pylist())]
        n_tokens, n_docs = np.unique(lengths, return_counts=True)
        return rows.batch(n_tokens=pa.array(n_tokens, pa.int64()), n_docs=pa.array(n_docs, pa.int64()))

    counted = rows.map_units(df.select(text), text, count, "n_tokens long, n_docs long")
    return counted.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def answers(counts: DataFrame) -> DataFrame:
    """For each length as a context limit: n_docs of it, longer_docs, truncated_tokens (the total
    when every document is cut there), tokens_up_to (of documents that fit) and share_up_to.

    Suffix sums run over blocks of lengths first, then within each block.
    """
    counts = counts.withColumn("__block", F.floor(F.col("n_tokens") / BLOCK)).withColumn(
        "__tokens", F.col("n_docs") * F.col("n_tokens")
    )
    blocks = counts.groupBy("__block").agg(F.sum("n_docs").alias("__d"), F.sum("__tokens").alias("__t"))
    above = Window.orderBy(F.desc("__block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("__block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = blocks.select(
        "__block",
        F.coalesce(F.sum("__d").over(above), F.lit(0)).alias("__docs_above"),
        F.coalesce(F.sum("__t").over(above), F.lit(0)).alias("__tokens_above"),
        F.sum("__d").over(every).alias("__all_docs"), F.sum("__t").over(every).alias("__all_tokens"),
    )
    inside = Window.partitionBy("__block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    longer = F.col("__docs_above") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0))
    longer_tokens = F.col("__tokens_above") + F.coalesce(F.sum("__tokens").over(inside), F.lit(0))
    up_to = F.col("__all_tokens") - F.col("__longer_tokens")
    return (
        counts.join(sums, "__block")
        .withColumn("longer_docs", longer).withColumn("__longer_tokens", longer_tokens)
        .select(
            "n_tokens", "n_docs", "longer_docs",
            (up_to + F.col("longer_docs") * F.col("n_tokens")).alias("truncated_tokens"),
            up_to.alias("tokens_up_to"),
            ((F.col("__all_docs") - F.col("longer_docs")) / F.col("__all_docs")).alias("share_up_to"),
        )
    )


def at_limits(counts: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, truncated_tokens, longer_docs for limits that need not be lengths."""
    spark = counts.sparkSession
    asked = spark.createDataFrame([(int(n),) for n in limits], "context_limit long")
    cut = F.explode(F.array(*[
        F.struct(
            F.lit(int(n)).cast("long").alias("context_limit"),
            (F.least("n_tokens", F.lit(int(n))) * F.col("n_docs")).alias("kept"),
            F.when(F.col("n_tokens") > n, F.col("n_docs")).otherwise(0).alias("longer"),
        ) for n in limits
    ])).alias("at")
    found = counts.select(cut).groupBy("at.context_limit").agg(
        F.sum("at.kept").alias("truncated_tokens"), F.sum("at.longer").alias("longer_docs")
    )
    return asked.join(found, "context_limit", "left").na.fill(0)


def quantiles(answered: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the least length up to which at least that share of the documents lies."""
    least = [F.min(F.when(F.col("share_up_to") >= q, F.col("n_tokens"))).alias(str(i)) for i, q in enumerate(shares)]
    pairs = [F.struct(F.lit(float(q)).alias("share"), F.col(str(i)).alias("n_tokens")) for i, q in enumerate(shares)]
    return answered.agg(*least).select(F.inline(F.array(*pairs)))
