"""Joins that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from importflow.session import freeze

BROADCAST_ROWS = 200_000    # tables above this are never hinted for broadcast
PIECE_ROWS = 1_000_000      # rows of one key that may go to one task
MOST_HOT_KEYS = 10_000      # at most this many keys are ever treated as hot


def has_at_most(df: DataFrame, rows: int) -> bool:
    return df.limit(rows + 1).count() <= rows


def checked_broadcast(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Hint ``df`` for broadcast only if it was counted and found small.

    Give it a frozen or otherwise cheap table: the count is a job of its own.
    """
    return F.broadcast(df) if has_at_most(df, rows or BROADCAST_ROWS) else df


def spread_join(
    big: DataFrame,
    small: DataFrame,
    key: str,
    rows: str,
    by: list[str],
    how: str = "left",
    piece: int | None = None,
) -> DataFrame:
    """Join ``big`` to ``small`` (one row per key, ``rows`` = its row count in ``big``).

    Keys with more than ``piece`` rows are cut in that many pieces by a hash of ``by``;
    the matching row of ``small`` is copied once per piece.  The piece size follows the
    total, so the list of hot keys that is broadcast never exceeds MOST_HOT_KEYS.
    """
    small = freeze(small)
    total = small.agg(F.coalesce(F.sum(rows), F.lit(0))).first()[0]
    piece = max(piece or PIECE_ROWS, total // MOST_HOT_KEYS + 1)
    hot = small.where(F.col(rows) > piece).select(
        key, F.ceil(F.col(rows) / piece).cast("int").alias("__pieces")
    )
    if not hot.take(1):
        return big.join(small.drop(rows), key, how)
    salted = big.join(F.broadcast(hot), key, "left").withColumn(
        "__piece",
        F.when(
            F.col("__pieces").isNotNull(),
            F.pmod(F.xxhash64(*by), F.col("__pieces").cast("bigint")),
        ).otherwise(0),
    )
    copies = F.when(F.col(rows) > piece, F.ceil(F.col(rows) / piece)).otherwise(1).cast("bigint")
    copied = small.withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("bigint"), copies - 1)))
    joined = salted.join(copied.drop(rows), [key, "__piece"], how)
    return joined.drop("__piece", "__pieces")


def filter_by_keys(
    big: DataFrame, keys: DataFrame, key: str, by: list[str], keep: bool, piece: int | None = None,
    broadcast_rows: int | None = None,
) -> DataFrame:
    """Rows of ``big`` whose key is (``keep``) or is not in ``keys``; NULL keys never match."""
    how = "left_semi" if keep else "left_anti"
    keys = freeze(keys.select(key).where(F.col(key).isNotNull()).distinct())
    if has_at_most(keys, BROADCAST_ROWS if broadcast_rows is None else broadcast_rows):
        return big.join(F.broadcast(keys), key, how)
    weighted = big.groupBy(key).agg(F.count(F.lit(1)).alias("__rows")).join(keys, key, "left_semi")
    return spread_join(big, weighted, key, "__rows", by, how, piece)
