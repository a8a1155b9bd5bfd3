"""Work that depends on the order of rows within a key, safe for very large keys.

A window over a key sends all rows of that key to one task.  Where a key is larger than
``GROUP_ROWS`` the rows are range-partitioned by (key, order) instead, so that a key covers
as many consecutive partitions ("segments") as it needs, and the layout is frozen in the
shared folder.  What a segment needs to know of the ones before it is then passed on through
a table that holds at most a few rows per segment.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from importflow.session import freeze

GROUP_ROWS = 5_000_000
RANGES = 256
SEGMENT = "__segment"


def has_large_group(df: DataFrame, keys: list[str], limit: int) -> bool:
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return bool(sizes.where(F.col("n") > limit).take(1))


def ordered_segments(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Range-partition and sort by (keys, order); remember the partition as the segment."""
    sort = [F.col(k) for k in keys] + order
    laid = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    return freeze(laid.withColumn(SEGMENT, F.spark_partition_id()))


class Timeline:
    """Rows ordered within each key, with running totals over the rows before each row."""

    def __init__(self, rows: DataFrame, keys: list[str], order: list[Column], segmented: bool):
        self.rows, self.keys, self.order, self.segmented = rows, keys, order, segmented

    @classmethod
    def of(
        cls, df: DataFrame, keys: list[str], order: list[Column | str], limit: int | None = None
    ) -> "Timeline":
        order = [F.col(o) if isinstance(o, str) else o for o in order]
        if has_large_group(df, keys, GROUP_ROWS if limit is None else limit):
            return cls(ordered_segments(df, keys, order), keys, order, True)
        return cls(df, keys, order, False)

    def before(self, **totals: tuple[str, Column]) -> "Timeline":
        """Add columns holding the ``sum`` or ``max`` over all earlier rows of the key.

        A sum over no rows is 0, a maximum over no rows is NULL.
        """
        fold = {"sum": F.sum, "max": F.max}
        local = self.keys + ([SEGMENT] if self.segmented else [])
        window = (
            Window.partitionBy(*local).orderBy(*self.order)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        rows = self.rows.select(
            "*", *[fold[kind](expr).over(window).alias(name) for name, (kind, expr) in totals.items()]
        )
        if self.segmented:
            rows = rows.join(self._carried(totals), self._same_segment(rows), "left").select(
                *[rows[c] for c in rows.columns if c not in totals],
                *[self._combine(kind, rows[n], F.col(f"__c.{n}")).alias(n)
                  for n, (kind, _) in totals.items()],
            )
        empty = {n: F.lit(0).cast("bigint") for n, (kind, _) in totals.items() if kind == "sum"}
        rows = rows.withColumns({n: F.coalesce(F.col(n), zero) for n, zero in empty.items()})
        return Timeline(rows, self.keys, self.order, self.segmented)

    def _carried(self, totals) -> DataFrame:
        """Per (key, segment): the totals over all earlier segments of the key."""
        fold = {"sum": F.sum, "max": F.max}
        earlier = (
            Window.partitionBy(*self.keys).orderBy(SEGMENT)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        per_segment = self.rows.groupBy(*self.keys, SEGMENT).agg(
            *[fold[kind](expr).alias(name) for name, (kind, expr) in totals.items()]
        )
        return per_segment.select(
            *[F.col(k).alias(f"__k{i}") for i, k in enumerate(self.keys)],
            F.col(SEGMENT).alias("__s"),
            F.struct(
                *[fold[kind](n).over(earlier).alias(n) for n, (kind, _) in totals.items()]
            ).alias("__c"),
        )

    def _same_segment(self, rows: DataFrame) -> Column:
        match = rows[SEGMENT] == F.col("__s")
        for i, k in enumerate(self.keys):
            match = match & rows[k].eqNullSafe(F.col(f"__k{i}"))
        return match

    @staticmethod
    def _combine(kind: str, here: Column, carried: Column) -> Column:
        if kind == "max":
            return F.greatest(here, carried)
        return F.coalesce(here, F.lit(0)) + F.coalesce(carried, F.lit(0))

    def table(self) -> DataFrame:
        return self.rows.drop(SEGMENT)


def number_rows(
    df: DataFrame, keys: list[str], order: list[Column | str], name: str, limit: int | None = None
) -> DataFrame:
    """``row_number()`` per key, 1-based."""
    counted = Timeline.of(df, keys, order, limit).before(**{name: ("sum", F.lit(1))})
    return counted.table().withColumn(name, F.col(name) + 1)


def rows_between(
    df: DataFrame, order: list[str], first: int, count: int, most: int, ranges: int = RANGES,
) -> tuple[DataFrame, int]:
    """Rows ``first`` to ``first + count`` (from 0) of ``df`` in falling ``order`` lie in the range of
    rows that is returned, and begin at the place that is returned.

    A round draws the bounds of ``ranges`` ranges from the rows by a hash, counts the rows of each
    (combined before the shuffle, and one number a range for the driver) and goes on in those that
    hold the page, until they have at most ``most`` rows or cannot be told apart.
    """
    key = F.struct(*order)
    spot = F.struct(F.xxhash64(*order).alias("h"), key.alias("k"))
    left = None
    while True:
        drawn = df.select(spot.alias("s")).orderBy("s").limit(ranges).select("s.k").distinct()
        # the bounds in falling order; the range of a row is how many lie above it
        bounds = freeze(drawn.agg(F.sort_array(F.collect_list("k"), asc=False))).scalar()
        above = F.size(F.filter("bounds", lambda b: b > F.col("k")))
        keyed = df.select(key.alias("k"), bounds.alias("bounds"))
        sizes = dict(keyed.select(above.alias("r")).groupBy("r").count().collect())
        total, low, high, start = 0, None, None, 0
        for r in sorted(sizes):
            if total < first + count and total + sizes[r] > first:
                low, start = (r, total) if low is None else (low, start)
                high = r
            total += sizes[r]
        if low is None:
            return df.limit(0), 0
        held = sum(n for r, n in sizes.items() if low <= r <= high)
        if low > 0:
            df = df.where(key < F.get(bounds, F.lit(low - 1)))
        if high < max(sizes):
            df = df.where(key >= F.get(bounds, F.lit(high)))
        first -= start
        if held <= most or held == left:
            return df, first
        left = held


class Fold(Protocol):
    """A sequential calculation over one column of the rows of one key.

    ``unknown``, ``extend`` and ``close`` build what a segment does to any start state, of a
    size that does not grow with the segment; ``resolve`` applies it to one.
    """

    reads: str                  # the column it reads
    gives: list[str]            # the columns it adds, one tuple per row

    def start(self) -> Any: ...
    def rows(self, state: Any, values: list) -> tuple[Any, list[tuple]]: ...
    def unknown(self) -> Any: ...
    def extend(self, summary: Any, values: list) -> Any: ...
    def close(self, summary: Any) -> Any: ...
    def resolve(self, summary: Any, state: Any) -> Any: ...


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive equal keys."""
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)])


def fold_in_order(
    df: DataFrame, key: str, order: list[str], fold: Fold, schema: T.StructType,
    limit: int | None = None,
) -> DataFrame:
    """Apply ``fold`` to the rows of each key in order; keys must not be NULL.

    The result has the columns of ``schema``: some of ``df`` and those the fold gives.

    A key that spans several segments is not folded by one task: each inner segment is
    summarised as a function of its unknown start state, the few summaries (one per
    segment at most) are chained, and every segment is then folded from its true start.
    Rows pass through in batches, so the memory of a task does not grow with its keys.
    """
    columns = [F.col(o) for o in order]
    carry: dict[int, Any] = {}
    if has_large_group(df, [key], GROUP_ROWS if limit is None else limit):
        laid = ordered_segments(df, [key], columns)
        carry = _start_states(laid, key, fold)
    else:
        laid = df.repartition(key).sortWithinPartitions(key, *columns)
        laid = laid.withColumn(SEGMENT, F.lit(-1))

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, first = None, None, True
        for part in batches:
            if not len(part):
                continue
            keys, values = part[key].to_numpy(), part[fold.reads].tolist()
            results: list[tuple] = []
            for begin, end in _runs(keys):
                if first or keys[begin] != current:
                    state = fold.start()
                    if first:
                        state = carry.get(int(part[SEGMENT].iloc[0]), state)
                    current, first = keys[begin], False
                state, given = fold.rows(state, values[begin:end])
                results += given
            out = part.assign(**dict(zip(fold.gives, map(list, zip(*results)))))
            yield out[schema.names]

    return laid.mapInPandas(apply, schema)


def _start_states(laid: DataFrame, key: str, fold: Fold) -> dict[int, Any]:
    """Start state of each segment whose first key began in an earlier segment."""
    edges = (
        laid.groupBy(SEGMENT).agg(F.min(key).alias("first"), F.max(key).alias("last"))
        .orderBy(SEGMENT).collect()   # one row per partition
    )
    continues = {b[SEGMENT] for a, b in zip(edges, edges[1:]) if a["last"] == b["first"]}
    wanted = []
    for a, b in zip(edges, edges[1:]):
        if b[SEGMENT] in continues:
            inner = a[SEGMENT] in continues and a["first"] == a["last"]
            wanted.append((a[SEGMENT], a["last"], inner))
    if not wanted:
        return {}
    spark = laid.sparkSession
    shape = T.StructType([
        T.StructField(SEGMENT, T.IntegerType()), T.StructField(key, laid.schema[key].dataType),
        T.StructField("__inner", T.BooleanType()),
    ])
    part_rows = laid.join(F.broadcast(spark.createDataFrame(wanted, shape)), [SEGMENT, key])

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segment, inner, state = None, None, None
        for part in batches:
            if not len(part):
                continue
            if segment is None:
                segment, inner = int(part[SEGMENT].iloc[0]), bool(part["__inner"].iloc[0])
                state = fold.unknown() if inner else fold.start()
            if inner:
                state = fold.extend(state, part[fold.reads].tolist())
            else:
                state, _ = fold.rows(state, part[fold.reads].tolist())
        if segment is not None:
            state = fold.close(state) if inner else state
            yield pd.DataFrame({"segment": [segment], "state": [pickle.dumps(state)]})

    found = {
        r["segment"]: pickle.loads(r["state"])
        for r in part_rows.mapInPandas(summarise, "segment int, state binary").collect()
    }   # at most one row per partition
    inner_segments = {s for s, _, inner in wanted if inner}
    states: dict[int, Any] = {}
    for a, b in zip(edges, edges[1:]):
        if b[SEGMENT] in continues:
            end = found[a[SEGMENT]]
            if a[SEGMENT] in inner_segments:
                end = fold.resolve(end, states[a[SEGMENT]])
            states[b[SEGMENT]] = end
    return states
