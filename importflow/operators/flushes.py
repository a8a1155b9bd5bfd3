"""Where an importer that works through a file row by row would have committed.

It commits whenever it holds ``COMMIT_ROWS`` valid rows, or as many invalid ones, since the
commit before.  Only files that fail need this: what they keep ends at the last such commit.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from importflow.operators.ordered import fold_in_order
from importflow.schemas import COMMIT_ROWS


class FlushFold:
    """State: valid and invalid rows held since the last commit."""

    reads = "valid"
    gives = ["flushed"]

    def __init__(self, size: int = COMMIT_ROWS):
        self.size = size

    def start(self):
        return 0, 0

    def rows(self, state, values: list[bool]):
        (good, bad), flushed = state, []
        for valid in values:
            good, bad = (good + 1, bad) if valid else (good, bad + 1)
            full = good >= self.size or bad >= self.size
            if full:
                good = bad = 0
            flushed.append((full,))
        return (good, bad), flushed

    def unknown(self):
        return []

    def extend(self, summary, values: list[bool]):
        summary.append(np.array(values, dtype=bool))
        return summary

    def close(self, summary):
        """The start state matters up to the first commit only, which can fall on one of the
        first ``size`` valid or the first ``size`` invalid rows; keep what follows from each.
        """
        valid = np.concatenate(summary)
        count, size = len(valid), self.size
        goods = np.concatenate([[0], np.cumsum(valid)])
        bads = np.arange(count + 1) - goods
        at_good = np.append(np.flatnonzero(valid) + 1, np.full(size, count + 1))
        at_bad = np.append(np.flatnonzero(~valid) + 1, np.full(size, count + 1))
        # The commit after a commit at row r, or r itself if there is none; then the last one.
        here = np.arange(count + 1)
        after = np.minimum(at_good[goods + size - 1], at_bad[bads + size - 1])
        after = np.where(after > count, here, after)
        while True:
            further = after[after]
            if np.array_equal(further, after):
                break
            after = further

        def ends(first):
            last = after[np.minimum(first, count)]
            return np.stack([goods[count] - goods[last], bads[count] - bads[last]], axis=1)

        first_good, first_bad = at_good[:size], at_bad[:size]
        return {
            "rows": count, "held": (int(goods[count]), int(bads[count])),
            "at": (first_good.astype(np.int64), first_bad.astype(np.int64)),
            "ends": (ends(first_good).astype(np.int16), ends(first_bad).astype(np.int16)),
        }

    def resolve(self, summary, state):
        good, bad = state
        need = self.size - good - 1, self.size - bad - 1
        rows = [summary["at"][k][need[k]] for k in (0, 1)]
        first = 0 if rows[0] <= rows[1] else 1
        if rows[first] > summary["rows"]:       # no commit in here
            return good + summary["held"][0], bad + summary["held"][1]
        return tuple(int(x) for x in summary["ends"][first][need[first]])


def last_flush(
    rows: DataFrame, key: str, size: int = COMMIT_ROWS, limit: int | None = None
) -> DataFrame:
    """Per key the row number of the last commit; no row if there is none.

    ``rows`` has the key, ``source_row_number`` and ``outcome``, from the cursor on.
    """
    slim = rows.select(key, "source_row_number", (F.col("outcome") == "VALID").alias("valid"))
    schema = T.StructType([
        slim.schema[key], T.StructField("source_row_number", T.LongType()),
        T.StructField("flushed", T.BooleanType()),
    ])
    marked = fold_in_order(slim, key, ["source_row_number"], FlushFold(size), schema, limit)
    return marked.where("flushed").groupBy(key).agg(F.max("source_row_number").alias("flushed_to"))
