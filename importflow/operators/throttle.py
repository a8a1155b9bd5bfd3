"""Token-bucket decisions and rolling failure rates over event tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F, types as T

from importflow.operators.ordered import Timeline, fold_in_order
from importflow.schemas import (
    ADDRESS_BUCKET, FAILURE_MIN_CALLS, FAILURE_PERCENT, FAILURE_WINDOW, USER_BUCKET,
)


@dataclass(frozen=True)
class Bucket:
    """``capacity`` tokens at first, ``refill`` tokens per ``period_us``, one per event.

    Time is scaled so that a token takes exactly ``period_us`` units to come back; all
    arithmetic is on integers.  The state is the moment at which the bucket would be full.
    """

    capacity: int
    refill: int
    period_us: int

    def step(self, full_at: int | None, ts_us: int) -> tuple[int, bool, int, int]:
        """(new state, allowed, remaining tokens, seconds to wait)."""
        now = ts_us * self.refill
        start = now if full_at is None or full_at < now else full_at
        wait = start - now - (self.capacity - 1) * self.period_us
        if wait > 0:
            return start, False, 0, max(1, wait // (self.refill * 1_000_000))
        full = start + self.period_us
        return full, True, self.capacity - -(-(full - now) // self.period_us), 0


def _apply_event(pieces: list[tuple], top: int, now: int, slack: int, cost: int) -> list[tuple]:
    """Compose one event onto a piecewise map of start state to current state.

    A piece is (first start state, moves, value): the current state is start + value where
    it moves with the start, else value itself; the last piece ends before ``top``.  Full
    bucket, event allowed and event refused are three ranges of the current state, so a
    moving piece may be cut twice; neighbours that come to agree are joined again.
    """
    out: list[tuple] = []

    def add(first, moves, value):
        if not out or out[-1][1] != moves or out[-1][2] != value:
            out.append((first, moves, value))

    ends = [p[0] for p in pieces[1:]] + [top]
    for (first, moves, value), end in zip(pieces, ends):
        if not moves:
            at = max(value, now)
            add(first, False, at + cost if at <= now + slack else at)
            continue
        full_to, allowed_to = now - value, now + slack + 1 - value
        if first < full_to:
            add(first, False, now + cost)
        if max(first, full_to) < min(end, allowed_to):
            add(max(first, full_to), True, value + cost)
        if max(first, allowed_to) < end:
            add(max(first, allowed_to), True, value)
    return out


class BucketFold:
    """A bucket run over the events of one key, in segments if need be."""

    reads = "ts_us"
    gives = ["allowed", "remaining", "retry_after"]

    def __init__(self, bucket: Bucket):
        self.bucket = bucket

    def start(self):
        return None

    def rows(self, state, values: list[int]):
        results = []
        for ts_us in values:
            state, *decision = self.bucket.step(state, ts_us)
            results.append(decision)
        return state, results

    def unknown(self):
        return None

    def extend(self, summary, values: list[int]):
        """A bucket is empty at worst, which bounds the start states by the first event."""
        bucket = self.bucket
        slack = (bucket.capacity - 1) * bucket.period_us
        if summary is None:
            top = values[0] * bucket.refill + bucket.capacity * bucket.period_us + 1
            summary = top, [(-(1 << 62), True, 0)]
        top, pieces = summary
        for ts_us in values:
            pieces = _apply_event(pieces, top, ts_us * bucket.refill, slack, bucket.period_us)
        return top, pieces

    def close(self, summary):
        return summary

    def resolve(self, summary, state):
        for first, moves, value in reversed(summary[1]):
            if first <= state:
                return state + value if moves else value
        raise ValueError("no piece holds the start state")


def token_bucket(
    events: DataFrame, key: str, capacity: int = USER_BUCKET[0], refill: int = USER_BUCKET[1],
    period_us: int = USER_BUCKET[2], limit: int | None = None,
) -> DataFrame:
    """Decide every event of ``key, ts, event_id``: allowed, remaining, retry_after.

    Events without a key are not throttled and have no row, as for callers not signed in.
    """
    slim = events.where(F.col(key).isNotNull()).select(
        key, "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us")
    )
    fold = BucketFold(Bucket(capacity, refill, period_us))
    return fold_in_order(
        slim, key, ["ts_us", "event_id"], fold, decision_schema(slim.schema[key]), limit
    )


def throttle_users(requests: DataFrame, key: str = "user_id", **limits) -> DataFrame:
    """The limit on a signed-in user's requests."""
    return token_bucket(requests, key, *USER_BUCKET, **limits)


def throttle_addresses(sign_ins: DataFrame, key: str = "address", **limits) -> DataFrame:
    """The stricter limit on an address's attempts to sign in."""
    return token_bucket(sign_ins, key, *ADDRESS_BUCKET, **limits)


def decision_schema(key: T.StructField) -> T.StructType:
    return T.StructType([
        T.StructField(key.name, key.dataType), T.StructField("event_id", T.LongType()),
        T.StructField("allowed", T.BooleanType()), T.StructField("remaining", T.LongType()),
        T.StructField("retry_after", T.LongType()),
    ])


CHUNK_ROWS = 1_000_000


def rolling_failure_rate(
    calls: DataFrame, key: str, window: int = FAILURE_WINDOW, min_calls: int = FAILURE_MIN_CALLS,
    percent: int = FAILURE_PERCENT, limit: int | None = None, chunk_rows: int | None = None,
) -> DataFrame:
    """Per call of ``key, ts, event_id, failed``: calls and failures in the last ``window``
    calls of the key, and whether their rate trips the threshold.

    A key too large for one task is cut in chunks by call number; the last calls of a chunk
    are copied to the next one, where they only serve as its history.
    """
    failed = F.col("failed").cast("int")
    timeline = Timeline.of(
        calls.select(key, "ts", "event_id", failed.alias("failed")), [key], ["ts", "event_id"], limit
    )
    if timeline.segmented:
        size = max(chunk_rows or CHUNK_ROWS, window)
        at = timeline.before(at=("sum", F.lit(1))).table()
        chunk = F.floor(F.col("at") / size)
        tail = F.col("at") % size >= size - (window - 1)
        rows = at.withColumn(
            "chunk", F.explode(F.when(tail, F.array(chunk, chunk + 1)).otherwise(F.array(chunk)))
        )
        own = F.col("chunk") == F.floor(F.col("at") / size)
        over = Window.partitionBy(key, "chunk").orderBy("at").rowsBetween(1 - window, 0)
    else:
        rows, own = timeline.table(), F.lit(True)
        over = Window.partitionBy(key).orderBy("ts", "event_id").rowsBetween(1 - window, 0)
    measured = rows.withColumns({
        "calls": F.count(F.lit(1)).over(over), "failures": F.sum("failed").over(over),
    }).where(own)
    return measured.select(
        key, "event_id", "calls", "failures",
        ((F.col("calls") >= min_calls) & (F.col("failures") * 100 >= F.col("calls") * percent))
        .alias("tripped"),
    )
