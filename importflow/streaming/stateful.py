"""Streaming job states and token buckets, one small state per key.

Within a micro-batch the rows of a key are taken in (time, event id) order, so a task holds
the key's rows of one micro-batch (a token bucket's as two numbers and a flag each, and its
decisions leave in batches); the source must bound the micro-batch (``table_stream`` does).
There is no watermark: state is kept for as long as its key may come back.  The state
store must be the RocksDB one (``importflow.session.STATE_STORE``).  To work through a large
table, use the batch operators, which cut up large keys.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from importflow.functions.scalar import RETRY_INITIAL_S, RETRY_MAX_S, RETRY_MULTIPLIER
from importflow.operators.lifecycle import MAX_ATTEMPTS
from importflow.operators.throttle import Bucket, decision_schema

_JOB_STATE = T.StructType([
    T.StructField("status", T.StringType()), T.StructField("version", T.LongType()),
    T.StructField("processed_rows", T.LongType()), T.StructField("failed_rows", T.LongType()),
    T.StructField("last_processed_row", T.LongType()), T.StructField("total_rows", T.LongType()),
    T.StructField("updated_us", T.LongType()), T.StructField("report_attached", T.BooleanType()),
])
JOB_ROW = T.StructType([T.StructField("job_id", T.StringType()), *_JOB_STATE.fields])
NEW_JOB = ("PENDING", 0, 0, 0, 0, None, None, False)


def next_job_state(state: tuple, event) -> tuple:
    """One transition; the batch fold in ``operators.lifecycle`` gives the same result."""
    status, version, processed, failed, last, total, updated, attached = state
    kind = event["event"]
    before = (status, processed, failed, total, attached)
    if kind == "CONFIRM" and status == "PENDING" and event["upload_present"]:
        status = "QUEUED"
    elif kind == "CLAIM" and status == "QUEUED":
        status = "PROCESSING"
    elif kind == "FLUSH":
        processed += event["valid_rows"]
        failed += event["invalid_rows"]
        last = event["last_row"]
    elif kind == "ATTACH":
        attached = True
    elif kind == "COMPLETE":
        status, total = "COMPLETED", processed + failed
    elif kind == "FAIL" and status != "COMPLETED":
        status = "FAILED"
    if (status, processed, failed, total, attached) != before:
        version, updated = version + 1, event["ts_us"]
    return status, version, processed, failed, last, total, updated, attached


JOB_BUCKETS = 1 << 14


class JobStateProcessor(StatefulProcessor):
    """The jobs of a bucket, whose states are read and written together.

    To call Python and to ask the state store for every job takes about a millisecond, far longer
    than its few events do.  A bucket that is touched is read whole, which takes as long as that
    from some thousand jobs a bucket on.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("jobs", T.StructType([T.StructField("states", T.BinaryType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        jobs: dict[str | None, list[Row]] = {}
        for event in rows:
            jobs.setdefault(event["job_id"], []).append(event)
        held = self.state.get()     # None for a new bucket
        states = {} if held is None else pickle.loads(held[0])
        for job_id, events in jobs.items():
            state = states.get(job_id, NEW_JOB)
            for event in sorted(events, key=lambda r: (r["ts_us"], r["event_id"])):
                state = next_job_state(state, event)
            states[job_id] = state
        self.state.update((pickle.dumps(states, 5),))
        named = Row(*JOB_ROW.names)
        for job_id in jobs:
            yield named(job_id, *states[job_id])

    def close(self) -> None:
        pass


def stream_job_states(log: DataFrame) -> DataFrame:
    """Current state of every job named in a micro-batch (update mode)."""
    slim = log.select(
        F.pmod(F.hash("job_id"), F.lit(JOB_BUCKETS)).alias("bucket"),
        "job_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "event_id", "event",
        F.coalesce("upload_present", F.lit(True)).alias("upload_present"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
          for c in ("valid_rows", "invalid_rows", "last_row")],
    )
    return slim.groupBy("bucket").transformWithState(
        JobStateProcessor(), JOB_ROW, outputMode="update", timeMode="none"
    )


DECISIONS = 10_000     # rows that leave a token bucket at once


class BucketProcessor(StatefulProcessor):
    def __init__(self, bucket: Bucket, columns: list[str]):
        self.bucket, self.columns = bucket, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        shape = T.StructType([
            T.StructField("full_at", T.LongType()), T.StructField("seen_us", T.LongType()),
        ])
        self.state = handle.getValueState("bucket", shape)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        full_at, seen = self.state.get() or (None, None)
        parts = []
        for part in rows:
            if part["ts_us"].isna().any():
                raise TypeError("an event without a time has no place in the order")
            parts.append([part[c].to_numpy() for c in ("ts_us", "nameless", "event_id")])
        ts, nameless, ids = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        order = np.lexsort((ids, ~nameless, ts))
        for first in range(0, len(order), DECISIONS):
            here = order[first:first + DECISIONS]
            decisions = []
            for ts_us in ts[here].tolist():
                # An event older than the last one seen refills nothing.
                seen = ts_us if seen is None else max(seen, ts_us)
                full_at, *decision = self.bucket.step(full_at, seen)
                decisions.append(decision)
            named = pd.arrays.IntegerArray(ids[here], nameless[here])
            yield pd.DataFrame(dict(zip(self.columns, (key[0], named, *zip(*decisions)))))
        self.state.update((full_at, seen))

    def close(self) -> None:
        pass


def stream_token_bucket(
    events: DataFrame, key: str, capacity: int, refill: int, period_us: int
) -> DataFrame:
    """Decide every event of a micro-batch that has a key."""
    named = events.where(F.col(key).isNotNull())
    shape = decision_schema(named.schema[key])
    # pandas reads an integer column with NULL as floating point, which would round long ids
    slim = named.select(
        key, F.coalesce("event_id", F.lit(0)).cast("bigint").alias("event_id"),
        F.isnull("event_id").alias("nameless"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
    )
    processor = BucketProcessor(Bucket(capacity, refill, period_us), shape.names)
    return slim.groupBy(key).transformWithStateInPandas(
        processor, shape, outputMode="update", timeMode="none"
    )


RETRY_DECISION = T.StructType([
    T.StructField("jobId", T.StringType()), T.StructField("decision", T.StringType()),
    T.StructField("failures", T.LongType()),
])


class RetryProcessor(StatefulProcessor):
    """Counts a job's failed attempts; a timer holds the next one back, until they are used up."""

    def __init__(self, max_attempts: int, initial_s: float, longest_s: float):
        self.max_attempts, self.initial_s, self.longest_s = max_attempts, initial_s, longest_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("failures", T.StructType([T.StructField("n", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.state.get()
        failures = (held[0] if held else 0) + sum(1 for _ in rows)
        self.state.update((failures,))
        if failures >= self.max_attempts:
            self.state.clear()
            yield Row(*RETRY_DECISION.names)(key[0], "DEAD", failures)
        else:
            wait = min(self.initial_s * RETRY_MULTIPLIER ** (failures - 1), self.longest_s)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(wait * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.state.get()
        if held:
            yield Row(*RETRY_DECISION.names)(key[0], "RETRY", held[0])

    def close(self) -> None:
        pass


def stream_retries(
    attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS, initial_s: float = RETRY_INITIAL_S,
    longest_s: float = RETRY_MAX_S,
) -> DataFrame:
    """RETRY for every failed attempt (``jobId``) once its back-off is over, DEAD for the last one."""
    return attempts.select("jobId").groupBy("jobId").transformWithState(
        RetryProcessor(max_attempts, initial_s, longest_s), RETRY_DECISION, outputMode="update",
        timeMode="ProcessingTime",
    )
