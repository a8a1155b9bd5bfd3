import random

import pytest
from pyspark.sql import Window, functions as F

from importflow.operators import skew
from importflow.operators.jobs import list_jobs
from importflow.operators.lifecycle import job_states, log_decisions
from importflow.operators.ordered import Timeline, number_rows, rows_between
from importflow.operators.quality import orphans
from importflow.operators.skew import filter_by_keys, spread_join
from importflow.operators.ledger import after_cursor
from importflow.operators.throttle import Bucket, rolling_failure_rate, token_bucket
from importflow.streaming.stateful import NEW_JOB, next_job_state


def table(spark, rows, shape, parts=5):
    return spark.createDataFrame(rows, shape).repartition(parts)


def test_numbering_of_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(20)}", rng.randrange(10), i)
            for i in range(2000)]
    df = table(spark, rows, "k string, t int, id int")
    window = Window.partitionBy("k").orderBy("t", "id")
    wanted = sorted(map(tuple, df.withColumn("n", F.row_number().over(window)).collect()))
    got = number_rows(df, ["k"], ["t", "id"], "n", limit=100)
    assert sorted(map(tuple, got.collect())) == wanted
    assert "checkpoint" not in str(number_rows(df, ["k"], ["t", "id"], "n").schema)


def test_running_totals_across_segments(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.randrange(100)) for i in range(1000)]
    df = table(spark, rows, "k string, id int, v int")
    line = Timeline.of(df, ["k"], ["id"], limit=50)
    assert line.segmented
    got = line.before(s=("sum", F.col("v")), m=("max", F.col("v"))).before(
        again=("sum", F.col("s"))).table()
    plain = Timeline.of(df, ["k"], ["id"], limit=10_000)
    assert not plain.segmented
    wanted = plain.before(s=("sum", F.col("v")), m=("max", F.col("v"))).before(
        again=("sum", F.col("s"))).table()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, wanted.collect()), key=repr)


def _bucket_by_hand(rows, bucket):
    """Token counts in exact fractions, event by event."""
    from fractions import Fraction

    tokens, at, out = {}, {}, {}
    for key, ts_us, event_id in sorted(rows, key=lambda r: (r[1], r[2])):
        gained = Fraction((ts_us - at.get(key, ts_us)) * bucket.refill, bucket.period_us)
        have = min(Fraction(bucket.capacity), tokens.get(key, Fraction(bucket.capacity)) + gained)
        allowed = have >= 1
        if allowed:
            have -= 1
        wait = 0 if allowed else max(1, int((1 - have) * bucket.period_us / bucket.refill) // 1_000_000)
        tokens[key], at[key] = have, ts_us
        out[key, event_id] = (allowed, int(have) if allowed else 0, wait)
    return out


@pytest.mark.parametrize("capacity,refill,period", [(10, 10, 60_000_000), (1, 3, 7_000_000), (4, 7, 33_000_001)])
@pytest.mark.parametrize("gap", [300_000, 3_000_000, 12_000_000])
def test_token_bucket_in_segments(spark, capacity, refill, period, gap):
    rng = random.Random(capacity * gap)
    rows, now = [], 1_700_000_000_000_000
    for i in range(1500):
        now += 0 if rng.random() < 0.3 else rng.randrange(gap) * (20 if rng.random() < 0.02 else 1)
        rows.append(("hot" if rng.random() < 0.7 else rng.choice("abc"), now, i))
    df = table(spark, rows, "k string, us bigint, event_id bigint").select(
        "k", "event_id", F.timestamp_micros("us").alias("ts"))
    bucket = Bucket(capacity, refill, period)
    wanted = _bucket_by_hand(rows, bucket)
    for limit in (50, 10_000):
        got = token_bucket(df, "k", capacity, refill, period, limit=limit).collect()
        assert {(r["k"], r["event_id"]): (r["allowed"], r["remaining"], r["retry_after"])
                for r in got} == wanted
    assert {a for a, _, _ in wanted.values()} == {True, False} or gap > 1_000_000


def test_three_pass_and_the_fourth_waits(spark):
    rows = [(u, F.lit(0), i) for i, u in enumerate(["u"] * 4 + ["v"])]
    df = spark.createDataFrame([(u, i) for u, _, i in rows], "u string, event_id bigint").withColumn(
        "ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    got = {r["event_id"]: tuple(r)[2:] for r in token_bucket(df, "u", 3, 3, 60_000_000).collect()}
    assert got == {0: (True, 2, 0), 1: (True, 1, 0), 2: (True, 0, 0), 3: (False, 0, 20), 4: (True, 2, 0)}


def test_default_limits(spark):
    from importflow.operators.throttle import throttle_addresses, throttle_users

    df = spark.range(150).select(F.lit("k").alias("user_id"), F.lit("k").alias("address"),
                                 F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(0)).alias("ts"))
    for throttled, capacity in ((throttle_users(df), 100), (throttle_addresses(df), 10)):
        assert throttled.where("allowed").count() == capacity


def test_bucket_pieces_stay_few():
    """The map that stands for a segment does not grow with its events."""
    from importflow.operators.throttle import BucketFold

    for gap in (1, 5_000, 11_000, 100_000):
        rng = random.Random(gap)
        fold = BucketFold(Bucket(10, 10, 100_000))
        summary, now, most = fold.unknown(), 10**9, 0
        for _ in range(20_000):
            now += rng.randrange(2 * gap)
            summary = fold.extend(summary, [now])
            most = max(most, len(summary[1]))
        assert most < 100, (gap, most)


@pytest.mark.parametrize("chunk", [10, 64])
def test_failure_rate_of_a_hot_key(spark, chunk):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(30)}", i // 3, i, rng.random() < 0.4)
            for i in range(1500)]
    df = table(spark, rows, "k string, s bigint, event_id bigint, failed boolean").withColumn(
        "ts", F.timestamp_seconds("s"))
    plain = rolling_failure_rate(df, "k").collect()
    hot = rolling_failure_rate(df, "k", limit=100, chunk_rows=chunk).collect()
    assert sorted(map(tuple, hot)) == sorted(map(tuple, plain))
    by_key = {}
    for k, _, i, failed in rows:
        by_key.setdefault(k, []).append((i, failed))
    for r in plain:
        upto = [f for i, f in by_key[r["k"]] if i <= r["event_id"]][-10:]
        assert (r["calls"], r["failures"]) == (len(upto), sum(upto))
        assert r["tripped"] == (len(upto) >= 5 and sum(upto) * 2 >= len(upto))


def _log(seed, n=1200):
    rng = random.Random(seed)
    kinds = ["CONFIRM", "CLAIM", "FLUSH", "FLUSH", "ATTACH", "COMPLETE", "FAIL"]
    rows = []
    for i in range(n):
        job = "hot" if rng.random() < 0.3 else f"j{rng.randrange(200)}"
        kind = rng.choice(kinds[:5]) if job == "hot" and i < n - 100 else rng.choice(kinds)
        rows.append((job, i // 4, i, kind, rng.random() < 0.7, rng.randrange(3), rng.randrange(2),
                     rng.randrange(1000)))
    return rows


LOG = ("job_id string, s bigint, event_id bigint, event string, upload_present boolean, "
       "valid_rows bigint, invalid_rows bigint, last_row bigint")


@pytest.mark.parametrize("limit", [60, 100_000])
def test_job_states_step_by_step(spark, limit):
    rows = _log(4)
    df = table(spark, rows, LOG).withColumn("ts", F.timestamp_seconds("s")).drop("s")
    states, decided = {}, {}
    for job, s, i, kind, there, v, bad, last in rows:
        before = states.get(job, NEW_JOB)
        event = dict(event=kind, upload_present=there, valid_rows=v, invalid_rows=bad, last_row=last,
                     ts_us=s * 1_000_000)
        states[job] = next_job_state(before, event)
        decided[i] = (before[0], states[job][0], states[job][1] > before[1])
    got = {r["event_id"]: (r["status_before"], r["status_after"], r["decision"] == "CHANGED")
           for r in log_decisions(df, limit).collect()}
    assert got == decided
    final = job_states(df, limit).withColumn("us", F.unix_micros("updated_at")).collect()
    assert {r["job_id"]: (r["status"], r["version"], r["processed_rows"], r["failed_rows"],
                          r["last_processed_row"], r["total_rows"], r["us"], r["report_attached"])
            for r in final} == states


def test_deep_page_equals_top_k(spark):
    rows = [(f"{i:05d}", 1, i % 7) for i in range(3000)]
    df = table(spark, rows, "id string, org_id int, d int").withColumn(
        "created_at", F.timestamp_seconds("d")).withColumn("status", F.lit("QUEUED"))
    for page in (0, 17, 29, 40):
        top = list_jobs(df, 1, page, 100).collect()
        deep = list_jobs(df, 1, page, 100, top_rows=200).collect()
        assert top == deep


def test_rank_index_with_ties_and_nulls(spark):
    """A third of the rows share one time, some have none; repeated rows cannot be told apart."""
    rows = [(f"{i:04d}", None if i % 10 == 0 else 7 if i % 3 == 0 else i) for i in range(1000)]
    rows += [("same", 7)] * 300
    df = table(spark, rows, "id string, d int").cache()
    whole = df.orderBy(F.col("d").desc(), F.col("id").desc()).collect()
    for first, count in ((0, 10), (640, 60), (700, 5), (1295, 20), (1300, 5), (5000, 5)):
        held, place = rows_between(df, ["d", "id"], first, count, 40, ranges=8)
        found = held.orderBy(F.col("d").desc(), F.col("id").desc()).offset(place).limit(count)
        assert found.collect() == whole[first:first + count]
        assert held.count() <= 500


def test_spread_join_equals_join(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(300)}", i) for i in range(3000)]
    big = table(spark, rows, "k string, id int")
    small = big.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m")).where("m % 2 = 0")
    plain = sorted(map(tuple, big.join(small.drop("n"), "k", "left").collect()), key=repr)
    for piece in (7, 100, 10_000):
        got = spread_join(big, small, "k", "n", ["id"], "left", piece)
        assert sorted(map(tuple, got.collect()), key=repr) == plain


def test_filter_by_keys(spark):
    big = table(spark, [("hot", i) for i in range(500)] + [(f"k{i}", i) for i in range(200)] + [(None, 1)],
                "k string, id int")
    keys = spark.createDataFrame([("hot",), ("k3",), ("k4",), (None,), ("absent",)], "k string")
    for keep in (True, False):
        wanted = sorted((r for r in map(tuple, big.collect()) if (r[0] in ("hot", "k3", "k4")) == keep), key=repr)
        for few in (100, 0):
            got = filter_by_keys(big, keys, "k", ["id"], keep, piece=20, broadcast_rows=few)
            assert sorted(map(tuple, got.collect()), key=repr) == wanted


def test_after_cursor(spark):
    rows = table(spark, [("hot", i) for i in range(1, 400)] + [("a", 1), ("a", 2), ("b", 1)],
                 "job_id string, source_row_number bigint")
    held = spark.createDataFrame([("hot", 390), ("a", 1)], "job_id string, cursor bigint")
    got = sorted(map(tuple, after_cursor(rows, held, piece=30).collect()))
    assert got == [("a", 2), ("b", 1)] + [("hot", i) for i in range(391, 400)]


def test_orphans_are_counted_before_the_join(spark):
    child = table(spark, [(1,)] * 50 + [(2,)] * 3 + [(None,)], "f int")
    parent = spark.createDataFrame([(2,)], "p int")
    assert [tuple(r) for r in orphans(child, "f", parent, "p").collect()] == [(1, 50)]


def test_broadcast_only_what_was_counted(spark, monkeypatch):
    df = spark.range(100)
    assert skew.checked_broadcast(df, 100) is not df
    assert skew.checked_broadcast(df, 99) is df


@pytest.mark.parametrize("share", [0.02, 0.5, 0.97])
def test_last_flush_in_segments(spark, share):
    from importflow.operators.flushes import last_flush

    rng = random.Random(share)
    rows, wanted = [], {}
    for key, count in (("hot", 3000), ("b", 40), ("c", 3), ("d", 700)):
        good = bad = 0
        for n in range(5, count + 5):
            valid = rng.random() < share
            good, bad = good + valid, bad + (not valid)
            if good == 7 or bad == 7:
                good = bad = 0
                wanted[key] = n
            rows.append((key, n, "VALID" if valid else "INVALID"))
    df = table(spark, rows, "k string, source_row_number bigint, outcome string")
    for limit in (60, 100_000):
        got = {r["k"]: r["flushed_to"] for r in last_flush(df, "k", 7, limit).collect()}
        assert got == wanted


def test_flush_summary_stands_for_its_rows():
    from importflow.operators.flushes import FlushFold

    rng, fold = random.Random(9), FlushFold(6)
    for count in (1, 5, 11, 60, 400):
        values = [rng.random() < 0.6 for _ in range(count)]
        summary = fold.close(fold.extend(fold.extend(fold.unknown(), values[:3]), values[3:]))
        for good in range(6):
            for bad in range(6):
                end, _ = fold.rows((good, bad), values)
                assert fold.resolve(summary, (good, bad)) == end
