import datetime as dt
import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import Row, functions as F

from importflow.operators import jobs as job_ops
from importflow.operators.ledger import read_ledger
from importflow.operators.lifecycle import job_states
from importflow.operators.throttle import Bucket, token_bucket
from importflow.schemas import JOBS
from importflow.session import freeze
from importflow.sources.messages import publish
from importflow.sources.tables import write_table
from importflow.streaming import import_stream, stateful
from importflow.streaming.import_stream import ImportHome, append_log, jobs_now, start_import
from importflow.streaming.stateful import stream_job_states, stream_token_bucket

FIVE = ("email,first_name,last_name,phone\nalice@x.co,A,B,+1-555-0100\nbob@x.co,B,C,\n"
        "carol@x.co,C,D,555 0199\nnot-an-email,Dave,Davis,\neve@x.co,,Evans,")


@pytest.fixture
def home(spark, tmp_path):
    files = {"good": FIVE, "bad": 'email,first_name,last_name,phone\na@b.co,"x"y,B,\n', "empty": ""}
    return home_with(spark, tmp_path, ["good", "bad", "lost", "empty", "waiting"], files)


def home_with(spark, tmp_path, names, files):
    """All jobs but the last are confirmed."""
    home = ImportHome(str(tmp_path / "home"))
    requests = spark.createDataFrame([(n, "org", "u") for n in names],
                                     "id string, org_id string, submitted_by string")
    write_table(job_ops.create_jobs(requests, F.col("id")), home.folder("jobs"), JOBS)
    for name, text in files.items():
        folder = tmp_path / "home" / "uploads" / "org" / name
        folder.mkdir(parents=True)
        (folder / "source.csv").write_text(text)
    zero = F.lit(0).cast("bigint")
    append_log(spark, home, spark.createDataFrame([(n,) for n in names[:-1]], "job_id string").select(
        "job_id", F.lit(dt.datetime(2024, 1, 1)).alias("ts"), F.lit(-1).cast("bigint").alias("event_id"),
        F.lit("CONFIRM").alias("event"), F.lit(True).alias("upload_present"), zero.alias("valid_rows"),
        zero.alias("invalid_rows"), zero.alias("last_row")), -1)
    return home


def send(spark, home, *names):
    publish(spark.createDataFrame([(n,) for n in names], "jobId string").coalesce(1), home.folder("messages"))


def run(spark, home):
    start_import(spark, home, files_per_batch=1, available_now=True).awaitTermination()
    return {r["id"]: (r["status"], r["version"], r["processed_rows"], r["failed_rows"], r["total_rows"])
            for r in jobs_now(spark, home).collect()}


DONE = {"good": ("COMPLETED", 5, 3, 2, 5), "bad": ("FAILED", 3, 0, 0, None), "lost": ("FAILED", 3, 0, 0, None),
        "empty": ("COMPLETED", 3, 0, 0, 0), "waiting": ("PENDING", 0, 0, 0, None)}


def test_keys_with_blanks_and_signs(spark, tmp_path):
    names = ["a b", "50%", "x%20y", "p+q", "uploads", "waiting"]
    home = home_with(spark, tmp_path, names, dict.fromkeys(names[:-1], FIVE))
    send(spark, home, *names[:-1])
    done = run(spark, home)
    assert {n: done[n] for n in names[:-1]} == dict.fromkeys(names[:-1], DONE["good"])


def test_messages_to_finished_jobs(spark, home, tmp_path):
    send(spark, home, "good", "good", "unknown", "waiting")
    send(spark, home, "bad", "lost", "empty", "good")
    assert run(spark, home) == DONE
    ledger = read_ledger(spark, home.folder("ledger"))
    assert ledger.where("outcome = 'VALID'").count() == 3
    dead = spark.read.json(home.folder("dead_letters")).select("jobId").collect()
    assert sorted(r[0] for r in dead) == ["bad", "lost"]
    with open(f"{home.folder('uploads')}/org/good/errors.csv", "rb") as file:
        assert file.read() == b"row_number,error\r\n4,email is invalid\r\n5,first_name is required\r\n"
    send(spark, home, "good", "bad")        # redelivery of finished jobs changes nothing
    assert run(spark, home) == DONE
    assert read_ledger(spark, home.folder("ledger")).count() == ledger.count()


def test_a_batch_lost_before_its_log_is_replayed(spark, home, monkeypatch):
    send(spark, home, "good", "bad", "lost", "empty")

    def crash(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(import_stream, "append_log", crash)
        with pytest.raises(Exception, match="lost"):
            run(spark, home)
    assert jobs_now(spark, home).where("id = 'good'").first()["status"] == "QUEUED"
    assert run(spark, home) == DONE


def test_a_key_with_two_files_fails_its_job_alone(spark, tmp_path):
    home = home_with(spark, tmp_path, ["good", "two", "waiting"], {"good": FIVE})
    folder = tmp_path / "home" / "uploads" / "org" / "two" / "source.csv"
    folder.mkdir(parents=True)
    for name in ("a.csv", "b.csv"):
        (folder / name).write_text(FIVE)
    send(spark, home, "two", "good")
    done = run(spark, home)
    assert done["good"] == DONE["good"] and done["two"][0] == "FAILED"


def test_confirmation_takes_the_key_below_the_root(spark, tmp_path):
    home = ImportHome(str(tmp_path / "home"))
    requests = spark.createDataFrame([("j", "uploads", "u"), ("two", "uploads", "u")],
                                     "id string, org_id string, submitted_by string")
    write_table(job_ops.create_jobs(requests, F.col("id")), home.folder("jobs"), JOBS)
    folder = tmp_path / "home" / "uploads" / "uploads"
    (folder / "j").mkdir(parents=True)
    (folder / "j" / "source.csv").write_text(FIVE)
    (folder / "two" / "source.csv").mkdir(parents=True)
    for name in ("a.csv", "b.csv"):
        (folder / "two" / "source.csv" / name).write_text(FIVE)
    asked = requests.select(F.col("id").alias("job_id"), "org_id")
    decided = import_stream.confirm_uploads(spark, home, asked, 1, pattern="*.csv").collect()
    assert sorted((r["id"], r["outcome"]) for r in decided) == [("j", "QUEUED"), ("two", "UPLOAD_NOT_FOUND")]


def test_a_new_checkpoint_over_a_used_log_is_refused(spark, home):
    append_log(spark, home, import_stream.read_log(spark, home).drop("batch_id").limit(0), 0)
    with pytest.raises(ValueError, match="another checkpoint"):
        run(spark, home)


def test_bare_cr_and_another_message_source(spark, tmp_path):
    home = home_with(spark, tmp_path, ["good", "waiting"], {"good": FIVE.replace("\n", "\r")})
    send(spark, home, "good")
    stream = spark.readStream.schema("jobId string").json(home.folder("messages"))
    start_import(spark, home, available_now=True, messages=stream, line_sep="\r").awaitTermination()
    job = jobs_now(spark, home).where("id = 'good'").first()
    assert (job["status"], job["processed_rows"], job["failed_rows"]) == ("COMPLETED", 3, 2)


def test_life_of_a_job(spark, tmp_path):
    """Create, upload, confirm, lose the message, recover, import, fetch the result."""
    home = ImportHome(str(tmp_path / "home"))
    requests = spark.createDataFrame([("j", "org"), ("none", "org")], "id string, org_id string")
    write_table(job_ops.create_jobs(requests.withColumn("submitted_by", F.lit("u")), F.col("id")),
                home.folder("jobs"), JOBS)
    folder = tmp_path / "home" / "uploads" / "org" / "j"
    folder.mkdir(parents=True)
    (folder / "source.csv").write_text(FIVE)
    asked = requests.withColumnRenamed("id", "job_id")
    foreign = asked.withColumn("org_id", F.lit("other"))
    assert import_stream.confirm_uploads(spark, home, foreign, 1).collect() == []
    decided = import_stream.confirm_uploads(spark, home, asked, 2).collect()
    assert {r["id"]: r["outcome"] for r in decided} == {"j": "QUEUED", "none": "UPLOAD_NOT_FOUND"}
    again = import_stream.confirm_uploads(spark, home, asked, 3).collect()
    assert {r["id"]: r["outcome"] for r in again} == {"j": "UNCHANGED", "none": "UPLOAD_NOT_FOUND"}
    assert import_stream.publish_missing(spark, home).collect() == []
    for part in (tmp_path / "home" / "messages").glob("*.json"):
        part.write_text("")
    assert [r["jobId"] for r in import_stream.publish_missing(spark, home).collect()] == ["j"]
    run(spark, home)
    job = jobs_now(spark, home).where("id = 'j'")
    row = job.first()
    assert (row["status"], row["processed_rows"], row["failed_rows"], row["total_rows"]) == ("COMPLETED", 3, 2, 5)
    assert [tuple(r)[2:] for r in job_ops.result_outcome(job).collect()] == [("REPORT", "org/j/errors.csv")]


def test_streamed_bucket_equals_the_batch(spark, tmp_path):
    rng = random.Random(7)
    events = spark.createDataFrame(
        [(rng.choice("abbb"), 1_700_000_000 + i * rng.randrange(1, 3), i) for i in range(400)],
        "k string, s bigint, event_id bigint").select("k", "event_id", F.timestamp_seconds("s").alias("ts"))
    events = freeze(events.withColumn("s", F.col("ts")).orderBy("ts", "event_id"))
    rows = events.drop("s").orderBy("ts", "event_id").collect()
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(4):   # four micro-batches, in time order
        spark.createDataFrame(rows[part * 100:(part + 1) * 100], events.drop("s").schema).coalesce(1) \
            .write.mode("append").parquet(folder)
    stream = spark.readStream.schema(events.drop("s").schema).option("maxFilesPerTrigger", 1).parquet(folder)
    (stream_token_bucket(stream, "k", 3, 1, 5_000_000).writeStream.outputMode("update")
     .trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp"))
     .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"))
     .start().awaitTermination())
    got = sorted(map(tuple, spark.read.parquet(out).drop("batch").collect()))
    wanted = sorted(map(tuple, token_bucket(events.drop("s"), "k", 3, 1, 5_000_000).collect()))
    assert got == wanted


class Held:
    """A value state that counts what is asked of it."""

    def __init__(self):
        self.value, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value


def started(processor, held):
    processor.init(SimpleNamespace(getValueState=lambda name, shape: held))
    return processor


def test_decisions_of_a_large_key_leave_in_batches(monkeypatch):
    monkeypatch.setattr(stateful, "DECISIONS", 100)
    rng = random.Random(5)
    events = [(rng.randrange(3000) * 1_000_000, i) for i in range(1000)]
    long_id = (1 << 60) + 1     # pandas must not round it
    events.append((5, long_id))
    bucket = Bucket(3, 1, 5_000_000)
    held = Held()
    processor = started(stateful.BucketProcessor(bucket, ["k", "event_id", "allowed", "remaining", "retry_after"]), held)
    parts = [pd.DataFrame({"k": "a", "event_id": [e for _, e in some], "nameless": False, "ts_us": [t for t, _ in some]})
             for some in (events[:400], events[400:])]
    frames = list(processor.handleInputRows(("a",), iter(parts), None))
    assert max(map(len, frames)) == 100 and sum(map(len, frames)) == 1001
    wanted, full_at = [], None
    for ts_us, event_id in sorted(events):
        full_at, *decision = bucket.step(full_at, ts_us)
        wanted.append(("a", event_id, *decision))
    assert [tuple(r) for f in frames for r in f.astype(object).itertuples(index=False)] == wanted
    assert held.value == (full_at, max(events)[0])


def test_streamed_bucket_decides_events_without_an_id(spark, tmp_path):
    shape = "k string, s bigint, event_id bigint"
    events = spark.createDataFrame([("a", 1, (1 << 60) + 1), ("a", 1, None), (None, 1, 4), ("b", 2, None)], shape).select(
        "k", "event_id", F.timestamp_seconds("s").alias("ts"))
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    events.coalesce(1).write.parquet(folder)
    (stream_token_bucket(spark.readStream.schema(events.schema).parquet(folder), "k", 3, 1, 5_000_000)
     .writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp"))
     .foreachBatch(lambda df, n: df.write.mode("append").parquet(out)).start().awaitTermination())
    got = {(r.k, r.event_id): (r.allowed, r.remaining) for r in spark.read.parquet(out).collect()}
    assert got == {("a", None): (True, 2), ("a", (1 << 60) + 1): (True, 1), ("b", None): (True, 2)}


def test_jobs_of_a_bucket_share_one_read_and_one_write():
    held = Held()
    processor = started(stateful.JobStateProcessor(), held)
    event = Row("job_id", "ts_us", "event_id", "event", "upload_present", "valid_rows", "invalid_rows", "last_row")
    first = [event(f"j{i}", 1, i, "CONFIRM", True, 0, 0, 0) for i in range(50)]
    out = list(processor.handleInputRows((0,), iter(first), None))
    assert sorted(r.job_id for r in out) == sorted(f"j{i}" for i in range(50)) and held.calls == 2
    again = [event("j7", 3, 9, "FLUSH", True, 2, 1, 5), event("j7", 2, 8, "CLAIM", True, 0, 0, 0),
             event(None, 2, 8, "FAIL", True, 0, 0, 0)]
    out = {r.job_id: tuple(r)[1:] for r in processor.handleInputRows((0,), iter(again), None)}
    assert held.calls == 4
    assert out == {"j7": ("PROCESSING", 3, 2, 1, 5, None, 3, False), None: ("FAILED", 1, 0, 0, 0, None, 2, False)}


def test_streamed_job_states_equal_the_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stateful, "JOB_BUCKETS", 3)
    rng = random.Random(11)
    kinds = ["CONFIRM", "CLAIM", "FLUSH", "FLUSH", "ATTACH", "COMPLETE", "FAIL"]
    rows = [(f"j{rng.randrange(30)}", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), i, rng.choice(kinds),
             rng.random() < 0.8, rng.randrange(5), rng.randrange(3), i) for i in range(300)]
    shape = ("job_id string, ts timestamp, event_id bigint, event string, upload_present boolean, valid_rows bigint, "
             "invalid_rows bigint, last_row bigint")
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(2):
        spark.createDataFrame(rows[part * 150:(part + 1) * 150], shape).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    (stream_job_states(stream).writeStream.outputMode("update").trigger(availableNow=True)
     .option("checkpointLocation", str(tmp_path / "cp"))
     .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).start().awaitTermination())
    got = {}
    for r in spark.read.parquet(out).orderBy("batch").collect():
        got[r.job_id] = tuple(r)[1:-1]
    batch = job_states(spark.createDataFrame(rows, shape)).withColumn("updated_at", F.unix_micros("updated_at"))
    assert got == {r.job_id: tuple(r)[1:] for r in batch.collect()}


def test_halves_find_what_fails_alone():
    calls = []

    def work(items, number):
        calls.append(number)
        if {"b", "f"} & set(items):
            raise ValueError("no")
        return items

    done, failed = import_stream.in_halves(work, list("abcdefg"))
    assert sorted(x for part in done for x in part) == list("acdeg") and failed == [("b", "no"), ("f", "no")]
    assert len(set(calls)) == len(calls)
    assert import_stream.in_halves(work, ["a"]) == ([["a"]], [])


def test_a_file_that_cannot_be_read_is_tried_again_and_holds_up_no_other(spark, tmp_path):
    """Attempts, back-off by timers, dead letter, and the failed job, beside a sound one."""
    import time

    home = home_with(spark, tmp_path, ["good", "zip", "waiting"], {"good": FIVE})
    folder = tmp_path / "home" / "uploads" / "org" / "zip"
    folder.mkdir(parents=True)
    (folder / "source.csv.gz").write_text("no archive")
    jobs = spark.read.parquet(home.folder("jobs")).withColumn(
        "source_object_key", F.when(F.col("id") == "zip", "org/zip/source.csv.gz").otherwise(F.col("source_object_key")))
    rows = jobs.collect()
    write_table(spark.createDataFrame(rows, jobs.schema), home.folder("jobs"), JOBS, mode="overwrite")
    send(spark, home, "zip", "good")
    done = run(spark, home)
    assert done["good"] == DONE["good"] and done["zip"][0] == "PROCESSING"
    retries = import_stream.start_retries(spark, home, max_attempts=2, initial_s=0.1, every="100 milliseconds")
    try:
        until = time.monotonic() + 100
        while time.monotonic() < until:
            status = run(spark, home)["zip"][0]
            import_stream.start_dead_letters(spark, home, available_now=True).awaitTermination()
            if status == "FAILED":
                break
    finally:
        retries.stop()
    assert status == "FAILED" and run(spark, home)["good"] == DONE["good"]
    tried = spark.read.schema(import_stream.ATTEMPT).json(home.folder("attempts")).collect()
    assert [r.jobId for r in tried] == ["zip", "zip"] and all(r.why for r in tried)
    dead = spark.read.schema("jobId string").json(home.folder("dead_letters")).collect()
    assert [r.jobId for r in dead] == ["zip"]
