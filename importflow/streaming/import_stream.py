"""Streaming import: job messages in, committed batches, reports and dead letters out.

Three streams make up an installation.  The import takes messages; a job whose file cannot be read is
told apart from those beside it, which are committed.  The retry stream holds each failed attempt back
for its back-off, then publishes the job again, or lays it down as a dead letter.  The dead-letter
stream fails those jobs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from importflow.operators.ledger import (
    file_system, import_errors, outcomes_of, read_progress,
)
from importflow.functions import report_key
from importflow.functions.scalar import RETRY_INITIAL_S, RETRY_MAX_S
from importflow.operators.jobs import admit_uploads
from importflow.operators.lifecycle import MAX_ATTEMPTS, claim_gate, current_jobs, unpublished_jobs
from importflow.operators.report import write_reports
from importflow.operators.skew import filter_by_keys
from importflow.plans.importer import import_files, part_of_batch, part_id
from importflow.schemas import JOB_MESSAGE, JOBS
from importflow.session import freeze
from importflow.sources.messages import message_files, publish
from importflow.sources.tables import read_table
from importflow.sources.uploads import look_up
from importflow.streaming.stateful import stream_retries

LOG_SCHEMA = (
    "job_id string, ts timestamp, event_id bigint, event string, upload_present boolean, "
    "valid_rows bigint, invalid_rows bigint, last_row bigint, batch_id bigint"
)
ATTEMPT = "jobId string, why string, batch_id bigint"
_LATER = 1 << 40        # log and dead-letter batches of the retry and dead-letter streams are numbered from here
_STEPS = 4      # event numbers per batch: claim, flush, attach, end


@dataclass(frozen=True)
class ImportHome:
    """Folders of one installation."""

    root: str

    def folder(self, name: str) -> str:
        return f"{self.root}/{name}"


def read_log(spark: SparkSession, home: ImportHome, without: int | None = None) -> DataFrame:
    fs, path = file_system(spark, home.folder("log"))
    if not fs.exists(path):
        return spark.createDataFrame([], LOG_SCHEMA)
    log = spark.read.schema(LOG_SCHEMA).parquet(home.folder("log"))
    return log if without is None else log.where(F.col("batch_id") != without)


def jobs_now(
    spark: SparkSession, home: ImportHome, without: int | None = None, only: DataFrame | None = None
) -> DataFrame:
    """The jobs as the log leaves them; ``only`` (``job_id``) spares folding all other jobs."""
    created = read_table(spark, home.folder("jobs"), JOBS)
    log = read_log(spark, home, without)
    if only is not None:
        log = filter_by_keys(log, only, "job_id", ["event_id"], keep=True)
        named = only.select(F.col("job_id").alias("id"))
        created = filter_by_keys(created, named, "id", ["id"], keep=True)
    return current_jobs(created, log)


def append_log(spark: SparkSession, home: ImportHome, events: DataFrame, batch_id: int) -> None:
    names = [c.split()[0] for c in LOG_SCHEMA.split(", ")][:-1]
    events.select(*names).write.mode("overwrite").parquet(
        f"{home.folder('log')}/batch_id={batch_id}"
    )


def _events(rows: DataFrame, event: Column, number: int) -> DataFrame:
    """Log rows of one kind for ``job_id`` rows, with counters where ``rows`` has them."""
    counters = ("valid_rows", "invalid_rows", "last_row")
    missing = {c: F.lit(0).cast("bigint") for c in counters if c not in rows.columns}
    return rows.withColumns({
        **missing, "event": event, "event_id": F.lit(number).cast("bigint"),
        "ts": F.current_timestamp(), "upload_present": F.lit(True),
    }).select("job_id", "ts", "event_id", "event", "upload_present", *counters)


def _keys_of(spark: SparkSession, home: ImportHome, path: Column) -> Column:
    """The keys that may name the file at ``path``: its own, and that of the folder holding it."""
    above = spark._jvm.org.apache.hadoop.fs.Path(home.folder("uploads")).toUri().getPath() + "/"
    below = F.substr(path, F.locate(above, path) + len(above))
    return F.array(below, F.regexp_replace(below, "/[^/]*$", ""))


def confirm_uploads(
    spark: SparkSession, home: ImportHome, asked: DataFrame, number: int, pattern: str = "source.csv"
) -> DataFrame:
    """Confirm uploads of ``asked`` (``job_id, org_id``); returns the decision per job.

    Jobs newly queued are logged first and published after, so a message never names a job
    that is not durably queued; ``publish_missing`` makes up for a loss in between.
    ``number`` counts confirmations from 1 up; a repeated number replaces its log rows.
    """
    jobs = jobs_now(spark, home, without=-number, only=asked.select("job_id"))
    own = jobs.join(
        asked.select(F.col("job_id").alias("id"), F.col("org_id")), ["id", "org_id"], "left_semi"
    )
    own = freeze(own)
    # Only a pending job's decision hangs on its object.  The keys reach the driver, as many as one
    # confirmation asks for; a folder of several files is no object, and its job is refused.
    keys = [r["source_object_key"] for r in own.where("status = 'PENDING'").select("source_object_key").collect()]
    sizes = [(key, length) for key, files, length in look_up(spark, home.folder("uploads"), keys, pattern) if files == 1]
    objects = spark.createDataFrame(sizes, "object_key string, length bigint")
    decided = freeze(admit_uploads(own, objects))
    queued = decided.where("outcome = 'QUEUED'").select(F.col("id").alias("job_id"))
    append_queued(spark, home, queued, number)
    return decided


def append_queued(spark: SparkSession, home: ImportHome, queued: DataFrame, number: int) -> None:
    """Log jobs (``job_id``) as queued under confirmation ``number``, then publish them."""
    append_log(spark, home, _events(queued, F.lit("CONFIRM"), -1), -number)
    publish(queued.select(F.col("job_id").alias("jobId")), home.folder("messages"))


def publish_missing(spark: SparkSession, home: ImportHome) -> DataFrame:
    """Publish the queued jobs no message names; returns them."""
    sent = spark.read.schema(JOB_MESSAGE).json(home.folder("messages"))
    missing = freeze(unpublished_jobs(jobs_now(spark, home), sent))
    publish(missing, home.folder("messages"))
    return missing


def in_halves(work: Callable, items: list, number: int = 0) -> tuple[list, list[tuple]]:
    """``work(items, number)``; where that raises, the same for either half, down to one item.

    Returns what the calls gave and (item, error) of those that fail alone.  Calls are numbered alike
    whenever the same items fail.
    """
    try:
        return [work(items, number)], []
    except Exception as error:      # whatever the file does to a reader; the attempt is counted
        if len(items) == 1:
            return [], [(items[0], str(error)[:1000])]
    half = len(items) // 2
    left, right = in_halves(work, items[:half], 2 * number + 1), in_halves(work, items[half:], 2 * number + 2)
    return left[0] + right[0], left[1] + right[1]


def process_messages(
    messages: DataFrame, batch_id: int, home: ImportHome, line_sep: str = "\n"
) -> None:
    """One micro-batch.  All of its writes replace what an earlier try of it left behind.

    The list of claimed jobs reaches the driver because a scan needs its paths there; the
    stream's admission limit bounds it.
    """
    spark = messages.sparkSession
    named = freeze(messages.select(F.col("jobId").alias("job_id")).distinct())
    jobs = freeze(jobs_now(spark, home, without=batch_id, only=named))
    gate = claim_gate(named.withColumnRenamed("job_id", "jobId"), jobs)
    claimed = gate.where(F.col("decision").isin("CLAIM", "RESUME")).select("job_id")
    keyed = freeze(claimed.join(
        jobs.select(F.col("id").alias("job_id"), "source_object_key"), "job_id"
    ))
    keys = [r["source_object_key"] for r in keyed.collect()]
    if not keys:
        return      # only redeliveries and unknown jobs
    claimed = keyed.select("job_id")
    # Several files are no object: that job fails.
    found = [(k, files) for k, files, _ in look_up(spark, home.folder("uploads"), keys) if files < 2]
    there, filled = [k for k, _ in found], [k for k, files in found if files]
    ended = keyed.where(~F.col("source_object_key").isin(there)).select(
        "job_id", F.lit("FAILED").alias("status")
    )
    ledger = home.folder("ledger")
    missed: list[tuple[str, str]] = []
    if there:
        def assign(files: DataFrame) -> DataFrame:
            path = F.url_decode(F.replace("file_path", F.lit("+"), F.lit("%2B")))
            named = files.withColumn("source_object_key", F.explode(_keys_of(spark, home, path)))
            return named.join(
                F.broadcast(keyed), "source_object_key"    # bounded as said above
            ).drop("source_object_key")

        def load(some: list[str], number: int) -> DataFrame:
            return freeze(import_files(
                spark, ledger, [f"{home.folder('uploads')}/{k}" for k in some], assign,
                part_id(batch_id, number), line_sep=line_sep,
            ))

        parts, missed = in_halves(load, sorted(there))
        there = [k for k in there if k not in dict(missed)]
        # An empty object is in no result; its job is done, with no rows.  Any other that the
        # scan did not return was not read, and its job fails.
        sound = keyed.where(F.col("source_object_key").isin(there))
        if parts:
            results = parts[0]
            for more in parts[1:]:
                results = results.unionByName(more)
            sound = sound.join(results, "job_id", "left")
        else:
            sound = sound.withColumn("status", F.lit(None).cast("string"))
        unread = F.when(F.col("source_object_key").isin(filled), "FAILED").otherwise("COMPLETED")
        ended = ended.unionByName(sound.select("job_id", F.coalesce("status", unread).alias("status")))
    told = spark.createDataFrame(missed, "source_object_key string, why string")
    told.join(keyed, "source_object_key").select(F.col("job_id").alias("jobId"), "why").write.mode(
        "overwrite").json(f"{home.folder('attempts')}/batch_id={batch_id}")
    ended = freeze(ended)
    done = ended.where("status = 'COMPLETED'").select("job_id")

    errors = import_errors(outcomes_of(spark, ledger, done))
    keys_of_reports = keyed.join(done, "job_id").select(
        "job_id", report_key("source_object_key").alias("error_report_object_key"))
    write_reports(errors, keys_of_reports, home.folder("uploads"))
    reported = errors.select("job_id").distinct()
    ended.where("status = 'FAILED'").select(F.col("job_id").alias("jobId")).write.mode(
        "overwrite"
    ).json(f"{home.folder('dead_letters')}/batch_id={batch_id}")

    flushed = read_progress(spark, ledger).where(part_of_batch("batch_id", batch_id)).drop("batch_id")
    end = F.when(F.col("status") == "COMPLETED", "COMPLETE").otherwise("FAIL")
    append_log(
        spark, home,
        _events(claimed, F.lit("CLAIM"), batch_id * _STEPS)
        .unionByName(_events(flushed, F.lit("FLUSH"), batch_id * _STEPS + 1))
        .unionByName(_events(reported, F.lit("ATTACH"), batch_id * _STEPS + 2))
        .unionByName(_events(ended.withColumn("end", end), F.col("end"), batch_id * _STEPS + 3)),
        batch_id,
    )


def start_import(
    spark: SparkSession, home: ImportHome, files_per_batch: int = 3, available_now: bool = False,
    messages: DataFrame | None = None, line_sep: str = "\n",
):
    """Start the import stream; progress is kept in ``checkpoint``.

    ``messages`` is any stream of ``jobId``, ``message_topic`` for one; without it the files in
    ``messages`` are read.  ``line_sep`` is "\\r" for files of bare CR line ends.  A new checkpoint
    counts batches from 0 again, which would take the place of earlier ones, so it is refused
    where the log holds any.
    """
    fs, checkpoint = file_system(spark, home.folder("checkpoint"))
    _, logged = file_system(spark, f"{home.folder('log')}/batch_id=[0-9]*")
    if not fs.exists(checkpoint) and len(fs.globStatus(logged) or []):
        raise ValueError("the log holds batches of another checkpoint")
    stream = message_files(spark, home.folder("messages"), files_per_batch) if messages is None else messages
    writer = stream.writeStream.option("checkpointLocation", home.folder("checkpoint")).foreachBatch(
        lambda batch, batch_id: process_messages(batch, batch_id, home, line_sep)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def start_retries(
    spark: SparkSession, home: ImportHome, max_attempts: int = MAX_ATTEMPTS, initial_s: float = RETRY_INITIAL_S,
    longest_s: float = RETRY_MAX_S, every: str = "1 second",
):
    """Start the stream from failed attempts to new messages and dead letters; see ``stream_retries``."""
    fs, folder = file_system(spark, home.folder("attempts"))
    fs.mkdirs(folder)
    attempts = spark.readStream.schema(ATTEMPT).json(home.folder("attempts"))

    def decide(batch: DataFrame, number: int) -> None:
        held = freeze(batch)
        dead = held.where("decision = 'DEAD'").select("jobId")
        dead.write.mode("overwrite").json(f"{home.folder('dead_letters')}/batch_id={_LATER + number}")
        publish(held.where("decision = 'RETRY'"), home.folder("messages"))     # at least once, as any message

    return (
        stream_retries(attempts, max_attempts, initial_s, longest_s).writeStream.outputMode("update")
        .option("checkpointLocation", home.folder("checkpoint_retries"))
        .trigger(processingTime=every).foreachBatch(decide).start()
    )


def start_dead_letters(spark: SparkSession, home: ImportHome, available_now: bool = False):
    """Start the stream that fails the jobs of dead letters, unless they are done by then."""
    fs, folder = file_system(spark, home.folder("dead_letters"))
    fs.mkdirs(folder)
    letters = spark.readStream.schema("jobId string, batch_id bigint").json(home.folder("dead_letters"))

    def fail(batch: DataFrame, number: int) -> None:
        dead = batch.select(F.col("jobId").alias("job_id")).distinct()
        append_log(spark, home, _events(dead, F.lit("FAIL"), _LATER + number), _LATER + number)

    writer = letters.writeStream.option("checkpointLocation", home.folder("checkpoint_dead_letters")).foreachBatch(fail)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
