"""Job states: the fold over a transition log, the claim gate, retries and the outbox.

A log row is ``job_id, ts, event_id, event`` plus, for CONFIRM, ``upload_present`` and, for
FLUSH, ``valid_rows, invalid_rows, last_row``.  Events are CONFIRM, CLAIM, FLUSH, ATTACH (of
the error report), COMPLETE and FAIL.  Order within a job is (ts, event_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from importflow.functions import backoff_seconds, report_key
from importflow.operators.ordered import Timeline
from importflow.schemas import JOB_STATUSES, MAX_ATTEMPTS

ORDER = ["ts", "event_id"]


def _happened(name: str) -> Column:
    return F.col(name) > 0


def log_decisions(log: DataFrame, limit: int | None = None) -> DataFrame:
    """Per log row: status before and after, and what became of the event.

    COMPLETE and FAIL are never undone (but a failed job may still complete), a claim needs
    an earlier confirmation, and a confirmation counts only on a fresh job.  So the status
    before a row follows from how often each kind of event came before it, and such running
    counts can be had for a job of any size.  ``decision`` is CHANGED, SAME, REJECTED or
    IGNORED.  A flush without rows changes nothing, nor does a second report.
    """
    event = F.col("event")
    log = log.withColumns({
        "confirmed": ((event == "CONFIRM") & F.coalesce("upload_present", F.lit(True))).cast("int"),
        "moved": F.when(
            event == "FLUSH",
            F.coalesce("valid_rows", F.lit(0)) + F.coalesce("invalid_rows", F.lit(0)),
        ).otherwise(0).cast("bigint"),
    })
    once = Timeline.of(log, ["job_id"], ORDER, limit).before(
        confirms=("sum", F.col("confirmed")),
        fails=("sum", (event == "FAIL").cast("int")),
        completes=("sum", (event == "COMPLETE").cast("int")),
        attaches=("sum", (event == "ATTACH").cast("int")),
        moved_before=("sum", F.col("moved")),
    )
    open_job = ~_happened("fails") & ~_happened("completes")
    claimed = ((event == "CLAIM") & _happened("confirms") & open_job).cast("int")
    twice = once.before(
        claims=("sum", claimed),
        last_total=("max", F.when(event == "COMPLETE", F.col("moved_before"))),
    )
    before = (
        F.when(_happened("completes"), "COMPLETED").when(_happened("fails"), "FAILED")
        .when(_happened("claims"), "PROCESSING").when(_happened("confirms"), "QUEUED")
        .otherwise("PENDING")
    )
    rows = twice.table().withColumn("status_before", before)
    was = F.col("status_before")
    decision = (
        F.when(
            event == "CONFIRM",
            F.when((was == "PENDING") & (F.col("confirmed") == 1), "CHANGED")
            .when(was == "QUEUED", "SAME").otherwise("REJECTED"),
        )
        .when(
            event == "CLAIM",
            F.when(was == "QUEUED", "CHANGED").when(was == "PROCESSING", "SAME").otherwise("IGNORED"),
        )
        .when(event == "FLUSH", F.when(F.col("moved") > 0, "CHANGED").otherwise("SAME"))
        .when(event == "ATTACH", F.when(_happened("attaches"), "SAME").otherwise("CHANGED"))
        .when(
            event == "COMPLETE",
            F.when((was == "COMPLETED") & (F.col("last_total") == F.col("moved_before")), "SAME")
            .otherwise("CHANGED"),
        )
        .when(event == "FAIL", F.when(was.isin("COMPLETED", "FAILED"), "SAME").otherwise("CHANGED"))
        .otherwise("IGNORED")
    )
    decided = rows.withColumn("decision", decision)
    changed = F.col("decision") == "CHANGED"
    after = (
        F.when(changed & (event == "CONFIRM"), "QUEUED")
        .when(changed & (event == "CLAIM"), "PROCESSING")
        .when(changed & (event == "COMPLETE"), "COMPLETED")
        .when(changed & (event == "FAIL"), "FAILED")
        .otherwise(was)
    )
    return decided.withColumn("status_after", after).drop(
        "confirmed", "confirms", "fails", "completes", "claims", "attaches", "last_total", "moved"
    )


def job_states(log: DataFrame, limit: int | None = None) -> DataFrame:
    """Final state per job in the log; all its columns combine before the shuffle."""
    rows = log_decisions(log, limit)
    changed = F.col("decision") == "CHANGED"
    flush = F.col("event") == "FLUSH"
    # A status never goes back in this order.
    ranks = ["PENDING", "QUEUED", "PROCESSING", "FAILED", "COMPLETED"]
    assert sorted(ranks) == sorted(JOB_STATUSES)
    rank = F.array_position(F.array(*[F.lit(r) for r in ranks]), F.col("status_after"))
    zero = F.lit(0).cast("bigint")
    folded = rows.groupBy("job_id").agg(
        F.max(rank).alias("rank"),
        F.count_if(changed).alias("version"),
        F.sum(F.when(flush, F.coalesce("valid_rows", zero))).alias("valid_rows"),
        F.sum(F.when(flush, F.coalesce("invalid_rows", zero))).alias("invalid_rows"),
        F.max(F.when(flush, F.struct(*ORDER, "last_row"))).alias("flushed"),
        F.max(F.when(F.col("event") == "COMPLETE", F.col("moved_before"))).alias("total_rows"),
        F.max(F.when(changed, F.col("ts"))).alias("updated_at"),
        F.max(F.col("event") == "ATTACH").alias("report_attached"),
    )
    return folded.select(
        "job_id",
        F.element_at(F.array(*[F.lit(r) for r in ranks]), F.col("rank").cast("int")).alias("status"),
        "version",
        F.coalesce("valid_rows", zero).alias("processed_rows"),
        F.coalesce("invalid_rows", zero).alias("failed_rows"),
        F.coalesce(F.col("flushed.last_row"), zero).alias("last_processed_row"),
        "total_rows", "updated_at", "report_attached",
    )


def current_jobs(jobs: DataFrame, log: DataFrame, limit: int | None = None) -> DataFrame:
    """The job table with the log applied to it; jobs without a log row stay as created."""
    states = job_states(log, limit)
    told = ["status", "version", "processed_rows", "failed_rows", "last_processed_row",
            "total_rows", "updated_at"]
    named = states.select(
        "job_id", "report_attached", *[F.col(c).alias(f"now_{c}") for c in told]
    )
    joined = jobs.join(named, F.col("id") == F.col("job_id"), "left")
    now = {c: F.coalesce(f"now_{c}", c) for c in told}
    now["error_report_object_key"] = F.when(
        F.col("report_attached"), report_key("source_object_key")
    ).otherwise(F.col("error_report_object_key"))
    return joined.select(*[now.get(c, F.col(c)).alias(c) for c in jobs.columns])


def claim_gate(messages: DataFrame, jobs: DataFrame) -> DataFrame:
    """Decide each job named by the messages once, however often it was delivered."""
    named = messages.select(F.col("jobId").alias("job_id")).where("job_id is not null").distinct()
    found = named.join(
        jobs.select("id", "status"), F.col("job_id") == F.col("id"), "left"
    )
    decision = (
        F.when(F.col("id").isNull(), "DISCARD").when(F.col("status") == "QUEUED", "CLAIM")
        .when(F.col("status") == "PROCESSING", "RESUME").otherwise("IGNORE")
    )
    return found.select("job_id", "status", decision.alias("decision"))


def retry_state(attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Per job: failed attempts, whether they are used up, else the wait before the next.

    ``attempts`` is ``job_id, failed``.
    """
    counted = attempts.groupBy("job_id").agg(F.count_if("failed").alias("failures"))
    spent = F.col("failures") >= max_attempts
    return counted.where("failures > 0").select(
        "job_id", "failures", spent.alias("exhausted"),
        F.when(~spent, backoff_seconds("failures")).alias("wait_seconds"),
    )


def dead_letters(attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    return retry_state(attempts, max_attempts).where("exhausted").select("job_id", "failures")


def fail_dead_jobs(jobs: DataFrame, dead: DataFrame) -> DataFrame:
    """Status after the dead letters: FAILED unless COMPLETED; unknown jobs have no row."""
    gone = dead.select("job_id").distinct()
    return jobs.join(gone, F.col("id") == F.col("job_id")).select(
        "job_id", F.col("status").alias("status_before"),
        F.when(F.col("status") == "COMPLETED", "COMPLETED").otherwise("FAILED").alias("status_after"),
    )


def unpublished_jobs(jobs: DataFrame, messages: DataFrame) -> DataFrame:
    """Queued jobs no message was published for: what a recovery has to publish."""
    sent = messages.select(F.col("jobId").alias("id")).distinct()
    queued = jobs.where("status = 'QUEUED'").join(sent, "id", "left_anti")
    return queued.select(F.col("id").alias("jobId"))
