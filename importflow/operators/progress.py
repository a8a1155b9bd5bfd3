"""Counters derived from outcomes, and the checks that hold between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from importflow.functions import report_key


def records_per_job(records: DataFrame, jobs: DataFrame) -> DataFrame:
    """Imported records of every job, 0 for jobs that have none."""
    counts = records.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        jobs.select(F.col("id").alias("job_id")).join(counts, "job_id", "left")
        .select("job_id", F.coalesce("n", F.lit(0)).alias("records"))
    )


def job_progress(progress: DataFrame, jobs: DataFrame) -> DataFrame:
    """Counters, cursor, total and report key of every job.

    ``progress`` has ``job_id, valid_rows, invalid_rows, last_row``, any number of rows per
    job; ``jobs`` has ``id, status, source_object_key``.
    """
    counts = progress.groupBy("job_id").agg(
        F.sum("valid_rows").alias("valid_rows"),
        F.sum("invalid_rows").alias("invalid_rows"),
        F.max("last_row").alias("last_row"),
    )
    counted = jobs.select("id", "status", "source_object_key").join(
        counts, F.col("id") == F.col("job_id"), "left"
    )
    zero = F.lit(0).cast("bigint")
    return counted.select(
        F.col("id").alias("job_id"), "status",
        F.coalesce("valid_rows", zero).alias("processed_rows"),
        F.coalesce("invalid_rows", zero).alias("failed_rows"),
        F.coalesce("last_row", zero).alias("last_processed_row"),
        "source_object_key",
    ).select(
        "job_id", "status", "processed_rows", "failed_rows", "last_processed_row",
        completion_total().alias("total_rows"),
        attached_report().alias("error_report_object_key"),
    )


def completion_total() -> Column:
    return F.when(F.col("status") == "COMPLETED", F.col("processed_rows") + F.col("failed_rows"))


def attached_report() -> Column:
    """The report's key, set if and only if the job has an error row."""
    return F.when(F.col("failed_rows") > 0, report_key("source_object_key"))


def reconcile(records: DataFrame, errors: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs whose tables and counters disagree; no rows means all is well.

    ``jobs`` has ``id, processed_rows, failed_rows``.
    """
    key = ["job_id", "source_row_number"]
    both = records.select(*key, F.lit(1).alias("r"), F.lit(0).alias("e")).unionByName(
        errors.select(*key, F.lit(0).alias("r"), F.lit(1).alias("e"))
    )
    per_row = both.groupBy(*key).agg(F.sum("r").alias("r"), F.sum("e").alias("e"))
    found = per_row.groupBy("job_id").agg(
        F.sum("r").alias("imported_rows"), F.sum("e").alias("error_rows"),
        F.count_if((F.col("r") > 0) & (F.col("e") > 0)).alias("rows_in_both"),
    )
    told = jobs.select(F.col("id").alias("job_id"), "processed_rows", "failed_rows")
    joined = told.join(found, "job_id", "full").select(
        "job_id",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in
          ("processed_rows", "imported_rows", "failed_rows", "error_rows", "rows_in_both")],
    )
    return joined.where(
        (F.col("processed_rows") != F.col("imported_rows"))
        | (F.col("failed_rows") != F.col("error_rows"))
        | (F.col("rows_in_both") > 0)
    )
