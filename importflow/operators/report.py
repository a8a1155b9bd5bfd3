"""Error reports: the error rows of each job in row order, as CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from importflow.operators.skew import checked_broadcast
from importflow.sources.uploads import object_lines, put_objects

# --- fixed values -----------------------------------------------------------------
HEADER = "row_number,error"
LINE_END = "\r\n"
# ----------------------------------------------------------------------------------


def errors_in_order(errors: DataFrame, job_id: str) -> DataFrame:
    return (
        errors.where(F.col("job_id") == job_id).select("source_row_number", "reason")
        .orderBy("source_row_number")
    )


def csv_field(c: str) -> Column:
    """Quoted only if it has to be, inner quotes doubled."""
    value = F.col(c)
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.rlike(r'[",\r\n]'), quoted).otherwise(value)


def report_lines(errors: DataFrame) -> DataFrame:
    """(job_id, source_row_number, line); the header is line 0.  Jobs without an error have no lines."""
    lines = errors.select(
        "job_id", "source_row_number",
        F.concat(F.col("source_row_number").cast("string"), F.lit(","), csv_field("reason"))
        .alias("line"),
    )
    headers = errors.select("job_id").distinct().select(
        "job_id", F.lit(0).cast("bigint").alias("source_row_number"), F.lit(HEADER).alias("line"),
    )
    return lines.unionByName(headers)


def write_reports(errors: DataFrame, keys: DataFrame, root: str) -> int:
    """Put the report of each job with errors at its key below ``root``; returns how many.

    ``keys`` is ``job_id, error_report_object_key``.  A job without an error has no object; a report
    of any length passes through its task as a stream.
    """
    named = keys.select("job_id", "error_report_object_key")
    lines = report_lines(errors).join(checked_broadcast(named), "job_id")
    return put_objects(lines, root, "error_report_object_key", "source_row_number", LINE_END)


def read_reports(spark: SparkSession, root: str, pattern: str = "*/*/errors.csv") -> DataFrame:
    """(error_report_object_key, line) of the stored reports, the header among them."""
    return object_lines(spark, root, pattern, LINE_END).withColumnRenamed("object_key", "error_report_object_key")
