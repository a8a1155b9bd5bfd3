"""Contacts, jobs and logs in the engine's shapes, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from importflow.operators.ordered import number_rows
from importflow.operators.report import csv_field
from importflow.schemas import CONTACT_FIELDS
from importflow.session import scratch_path
from importflow.sources.uploads import put_lines

FILE_ROWS = 1_000_000     # a nation with more customers uploads several files


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def contacts(spark: SparkSession, folder: str, fancy: bool = False) -> DataFrame:
    """Contact rows as uploaded: one job per nation and million customers.

    ``fancy`` puts commas, quotes and line ends into some first names.
    """
    numbered = number_rows(
        table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey"),
        ["c_nationkey"], ["c_custkey"], "n",
    )
    key, name = F.col("c_custkey"), F.col("c_name")
    email = F.concat(F.lower(F.replace(name, F.lit("#"), F.lit("."))), F.lit("@example.com"))
    plain = F.lit("Customer")
    first = plain if not fancy else (
        F.when(key % 10 == 3, 'Cust, "the" one').when(key % 50 == 9, "Two\nlines, \"quoted\"\n\n")
        .when(key % 50 == 19, 'five" pipe').otherwise(plain)
    )
    return numbered.select(
        F.concat(F.col("c_nationkey").cast("string"), F.lit("-"),
                 F.floor((F.col("n") - 1) / FILE_ROWS).cast("string")).alias("job_id"),
        ((F.col("n") - 1) % FILE_ROWS + 1).alias("source_row_number"),
        F.when(key % 11 == 0, "").when(key % 11 == 1, "not-an-email")
        .when(key % 11 == 2, F.concat(F.lit("  "), email, F.lit("  "))).otherwise(email)
        .alias("email"),
        F.when(key % 7 == 0, "   ").otherwise(first).alias("first_name"),
        F.when(key % 13 == 0, F.lit(None)).otherwise(F.substring(name, 10, 1 << 30)).alias("last_name"),
        F.when(key % 17 == 0, "call me").when(key % 5 == 0, F.lit(None))
        .otherwise(F.concat(F.lit("+1-555-"), F.lpad((key % 10000).cast("string"), 4, "0")))
        .alias("phone"),
        "c_custkey", "c_nationkey",
    )


def csv_line(columns: list[str]) -> Column:
    return F.concat_ws(",", *[F.coalesce(csv_field(c), F.lit("")) for c in columns])


def upload_lines(
    spark: SparkSession, lines: DataFrame, header: Column | None = None
) -> str:
    """Write ``job_id, source_row_number, line`` rows as one CSV file per job; returns the folder.

    ``header`` is an expression over a file's first row; a file holds at most FILE_ROWS rows.
    """
    header = F.lit(",".join(CONTACT_FIELDS)) if header is None else header
    headers = lines.where("source_row_number = 1").select(
        "job_id", F.lit(0).cast("bigint").alias("source_row_number"), header.alias("line")
    )
    root = scratch_path(spark, "uploads")
    put_lines(
        lines.select("job_id", "source_row_number", "line").unionByName(headers),
        root, ["job_id"], ["source_row_number"],
    )
    return root


def upload_contacts(spark: SparkSession, folder: str, fancy: bool = False) -> str:
    rows = contacts(spark, folder, fancy)
    return upload_lines(spark, rows.withColumn("line", csv_line(CONTACT_FIELDS)))


def job_of_folder(files: DataFrame) -> DataFrame:
    """Job id of files that lie in ``job_id=<id>`` folders."""
    return files.withColumn("job_id", F.regexp_extract("file_path", "/job_id=([^/]+)/", 1))


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """A job table from the orders."""
    key = F.col("o_orderkey")
    status = (
        F.when(key % 10 == 0, "FAILED").when(key % 10 == 1, "PENDING")
        .when(F.col("o_orderstatus") == "F", "COMPLETED")
        .when(F.col("o_orderstatus") == "O", "QUEUED").otherwise("PROCESSING")
    )
    org = F.col("o_custkey") % 5
    stem = F.concat(org.cast("string"), F.lit("/"), key.cast("string"), F.lit("/"))
    done = status == "COMPLETED"
    return table(spark, folder, "orders").select(
        key.cast("string").alias("id"), org.alias("org_id"),
        F.col("o_custkey").cast("string").alias("submitted_by"),
        F.lit("CSV_IMPORT").alias("job_type"), status.alias("status"),
        F.concat(stem, F.lit("source.csv")).alias("source_object_key"),
        F.when(key % 3 != 0, F.concat(stem, F.lit("errors.csv"))).alias("error_report_object_key"),
        F.when(done, key % 100).alias("total_rows"),
        F.when(done, key % 100 - key % 7 % (key % 100 + 1)).otherwise(F.lit(0)).alias("processed_rows"),
        F.when(done, key % 7 % (key % 100 + 1)).otherwise(F.lit(0)).alias("failed_rows"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"),
    )


def transition_log(spark: SparkSession, folder: str) -> DataFrame:
    return log_of(table(spark, folder, "events"))


def log_of(events: DataFrame) -> DataFrame:
    """A job per user and day; event types stand for transitions."""
    kind, number = F.col("event_type"), F.col("event_id")
    event = (
        F.when(kind == "signup", "CONFIRM").when(kind == "click", "CLAIM")
        .when((kind == "view") & (number % 7 == 0), "ATTACH").when(kind == "view", "FLUSH")
        .when(kind == "purchase", "COMPLETE").otherwise("FAIL")
    )
    return events.select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"),
                 F.col("ts").cast("date").cast("string")).alias("job_id"),
        "ts", "event_id", event.alias("event"),
        (number % 4 != 0).alias("upload_present"), (number % 5).alias("valid_rows"),
        (number % 3).alias("invalid_rows"), number.alias("last_row"),
    )


def calls(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "user_id", "ts", "event_id", (F.col("event_type") == "error").alias("failed")
    )
