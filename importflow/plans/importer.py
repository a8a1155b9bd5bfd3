"""The import itself: contact files in, one committed ledger batch out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from importflow.operators.ledger import (
    batch_counts, commit_batch, cursors, file_system, read_progress, require_rows, to_outcomes,
)
from importflow.operators.flushes import last_flush
from importflow.operators.skew import checked_broadcast
from importflow.operators.validate import pick_fields, too_long, validate
from importflow.session import freeze, scratch_path
from importflow.sources.csv_files import ContactFiles, read_contact_files

_CHUNK_BATCHES = 1 << 36     # chunk numbers of a batch; ids below belong to batches without chunks


def part_id(batch_id: int, number: int) -> int:
    """The ledger batch of part ``number`` of a batch; part 0 is the batch itself."""
    if number >= _CHUNK_BATCHES or not 0 <= batch_id < (1 << 63) // _CHUNK_BATCHES - 1:
        raise ValueError(f"batch {batch_id}, part {number}: beyond the ids of parts")
    return (batch_id + 1) * _CHUNK_BATCHES + number if number else batch_id


def part_of_batch(column: str, batch_id: int) -> Column:
    first = (batch_id + 1) * _CHUNK_BATCHES
    return (F.col(column) == batch_id) | F.col(column).between(first + 1, first + _CHUNK_BATCHES - 1)


def validate_files(
    spark: SparkSession, paths, assign: Callable[[DataFrame], DataFrame],
    job_cursors: DataFrame | None = None, line_sep: str = "\n",
) -> tuple[DataFrame, DataFrame]:
    """(validated rows to commit, files with the failure that stops them, if any).

    ``assign`` adds ``job_id`` to the table of files.  A file fails at its first record that
    is no CSV, or that is valid but too long for the record table; of such a file only what
    a row-by-row importer commits before the failure is kept.
    """
    def describe(files: DataFrame) -> DataFrame:
        named = assign(files)
        if job_cursors is None:
            return named.withColumn("cursor", F.lit(0).cast("bigint"))
        return named.join(job_cursors.select("job_id", "cursor"), "job_id", "left").withColumn(
            "cursor", F.coalesce("cursor", F.lit(0))
        )

    found: ContactFiles = read_contact_files(spark, paths, describe, line_sep)

    def checked(read: DataFrame) -> DataFrame:
        return validate(pick_fields(read)).where(F.col("source_row_number") > F.col("cursor"))

    rows, files = checked(found.rows), found.files
    # Only a file with a line longer than the shortest limit can hold an over-long value.
    if found.any_suspect:
        # An aggregate, not a filter: a filter would be pushed down to the scan and validate
        # every row once per use of every field.
        over = checked(found.rows_of(files.where("suspect"))).groupBy("file_path").agg(
            F.min(F.when(too_long(), F.col("source_row_number"))).alias("long_row")
        )
        first = F.least("failed_row", "long_row")
        files = freeze(
            files.join(over, "file_path", "left").withColumn("first", first)
            .withColumn("failed_why", F.when(F.col("long_row") == F.col("first"), "value too long")
                        .otherwise(F.col("failed_why")))
            .withColumn("failed_row", F.col("first")).drop("long_row", "first")
        )
    told = files.agg(
        F.count(F.lit(1)).alias("files"), F.count_distinct("job_id").alias("jobs"),
        F.count("failed_row").alias("failed"),
    ).first()
    if told["files"] != told["jobs"]:
        raise ValueError("a job has more than one source file, or a file has no job")
    files = files.withColumn("kept_to", F.lit(None).cast("bigint"))
    if told["failed"]:
        # Of a file that fails, the commits before the failure are kept.
        failing = files.where("failed_row is not null").select("file_path", "failed_row")
        before = checked(found.rows_of(failing)).join(checked_broadcast(failing), "file_path").where(
            F.col("source_row_number") < F.col("failed_row")
        )
        files = files.drop("kept_to").join(last_flush(before, "file_path"), "file_path", "left")
        kept = F.when(F.col("failed_row").isNotNull(), F.coalesce("flushed_to", "cursor"))
        files = freeze(files.withColumn("kept_to", kept).drop("flushed_to"))
        stopped = files.where("kept_to is not null").select("file_path", "kept_to")
        rows = rows.join(checked_broadcast(stopped), "file_path", "left").where(
            F.col("kept_to").isNull() | (F.col("source_row_number") <= F.col("kept_to"))
        )
    expected = F.greatest(F.coalesce("kept_to", "data_rows") - F.col("cursor"), F.lit(0))
    files = files.withColumn("expected_rows", expected)
    return rows, files


def import_files(
    spark: SparkSession, ledger: str, paths, assign: Callable[[DataFrame], DataFrame],
    batch_id: int, chunk_rows: int | None = None, line_sep: str = "\n",
) -> DataFrame:
    """Import files as one batch; returns ``job_id, status, failed_row, failed_why``.

    Rows up to a job's committed cursor are skipped, so rows that are left are new by their
    number: the commit needs neither a shuffle nor a look at the ledger.  Running the same
    batch again gives the same ledger.

    With ``chunk_rows`` the validated rows are staged and committed as row ranges one after
    the other, each visible as soon as it is committed; a repeated run goes on after the
    last committed range.
    """
    replayed = batch_id if chunk_rows is None else None
    job_cursors = cursors(read_progress(spark, ledger, without=replayed))
    rows, files = validate_files(spark, paths, assign, job_cursors, line_sep)
    outcomes = to_outcomes(rows)
    if chunk_rows is None:
        commit_batch(spark, ledger, outcomes, batch_id, files.select("job_id", "expected_rows"))
    else:
        staged = scratch_path(spark, "chunks")
        chunk = F.floor((F.col("source_row_number") - 1) / chunk_rows)
        staging = outcomes.withColumn("chunk", chunk)
        staging.write.partitionBy("chunk").parquet(staged)
        stage = spark.read.schema(staging.schema).parquet(staged)
        require_rows(batch_counts(stage), files.select("job_id", "expected_rows"))
        last = stage.agg(F.max("chunk")).first()[0] or 0
        if last >= _CHUNK_BATCHES or not 0 <= batch_id < (1 << 63) // _CHUNK_BATCHES - 1:
            raise ValueError(f"batch {batch_id}, chunk {last}: beyond the ids of chunks")
        for r in stage.select("chunk").distinct().orderBy("chunk").collect():
            part = stage.where(F.col("chunk") == r["chunk"]).drop("chunk")
            commit_batch(spark, ledger, part, (batch_id + 1) * _CHUNK_BATCHES + r["chunk"])
        fs, folder = file_system(spark, staged)
        fs.delete(folder, True)
    failed = F.col("failed_row").isNotNull()
    return files.select(
        "job_id", F.when(failed, "FAILED").otherwise("COMPLETED").alias("status"),
        "failed_row", "failed_why",
    )
