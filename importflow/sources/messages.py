"""Streams: job messages (JSON objects naming a job, delivered at least once) and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from importflow.schemas import JOB_MESSAGE

MESSAGES_PER_FILE = 1_000


def message_files(spark: SparkSession, folder: str, files_per_batch: int = 3) -> DataFrame:
    """Stream of messages from JSON files; a batch takes a bounded number of files."""
    return (
        spark.readStream.schema(JOB_MESSAGE).option("maxFilesPerTrigger", files_per_batch)
        .json(folder)
    )


def message_topic(spark: SparkSession, servers: str, topic: str, offsets_per_batch: int = 300) -> DataFrame:
    """The same from Kafka, where its connector is on the class path."""
    records = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic).option("maxOffsetsPerTrigger", offsets_per_batch).load()
    )
    return records.select(F.from_json(F.col("value").cast("string"), JOB_MESSAGE).alias("m")).select("m.*")


def publish(jobs: DataFrame, folder: str) -> None:
    """Append messages for ``jobs`` (``jobId``) to a message folder.

    The size of a file is bounded, and with it what a micro-batch takes at once.
    """
    jobs.select("jobId").write.mode("append").option(
        "maxRecordsPerFile", MESSAGES_PER_FILE
    ).json(folder)


def table_stream(
    spark: SparkSession, folder: str, pattern: str, schema: T.StructType, bytes_per_batch: int = 64 << 20
) -> DataFrame:
    """Stream of the Parquet files in ``folder``; a batch takes a bounded number of bytes."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", pattern)
        .option("maxBytesPerTrigger", bytes_per_batch).parquet(folder)
    )
