"""The ledger: one row per source row, written once, from which everything else is derived.

Layout below the ledger's root: ``rows/batch_id=n/attempt=k`` holds outcomes, the same folder
below ``progress`` the per-job counts of the same attempt.  The progress folder is written last;
its success marker is what commits the batch, so readers see records, errors and cursor together
or not at all.  A replay is a further attempt: readers see the one before until its marker is
there, and that one's files stay until the next replay for readers that have begun with them.

A batch with a negative number -n is a compaction: it stands for all batches below n.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from importflow.operators.skew import filter_by_keys, spread_join
from importflow.functions.scalar import row_id
from importflow.schemas import IMPORT_ERRORS, IMPORTED_RECORDS, LEDGER, STORED_LEDGER
from importflow.session import freeze

KEY = ["job_id", "source_row_number"]


# --- insert if absent ----------------------------------------------------------------


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key by ``order``, then by the other columns.

    A minimum is combined before the shuffle, so any number of copies of one key is fine,
    which a window over the key would not be.
    """
    rest = order + [c for c in rows.columns if c not in keys and c not in order]
    if not rest:
        return rows.distinct()
    first = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("first"))
    return first.select(*keys, "first.*").select(*rows.columns)


def insert_if_absent(
    new: DataFrame, existing: DataFrame, keys: list[str], order: list[str]
) -> DataFrame:
    """Rows of ``new`` to add: one per key, none whose key is there already.

    Where the key names a job, only the jobs in ``new`` are looked up.
    """
    if "job_id" in keys:
        existing = filter_by_keys(existing, new, "job_id", keys, keep=True)
    return first_per_key(new, keys, order).join(
        existing.select(*keys).distinct(), keys, "left_anti"
    )


# --- storage -------------------------------------------------------------------------


def file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def _batch_folder(root: str, kind: str, batch_id: int) -> str:
    return f"{root}/{kind}/batch_id={batch_id}"


def _attempt_folder(root: str, kind: str, batch_id: int, attempt: int) -> str:
    return f"{_batch_folder(root, kind, batch_id)}/attempt={attempt}"


def _number(path) -> int:
    return int(path.getName().split("=")[1])


def _committed(spark: SparkSession, root: str) -> dict[int, int]:
    """The attempt that counts, the last one with a marker, of each batch."""
    fs, pattern = file_system(spark, f"{root}/progress/batch_id=*/attempt=*/_SUCCESS")
    last: dict[int, int] = {}
    for found in fs.globStatus(pattern) or []:
        attempt = found.getPath().getParent()
        batch = _number(attempt.getParent())
        last[batch] = max(_number(attempt), last.get(batch, 0))
    covered = max((-b for b in last if b < 0), default=0)
    return {b: last[b] for b in sorted(last) if b >= covered or b == -covered}


def committed_batches(spark: SparkSession, root: str) -> list[int]:
    return list(_committed(spark, root))


def _read(
    spark: SparkSession, root: str, kind: str, schema, without: int | None, only: list[int] | None = None
) -> DataFrame:
    folders = [_attempt_folder(root, kind, b, a) for b, a in _committed(spark, root).items()
               if b != without and (only is None or b in only)]
    if not folders:
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema).option("basePath", f"{root}/{kind}").parquet(*folders)
    return found.drop("attempt")


PROGRESS_SCHEMA = (
    "job_id string, valid_rows bigint, invalid_rows bigint, last_row bigint, batch_id bigint"
)


def read_ledger(
    spark: SparkSession, root: str, without: int | None = None, only: list[int] | None = None,
    times: bool = False,
) -> DataFrame:
    """Committed outcomes; ``without`` a batch that is about to be replayed, or ``only`` some.
    With ``times`` also ``created_at``, when the row was first written by a commit."""
    return _read(spark, root, "rows", STORED_LEDGER if times else LEDGER, without, only)


def outcomes_of(spark: SparkSession, root: str, jobs: DataFrame) -> DataFrame:
    """Committed outcomes of some jobs (``job_id``), from just the batches that hold any."""
    held = filter_by_keys(
        read_progress(spark, root), jobs, "job_id", ["batch_id"], keep=True
    ).select("batch_id").distinct().collect()     # one row per batch
    found = read_ledger(spark, root, only=[r["batch_id"] for r in held])
    return filter_by_keys(found, jobs, "job_id", ["source_row_number"], keep=True)


def read_progress(spark: SparkSession, root: str, without: int | None = None) -> DataFrame:
    """Committed counts per job and batch; far smaller than the ledger."""
    return _read(spark, root, "progress", PROGRESS_SCHEMA, without)


def batch_counts(rows: DataFrame) -> DataFrame:
    """Per job: valid and invalid rows and the highest row number."""
    valid = F.col("outcome") == "VALID"
    return rows.groupBy("job_id").agg(
        F.count_if(valid).alias("valid_rows"),
        F.count_if(~valid).alias("invalid_rows"),
        F.max("source_row_number").alias("last_row"),
    )


def require_rows(counts: DataFrame, expected: DataFrame) -> None:
    """Stop if a job has not just as many rows as ``expected`` (``job_id, expected_rows``)."""
    found = expected.join(counts, "job_id", "left").withColumn(
        "found_rows", F.coalesce(F.col("valid_rows") + F.col("invalid_rows"), F.lit(0))
    )
    wrong = found.where(F.col("found_rows") != F.col("expected_rows")).take(1)
    if wrong:
        raise RuntimeError(
            f"job {wrong[0]['job_id']}: {wrong[0]['found_rows']} rows written, "
            f"{wrong[0]['expected_rows']} expected; batch not committed"
        )


def commit_batch(
    spark: SparkSession, root: str, rows: DataFrame, batch_id: int, expected: DataFrame | None = None
) -> None:
    """Write one batch; running it again for the same batch leaves the same ledger.

    With ``expected`` the batch is committed only if every job's rows are all there; else
    what an earlier attempt committed stays.
    """
    fs, folder = file_system(spark, _batch_folder(root, "rows", batch_id))
    made = [_number(s.getPath()) for s in fs.listStatus(folder)] if fs.exists(folder) else []
    held, attempt = _committed(spark, root).get(batch_id), max(made, default=0) + 1
    if "created_at" not in rows.columns:
        rows = rows.withColumn("created_at", F.current_timestamp())
    columns = [f.name for f in STORED_LEDGER.fields if f.name != "batch_id"]
    target = _attempt_folder(root, "rows", batch_id, attempt)
    rows.select(*columns).write.parquet(target)
    counts = freeze(batch_counts(spark.read.schema(LEDGER).parquet(target)))
    if expected is not None:
        require_rows(counts, expected)
    counts.write.parquet(_attempt_folder(root, "progress", batch_id, attempt))
    for old in made:
        if old != held:
            for kind in ("progress", "rows"):
                fs, folder = file_system(spark, _attempt_folder(root, kind, batch_id, old))
                fs.delete(folder, True)


def compact(spark: SparkSession, root: str, below: int) -> None:
    """Put the batches below ``below`` together as one, sorted so that job filters skip files.

    Readers see the old batches until the new marker is there, and only the new one from
    then on, whether or not the old folders are gone yet.  The latest batch may be replayed
    and must stay out of it.
    """
    batches = [b for b in committed_batches(spark, root) if b < below]
    if len(batches) < 2:
        return
    rows = read_ledger(spark, root, only=batches, times=True)
    expected = read_progress(spark, root).where(F.col("batch_id") < below).groupBy("job_id").agg(
        F.sum(F.col("valid_rows") + F.col("invalid_rows")).alias("expected_rows")
    )
    laid = rows.repartitionByRange(*KEY).sortWithinPartitions(*KEY)
    commit_batch(spark, root, laid, -below, expected)
    for batch in batches:
        for kind in ("progress", "rows"):
            fs, folder = file_system(spark, _batch_folder(root, kind, batch))
            fs.delete(folder, True)


def to_outcomes(validated: DataFrame) -> DataFrame:
    """Ledger columns; an error row keeps its reason only."""
    kept = F.col("outcome") == "VALID"
    return validated.select(
        *KEY, "outcome",
        *[F.when(kept, F.col(f)).alias(f)
          for f in ("email", "first_name", "last_name", "phone", "row_hash")],
        "reason",
    )


def imported_records(ledger: DataFrame) -> DataFrame:
    return ledger.where("outcome = 'VALID'").select(
        *KEY, "email", "first_name", "last_name", "phone", "row_hash"
    )


def import_errors(ledger: DataFrame) -> DataFrame:
    return ledger.where("outcome = 'INVALID'").select(*KEY, "reason")


def record_table(ledger: DataFrame) -> DataFrame:
    """The records as declared, with ids and times; ``ledger`` was read with ``times``."""
    rows = ledger.where("outcome = 'VALID'").withColumn("id", row_id("record"))
    return rows.select(*IMPORTED_RECORDS.fieldNames())


def error_table(ledger: DataFrame) -> DataFrame:
    """The errors as declared, with ids and times; ``ledger`` was read with ``times``."""
    rows = ledger.where("outcome = 'INVALID'").withColumn("id", row_id("error"))
    return rows.select(*IMPORT_ERRORS.fieldNames())


# --- resume --------------------------------------------------------------------------


def cursors(progress: DataFrame) -> DataFrame:
    """Highest committed row number per job."""
    return progress.groupBy("job_id").agg(F.max("last_row").alias("cursor"))


def after_cursor(rows: DataFrame, job_cursors: DataFrame, piece: int | None = None) -> DataFrame:
    """Rows beyond their job's cursor; a job without one starts at its first row.

    The importer puts the cursor on its file table instead and needs no join; this is the
    same filter for rows of any origin, safe for a job of any size.
    """
    sizes = rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("__rows"))
    known = sizes.join(job_cursors.select("job_id", "cursor"), "job_id", "left")
    joined = spread_join(rows, known, "job_id", "__rows", ["source_row_number"], "left", piece)
    return joined.where(F.col("source_row_number") > F.coalesce("cursor", F.lit(0))).drop("cursor")


def delete_jobs(rows: DataFrame, deleted: DataFrame, **limits) -> DataFrame:
    """What is left of a child table when jobs go and take their rows along."""
    return filter_by_keys(rows, deleted, "job_id", ["source_row_number"], keep=False, **limits)
