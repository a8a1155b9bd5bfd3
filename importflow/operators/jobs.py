"""Tenant-scoped queries over the job, user and organisation tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from importflow.functions import default_to, email_matches, page_count, source_key
from importflow.operators.ordered import rows_between
from importflow.schemas import JOB_DEFAULTS, MAX_PAGE_SIZE, PAGE_SIZE, TERMINAL_STATUSES

TOP_ROWS = 10_000     # pages ending beyond this are found by counts of ranges

PUBLIC_COLUMNS = [
    "id", "status", "job_type", "total_rows", "processed_rows", "failed_rows",
    "created_at", "updated_at",
]


def tenant_scope(df: DataFrame, org_id) -> DataFrame:
    """Every read goes through this; another tenant's row is simply not there."""
    return df.where(F.col("org_id") == F.lit(org_id))


def with_status(df: DataFrame, status: str | None) -> DataFrame:
    return df if status is None else df.where(F.col("status") == status)


def find_job(jobs: DataFrame, job_id, org_id) -> DataFrame:
    return tenant_scope(jobs, org_id).where(F.col("id") == F.lit(job_id))


def find_user(users: DataFrame, email: str) -> DataFrame:
    return users.where(email_matches("email", email))


def public_view(jobs: DataFrame) -> DataFrame:
    return jobs.select(*PUBLIC_COLUMNS)


def is_terminal(status="status") -> Column:
    return F.col(status).isin(TERMINAL_STATUSES)


# --- paging --------------------------------------------------------------------------


@dataclass(frozen=True)
class Page:
    page: int = 0
    size: int = PAGE_SIZE

    @classmethod
    def of(cls, page: int = 0, size: int = PAGE_SIZE) -> "Page":
        return cls(max(page, 0), min(max(size, 1), MAX_PAGE_SIZE))


def list_jobs(
    jobs: DataFrame, org_id, page: int = 0, size: int = PAGE_SIZE, status: str | None = None,
    top_rows: int | None = None,
) -> DataFrame:
    """One page, newest first, ties by id.

    Early pages are a top-k.  A deep page would pull all rows before it into one task, so
    there counts of ranges say which range holds it, and only that one is sorted.
    """
    wanted = Page.of(page, size)
    first = wanted.page * wanted.size
    found = with_status(tenant_scope(jobs, org_id), status)
    most = TOP_ROWS if top_rows is None else top_rows
    if first + wanted.size > most:
        found, first = rows_between(found, ["created_at", "id"], first, wanted.size, most)
    return found.orderBy(F.col("created_at").desc(), F.col("id").desc()).offset(first).limit(wanted.size)


def page_summary(
    jobs: DataFrame, org_id, page: int = 0, size: int = PAGE_SIZE, status: str | None = None
) -> DataFrame:
    """(page, size, total_elements, total_pages) under the same filter as the page."""
    wanted = Page.of(page, size)
    found = with_status(tenant_scope(jobs, org_id), status)
    return found.agg(F.count(F.lit(1)).alias("total_elements")).select(
        F.lit(wanted.page).alias("page"), F.lit(wanted.size).alias("size"), "total_elements",
        page_count("total_elements", F.lit(wanted.size)).alias("total_pages"),
    )


# --- results and uploads -------------------------------------------------------------


def result_outcome(jobs: DataFrame) -> DataFrame:
    """Per job: the report's key, or the code that says why there is none.

    A job that is unknown or another tenant's has no row (JOB_NOT_FOUND).
    """
    status, key = F.col("status"), F.col("error_report_object_key")
    code = (
        F.when(status == "FAILED", "JOB_FAILED")
        .when(status != "COMPLETED", "RESULT_NOT_READY")
        .when(key.isNull(), "NO_ERROR_REPORT")
        .otherwise("REPORT")
    )
    return jobs.select(
        "id", "org_id", code.alias("result"), F.when(code == "REPORT", key).alias("report_key")
    )


def admit_uploads(jobs: DataFrame, uploads: DataFrame) -> DataFrame:
    """Decide upload confirmations; ``uploads`` is (object_key, length), one row per object."""
    found = jobs.join(uploads, F.col("source_object_key") == F.col("object_key"), "left")
    status = F.col("status")
    outcome = (
        F.when(status == "QUEUED", "UNCHANGED")
        .when(status != "PENDING", "INVALID_JOB_STATE")
        .when(F.coalesce("length", F.lit(0)) <= 0, "UPLOAD_NOT_FOUND")
        .otherwise("QUEUED")
    )
    return found.select(
        "id", "org_id", "status", outcome.alias("outcome"),
        F.when(outcome == "QUEUED", "QUEUED").otherwise(status).alias("status_after"),
    )


def create_jobs(requests: DataFrame, upload_id: Column | None = None, now: Column | None = None) -> DataFrame:
    """One pending job per request row (``id`` if given, ``org_id``, ``submitted_by``).

    Ids and keys are drawn anew whenever the result is evaluated: write it before use.
    """
    now = F.current_timestamp() if now is None else now
    job_id = F.col("id").cast("string") if "id" in requests.columns else F.uuid()
    text = lambda: F.lit(None).cast("string")
    return requests.select(
        job_id.alias("id"), F.col("org_id").cast("string").alias("org_id"),
        F.col("submitted_by").cast("string").alias("submitted_by"),
        F.lit(JOB_DEFAULTS["job_type"]).alias("job_type"),
        F.lit(JOB_DEFAULTS["status"]).alias("status"),
        source_key(F.col("org_id").cast("string"), upload_id).alias("source_object_key"),
        text().alias("result_object_key"), text().alias("error_report_object_key"),
        F.lit(None).cast("bigint").alias("total_rows"),
        F.lit(JOB_DEFAULTS["processed_rows"]).cast("bigint").alias("processed_rows"),
        F.lit(JOB_DEFAULTS["failed_rows"]).cast("bigint").alias("failed_rows"),
        F.lit(JOB_DEFAULTS["last_processed_row"]).cast("bigint").alias("last_processed_row"),
        F.lit(JOB_DEFAULTS["retry_count"]).alias("retry_count"),
        F.lit(JOB_DEFAULTS["version"]).cast("bigint").alias("version"),
        now.alias("created_at"), now.alias("updated_at"),
    )


def fill_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Column defaults for the columns ``df`` has."""
    return df.withColumns({c: default_to(c, v) for c, v in defaults.items() if c in df.columns})
