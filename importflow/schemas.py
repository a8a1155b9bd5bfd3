"""Table shapes, value lists, defaults and limits."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, TS = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampType()


def _table(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])


ORGANIZATIONS = _table(("id", S, False), ("name", S, False), ("created_at", TS, False))

USERS = _table(
    ("id", S, False), ("email", S, False), ("password_hash", S, False),
    ("org_id", S, False), ("role", S, False), ("created_at", TS, False),
)

JOBS = _table(
    ("id", S, False), ("org_id", S, False), ("submitted_by", S, False),
    ("job_type", S, False), ("status", S, False), ("source_object_key", S, False),
    ("result_object_key", S, True), ("error_report_object_key", S, True),
    ("total_rows", L, True), ("processed_rows", L, False), ("failed_rows", L, False),
    ("last_processed_row", L, False), ("retry_count", I, False), ("version", L, False),
    ("created_at", TS, False), ("updated_at", TS, False),
)

IMPORTED_RECORDS = _table(
    ("id", S, False), ("job_id", S, False), ("source_row_number", L, False),
    ("email", S, False), ("first_name", S, False), ("last_name", S, False),
    ("phone", S, True), ("row_hash", S, False), ("created_at", TS, False),
)

IMPORT_ERRORS = _table(
    ("id", S, False), ("job_id", S, False), ("source_row_number", L, False),
    ("reason", S, False), ("created_at", TS, False),
)

TABLES = {
    "organizations": ORGANIZATIONS, "users": USERS, "jobs": JOBS,
    "imported_records": IMPORTED_RECORDS, "import_errors": IMPORT_ERRORS,
}

JOB_MESSAGE = _table(("jobId", S, True))

# One row per source row: records and errors are two filters on this table, so one
# write commits both together.
LEDGER = _table(
    ("job_id", S, False), ("source_row_number", L, False), ("outcome", S, False),
    ("email", S, True), ("first_name", S, True), ("last_name", S, True),
    ("phone", S, True), ("row_hash", S, True), ("reason", S, True), ("batch_id", L, True),
)

# As stored: rows also carry the time of the commit that first wrote them.
STORED_LEDGER = _table(*[(f.name, f.dataType, f.nullable) for f in LEDGER.fields], ("created_at", TS, True))

CONTACT_FIELDS = ["email", "first_name", "last_name", "phone"]

# --- fixed values -----------------------------------------------------------------
JOB_STATUSES = ["PENDING", "QUEUED", "PROCESSING", "COMPLETED", "FAILED"]
TERMINAL_STATUSES = ["COMPLETED", "FAILED"]
JOB_TYPES = ["CSV_IMPORT"]
ROLES = ["ADMIN", "ORG_OWNER", "MEMBER"]

RECORD_LENGTHS = {
    "email": 320, "first_name": 255, "last_name": 255, "phone": 50, "row_hash": 64,
}

# Per table: unique keys (an entry in lower() form ignores case), foreign keys, value lists
# and lengths.  What must not be NULL is in the table shapes above.
CONSTRAINTS = {
    "organizations": {"unique": [["id"]], "lengths": {"name": 255}},
    "users": {
        "unique": [["id"], ["lower(email)"]],
        "foreign": {"org_id": "organizations"},
        "domains": {"role": ROLES},
        "lengths": {"email": 255, "password_hash": 255, "role": 32},
    },
    "jobs": {
        "unique": [["id"]],
        "foreign": {"org_id": "organizations", "submitted_by": "users"},
        "domains": {"job_type": JOB_TYPES, "status": JOB_STATUSES},
        "lengths": {
            "job_type": 32, "status": 32, "source_object_key": 1024,
            "result_object_key": 1024, "error_report_object_key": 1024,
        },
    },
    "imported_records": {
        "unique": [["id"], ["job_id", "source_row_number"]],
        "foreign": {"job_id": "jobs"}, "lengths": RECORD_LENGTHS,
    },
    "import_errors": {
        "unique": [["id"], ["job_id", "source_row_number"]], "foreign": {"job_id": "jobs"},
    },
}

JOB_DEFAULTS = {
    "status": "PENDING", "job_type": "CSV_IMPORT", "processed_rows": 0, "failed_rows": 0,
    "last_processed_row": 0, "retry_count": 0, "version": 0,
}

COMMIT_ROWS = 500
PAGE_SIZE, MAX_PAGE_SIZE = 20, 100
MAX_ATTEMPTS = 5
RETRY_INITIAL_S, RETRY_MULTIPLIER, RETRY_MAX_S = 1, 2, 10
USER_BUCKET = (100, 100, 60_000_000)      # capacity, refill tokens, refill period in us
ADDRESS_BUCKET = (10, 10, 60_000_000)
FAILURE_WINDOW, FAILURE_MIN_CALLS, FAILURE_PERCENT = 10, 5, 50
# ----------------------------------------------------------------------------------
