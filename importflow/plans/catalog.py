"""Every registered query with the SQL that says what its result must be.

The SQL is written on its own terms (windows, lists, recursion), not from the Spark plans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from importflow.functions import report_key, source_key
from importflow.operators import jobs as job_ops, ledger, lifecycle, progress, quality, report, throttle
from importflow.operators.validate import pick_fields, validate
from importflow.operators.ordered import number_rows
from importflow.plans import derive
from importflow.plans.derive import table
from importflow.plans.importer import import_files
from importflow.schemas import (
    CONTACT_FIELDS, IMPORT_ERRORS, IMPORTED_RECORDS, JOB_DEFAULTS, JOBS, ORGANIZATIONS,
)
from importflow.session import freeze, scratch_path
from importflow.sources.csv_files import read_contact_files
from importflow.sources.messages import publish, table_stream
from importflow.sources.tables import read_table, table_problems, write_table
from importflow.sources.uploads import list_uploads, put_objects

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def day(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


# --- shared SQL ----------------------------------------------------------------------

CONTACTS = r"""
numbered AS (
    SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n,
           lower(replace(c_name, '#', '.')) || '@example.com' AS e
    FROM customer
), contacts AS (
    SELECT c_custkey, c_nationkey,
           c_nationkey || '-' || ((n - 1) // 1000000) AS job_id,
           (n - 1) % 1000000 + 1 AS source_row_number,
           CASE c_custkey % 11 WHEN 0 THEN '' WHEN 1 THEN 'not-an-email'
                WHEN 2 THEN '  ' || e || '  ' ELSE e END AS email,
           CASE WHEN c_custkey % 7 = 0 THEN '   ' ELSE 'Customer' END AS first_name,
           CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE substr(c_name, 10) END AS last_name,
           CASE WHEN c_custkey % 17 = 0 THEN 'call me' WHEN c_custkey % 5 = 0 THEN NULL
                ELSE '+1-555-' || lpad(CAST(c_custkey % 10000 AS varchar), 4, '0') END AS phone
    FROM numbered
)"""

CHECKED = CONTACTS + r""", trimmed AS (
    SELECT c_custkey, c_nationkey, job_id, source_row_number,
           nullif(trim(email), '') AS email, nullif(trim(first_name), '') AS first_name,
           nullif(trim(last_name), '') AS last_name, nullif(trim(phone), '') AS phone
    FROM contacts
), reasoned AS (
    SELECT *, nullif(concat_ws('; ',
        CASE WHEN email IS NULL THEN 'email is required'
             WHEN NOT regexp_full_match(email, '[^@\s]+@[^@\s]+\.[^@\s]+') THEN 'email is invalid' END,
        CASE WHEN first_name IS NULL THEN 'first_name is required' END,
        CASE WHEN last_name IS NULL THEN 'last_name is required' END,
        CASE WHEN NOT regexp_full_match(phone, '[+0-9().\-\s]{7,20}') THEN 'phone is invalid' END
    ), '') AS reason
    FROM trimmed
), checked AS (
    SELECT *, CASE WHEN reason IS NULL THEN 'VALID' ELSE 'INVALID' END AS outcome,
           CASE WHEN reason IS NULL THEN sha256(
               email || '|' || first_name || '|' || last_name || '|' || coalesce(phone, '')) END AS row_hash
    FROM reasoned
)"""

JOBS_SQL = """
jobs AS (
    SELECT CAST(o_orderkey AS varchar) AS id, o_custkey % 5 AS org_id,
           CAST(o_custkey AS varchar) AS submitted_by, 'CSV_IMPORT' AS job_type,
           CASE WHEN o_orderkey % 10 = 0 THEN 'FAILED' WHEN o_orderkey % 10 = 1 THEN 'PENDING'
                WHEN o_orderstatus = 'F' THEN 'COMPLETED' WHEN o_orderstatus = 'O' THEN 'QUEUED'
                ELSE 'PROCESSING' END AS status,
           (o_custkey % 5) || '/' || o_orderkey || '/source.csv' AS source_object_key,
           CASE WHEN o_orderkey % 3 <> 0
                THEN (o_custkey % 5) || '/' || o_orderkey || '/errors.csv' END AS error_report_object_key,
           o_orderkey % 100 AS k, o_orderkey % 7 % (o_orderkey % 100 + 1) AS f,
           o_orderdate AS created_at, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS made
    FROM orders
)"""

PUBLIC_SQL = """id, status, job_type, CASE WHEN status = 'COMPLETED' THEN k END AS total_rows,
    CASE WHEN status = 'COMPLETED' THEN k - f ELSE 0 END AS processed_rows,
    CASE WHEN status = 'COMPLETED' THEN f ELSE 0 END AS failed_rows, made AS created_at, made AS updated_at"""

LOG_SQL = """
log AS (
    SELECT user_id || '-' || CAST(ts AS date) AS job_id, ts, event_id,
           CASE event_type WHEN 'signup' THEN 'CONFIRM' WHEN 'click' THEN 'CLAIM'
                WHEN 'view' THEN CASE WHEN event_id % 7 = 0 THEN 'ATTACH' ELSE 'FLUSH' END
                WHEN 'purchase' THEN 'COMPLETE' ELSE 'FAIL' END AS event,
           event_id % 4 <> 0 AS there, event_id % 5 AS v, event_id % 3 AS i,
           row_number() OVER (PARTITION BY user_id || '-' || CAST(ts AS date)
                              ORDER BY ts, event_id) AS seq
    FROM events
), states AS (
    SELECT job_id, CAST(0 AS bigint) AS seq, CAST(NULL AS bigint) AS event_id,
           CAST(NULL AS varchar) AS event, CAST(NULL AS varchar) AS status_before,
           'PENDING' AS status, CAST(0 AS bigint) AS version, CAST(0 AS bigint) AS valid_sum,
           CAST(0 AS bigint) AS invalid_sum, CAST(0 AS bigint) AS last_row,
           CAST(NULL AS bigint) AS total, CAST(NULL AS bigint) AS updated, '' AS decision,
           false AS attached
    FROM (SELECT DISTINCT job_id FROM log)
    UNION ALL
    SELECT job_id, seq, event_id, event, status_before,
           CASE WHEN decision <> 'CHANGED' OR event IN ('FLUSH', 'ATTACH') THEN status_before
                WHEN event = 'CONFIRM' THEN 'QUEUED' WHEN event = 'CLAIM' THEN 'PROCESSING'
                WHEN event = 'COMPLETE' THEN 'COMPLETED' ELSE 'FAILED' END,
           version + CASE WHEN decision = 'CHANGED' THEN 1 ELSE 0 END,
           valid_sum + CASE WHEN event = 'FLUSH' THEN v ELSE 0 END,
           invalid_sum + CASE WHEN event = 'FLUSH' THEN i ELSE 0 END,
           CASE WHEN event = 'FLUSH' THEN event_id ELSE last_row END,
           CASE WHEN event = 'COMPLETE' THEN valid_sum + invalid_sum ELSE total END,
           CASE WHEN decision = 'CHANGED' THEN epoch_us(ts) ELSE updated END, decision,
           attached OR event = 'ATTACH'
    FROM (
        SELECT l.job_id, l.seq, l.event_id, l.event, s.status AS status_before, s.version,
               s.valid_sum, s.invalid_sum, s.last_row, s.total, s.updated, s.attached, l.v, l.i, l.ts,
               CASE l.event
                   WHEN 'CONFIRM' THEN CASE WHEN s.status = 'PENDING' AND l.there THEN 'CHANGED'
                                            WHEN s.status = 'QUEUED' THEN 'SAME' ELSE 'REJECTED' END
                   WHEN 'CLAIM' THEN CASE s.status WHEN 'QUEUED' THEN 'CHANGED'
                                          WHEN 'PROCESSING' THEN 'SAME' ELSE 'IGNORED' END
                   WHEN 'FLUSH' THEN CASE WHEN l.v + l.i > 0 THEN 'CHANGED' ELSE 'SAME' END
                   WHEN 'ATTACH' THEN CASE WHEN s.attached THEN 'SAME' ELSE 'CHANGED' END
                   WHEN 'COMPLETE' THEN CASE WHEN s.status = 'COMPLETED'
                        AND s.total = s.valid_sum + s.invalid_sum THEN 'SAME' ELSE 'CHANGED' END
                   ELSE CASE WHEN s.status IN ('COMPLETED', 'FAILED') THEN 'SAME' ELSE 'CHANGED' END
               END AS decision
        FROM states s JOIN log l ON l.job_id = s.job_id AND l.seq = s.seq + 1
    )
)"""

FINAL_STATE_SQL = f"""WITH RECURSIVE {LOG_SQL}
SELECT job_id, status, version, valid_sum AS processed_rows, invalid_sum AS failed_rows,
       last_row AS last_processed_row, total AS total_rows, updated AS updated_us,
       attached AS report_attached
FROM states QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) = 1"""

# Ten tokens, ten back per six hours; tokens are counted in units of one period's microseconds.
BUCKET = {"capacity": 10, "refill": 10, "period_us": 6 * 3600 * 1_000_000}
BUCKET_SQL = """WITH RECURSIVE e AS (
    SELECT event_type, event_id, epoch_us(ts) AS us,
           row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS seq
    FROM events
), run AS (
    SELECT event_type, CAST(0 AS bigint) AS seq, CAST(NULL AS bigint) AS event_id,
           min(us) AS us, CAST(10 * 21600000000 AS bigint) AS level, false AS allowed
    FROM e GROUP BY event_type
    UNION ALL
    SELECT event_type, seq, event_id, us,
           CASE WHEN level >= 21600000000 THEN level - 21600000000 ELSE level END,
           level >= 21600000000
    FROM (
        SELECT e.event_type, e.seq, e.event_id, e.us,
               least(10 * 21600000000, run.level + (e.us - run.us) * 10) AS level
        FROM run JOIN e ON e.event_type = run.event_type AND e.seq = run.seq + 1
    )
)
SELECT event_type, event_id, allowed,
       CASE WHEN allowed THEN level // 21600000000 ELSE 0 END AS remaining,
       CASE WHEN allowed THEN 0
            ELSE greatest(1, (21600000000 - level) // 10000000) END AS retry_after
FROM run WHERE seq > 0"""


# --- import --------------------------------------------------------------------------


def _contact_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """One job per contact file."""
    sizes = table(spark, folder, "customer").groupBy("c_nationkey").count()
    last = F.floor((F.col("count") - 1) / derive.FILE_ROWS)
    made = sizes.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    org = F.col("c_nationkey").cast("string")
    job = F.concat(org, F.lit("-"), F.col("part").cast("string"))
    return made.select(
        job.alias("id"), org.alias("org_id"), source_key(org, job).alias("source_object_key"),
        "c_nationkey",
    )


@query(f"""WITH {CHECKED}
SELECT job_id, 'COMPLETED' AS status,
       count(*) FILTER (reason IS NULL) AS processed_rows,
       count(*) FILTER (reason IS NOT NULL) AS failed_rows,
       max(source_row_number) AS last_processed_row, count(*) AS total_rows,
       CASE WHEN count(reason) > 0 THEN any_value(c_nationkey) || '/' || job_id || '/errors.csv' END
           AS error_report_object_key
FROM checked GROUP BY job_id""")
def import_contacts(spark: SparkSession, folder: str) -> DataFrame:
    """Upload every contact file, import them as one batch, derive each job's counters."""
    uploads = derive.upload_contacts(spark, folder)
    home = scratch_path(spark, "ledger")
    results = import_files(spark, home, uploads, derive.job_of_folder, batch_id=0)
    jobs = _contact_jobs(spark, folder).join(
        results.select(F.col("job_id").alias("id"), "status"), "id"
    )
    return progress.job_progress(ledger.read_progress(spark, home), jobs)


@query(f"""WITH {CHECKED}
SELECT job_id, source_row_number, outcome, reason,
       CASE WHEN reason IS NULL THEN email END AS email,
       CASE WHEN reason IS NULL THEN first_name END AS first_name,
       CASE WHEN reason IS NULL THEN last_name END AS last_name,
       CASE WHEN reason IS NULL THEN phone END AS phone, row_hash
FROM checked""")
def validate_contacts(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.to_outcomes(validate(derive.contacts(spark, folder)))


@query(f"""WITH {CHECKED}, named AS (
    SELECT *, CASE WHEN reason IS NULL THEN 'record' ELSE 'error' END AS kind FROM checked),
hashed AS (SELECT *, md5(kind || '/' || job_id || '/' || source_row_number) AS h FROM named)
SELECT kind, job_id, source_row_number, reason, true AS dated,
       regexp_replace(h, '^(.{{8}})(.{{4}}).(.{{3}}).(.{{3}})(.{{12}})$', '\\1-\\2-8\\3-a\\4-\\5') AS id
FROM hashed""")
def named_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Import the contacts, replay the batch and read both row tables as they are declared."""
    uploads = derive.upload_contacts(spark, folder)
    home = scratch_path(spark, "ledger")
    for _ in range(2):
        import_files(spark, home, uploads, derive.job_of_folder, batch_id=0)
    rows = ledger.read_ledger(spark, home, times=True)
    records = quality.require_schema(ledger.record_table(rows), IMPORTED_RECORDS)
    errors = quality.require_schema(ledger.error_table(rows), IMPORT_ERRORS)
    both = records.withColumns({"kind": F.lit("record"), "reason": F.lit(None).cast("string")}).unionByName(
        errors.withColumn("kind", F.lit("error")), allowMissingColumns=True
    )
    dated = F.col("created_at").isNotNull() & (F.col("created_at") <= F.current_timestamp())
    return both.select("kind", "job_id", "source_row_number", "reason", dated.alias("dated"), "id")


def _fancy_sql() -> str:
    return CONTACTS + r""", fancy AS (
    SELECT job_id, source_row_number, coalesce(email, '') AS email,
           CASE WHEN c_custkey % 7 = 0 THEN '   '
                WHEN c_custkey % 10 = 3 THEN 'Cust, "the" one'
                WHEN c_custkey % 50 = 9 THEN 'Two' || chr(10) || 'lines, "quoted"' || chr(10) || chr(10)
                WHEN c_custkey % 50 = 19 THEN 'five" pipe' ELSE 'Customer' END AS first_name,
           coalesce(last_name, '') AS last_name, coalesce(phone, '') AS phone
    FROM contacts
)"""


@query(f"""WITH {_fancy_sql()}
SELECT job_id, source_row_number, email, first_name, last_name, phone FROM fancy""")
def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Contacts written as CSV and read back: same rows, numbers and raw values."""
    uploads = derive.upload_contacts(spark, folder, fancy=True)
    found = read_contact_files(spark, uploads, derive.job_of_folder)
    return pick_fields(found.rows).select("job_id", "source_row_number", *CONTACT_FIELDS)


_VARIANTS = [
    "email,first_name,last_name,phone", "phone,last_name,first_name,email",
    "email,first_name,phone", "Email,first_name,last_name,phone,email",
]


@query(rf"""WITH {CONTACTS}, shaped AS (
    SELECT job_id, source_row_number, c_nationkey % 4 AS v,
           CASE c_nationkey % 4 WHEN 2 THEN 3 WHEN 3 THEN 5 ELSE 4 END
           + CASE c_custkey % 6 WHEN 0 THEN -1 WHEN 1 THEN 1 ELSE 0 END AS n
    FROM contacts
), placed AS (
    SELECT *, unnest([
        {{'o': 1, 'name': 'email', 'at': CASE v WHEN 1 THEN 3 WHEN 3 THEN 4 ELSE 0 END}},
        {{'o': 2, 'name': 'first_name', 'at': CASE v WHEN 1 THEN 2 ELSE 1 END}},
        {{'o': 3, 'name': 'last_name', 'at': CASE v WHEN 1 THEN 1 WHEN 2 THEN NULL ELSE 2 END}},
        {{'o': 4, 'name': 'phone', 'at': CASE v WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE 3 END}}]) AS f
    FROM shaped
)
SELECT job_id, source_row_number,
       'malformed row: ' || CASE WHEN f.at IS NULL
           THEN 'Mapping for ' || f.name || ' not found, expected one of [email, first_name, phone]'
           ELSE 'Index for header ''' || f.name || ''' is ' || f.at || ' but CSVRecord only has '
                || n || ' values!' END AS reason
FROM placed WHERE f.at IS NULL OR f.at >= n
QUALIFY row_number() OVER (PARTITION BY job_id, source_row_number ORDER BY f.o) = 1""")
def malformed_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Files with reordered, missing and doubled headers; rows that are short or long."""
    rows = derive.contacts(spark, folder)
    variant = F.col("c_nationkey") % 4
    by_variant = [derive.csv_line(h.split(",")) for h in _VARIANTS[:3]]
    by_variant.append(derive.csv_line(["email", "first_name", "last_name", "phone", "email"]))
    line, header = by_variant[3], F.lit(_VARIANTS[3])
    for n in (2, 1, 0):
        line = F.when(variant == n, by_variant[n]).otherwise(line)
        header = F.when(variant == n, _VARIANTS[n]).otherwise(header)
    line = (
        F.when(F.col("c_custkey") % 6 == 0, F.regexp_replace(line, ",[^,]*$", ""))
        .when(F.col("c_custkey") % 6 == 1, F.concat(line, F.lit(",extra"))).otherwise(line)
    )
    uploads = derive.upload_lines(spark, rows.withColumn("line", line), header)
    found = read_contact_files(spark, uploads, derive.job_of_folder)
    checked = validate(pick_fields(found.rows))
    return checked.where(F.startswith("reason", F.lit("malformed row: "))).select(
        "job_id", "source_row_number", "reason"
    )


@query("""WITH placed AS (
    SELECT CAST(o_orderkey % 4 AS varchar) AS job_id, o_orderkey % 11 <> 0 AS sound,
           row_number() OVER (PARTITION BY o_orderkey % 4 ORDER BY o_orderkey) AS n,
           count(*) OVER (PARTITION BY o_orderkey % 4) AS size
    FROM orders
), faulty AS (
    SELECT job_id, n, size, CASE WHEN job_id <> '0' THEN size - size // 3 END AS fault,
           sum(sound::int) OVER (PARTITION BY job_id ORDER BY n) AS good, sound
    FROM placed
)
SELECT job_id, CASE WHEN job_id = '0' THEN 'COMPLETED' ELSE 'FAILED' END AS status,
       any_value(fault) AS failed_row,
       CASE job_id WHEN '1' THEN 'invalid character between encapsulated token and delimiter'
            WHEN '2' THEN 'value too long'
            WHEN '3' THEN 'EOF reached before encapsulated token finished' END AS failed_why,
       CASE WHEN job_id = '0' THEN max(size)
            ELSE coalesce(max(n) FILTER (sound AND good % 500 = 0 AND n < fault), 0) END AS rows_kept
FROM faulty GROUP BY job_id""")
def failed_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files that break off two thirds down, each in a way of its own, beside a sound one: what stops
    them, and what the commits before that kept."""
    orders = table(spark, folder, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).alias("part"))
    sizes = orders.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    rows = number_rows(orders, ["part"], ["o_orderkey"], "source_row_number").join(F.broadcast(sizes), "part")
    key = F.col("o_orderkey").cast("string")
    email = F.when(F.col("o_orderkey") % 11 != 0, F.concat(key, F.lit("@example.com"))).otherwise("")
    whole = F.concat(email, F.lit(",First,Last,"))
    fault = (
        F.when(F.col("part") == 1, '"quoted"more,First,Last,')
        .when(F.col("part") == 2, F.concat(F.lit("a@example.com,"), F.repeat(F.lit("x"), F.lit(300)), F.lit(",Last,")))
        .when(F.col("part") == 3, '"never closed,First,Last,').otherwise(whole)
    )
    here = F.col("source_row_number") == F.col("size") - F.floor(F.col("size") / 3)
    lines = rows.select(
        F.col("part").cast("string").alias("job_id"), "source_row_number",
        F.when(here, fault).otherwise(whole).alias("line"),
    )
    home = scratch_path(spark, "ledger")
    results = import_files(spark, home, derive.upload_lines(spark, lines), derive.job_of_folder, batch_id=0)
    kept = ledger.read_ledger(spark, home).groupBy("job_id").agg(F.count(F.lit(1)).alias("rows_kept"))
    return results.join(kept, "job_id", "left").withColumn("rows_kept", F.coalesce("rows_kept", F.lit(0)))


@query(f"""WITH {CONTACTS}
SELECT job_id, CAST(33 + sum(strlen(coalesce(email, '')) + strlen(first_name)
       + strlen(coalesce(last_name, '')) + strlen(coalesce(phone, '')) + 4) AS bigint) AS length
FROM contacts GROUP BY job_id""")
def upload_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of uploaded objects, taken from the listing alone."""
    uploads = derive.upload_contacts(spark, folder)
    listed = list_uploads(spark, uploads, "*.txt")
    return listed.select(F.regexp_extract("object_key", "job_id=([^/]+)/", 1).alias("job_id"), "length")


# --- ledger --------------------------------------------------------------------------


@query("""WITH first AS (
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                               ORDER BY l_partkey, l_suppkey) = 1
)
SELECT * FROM first f WHERE NOT EXISTS (
    SELECT 1 FROM lineitem x WHERE x.l_quantity < 10
    AND x.l_orderkey = f.l_orderkey AND x.l_linenumber = f.l_linenumber)""")
def insert_if_absent(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "lineitem")
    new = items.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    there = items.where("l_quantity < 10").select("l_orderkey", "l_linenumber")
    return ledger.insert_if_absent(new, there, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])


@query(f"""WITH {CHECKED}
SELECT job_id, source_row_number, outcome, reason, row_hash,
       CASE WHEN source_row_number <= c_nationkey * 2 THEN 0 ELSE 1 END AS batch_id
FROM checked""")
def resume_import(spark: SparkSession, folder: str) -> DataFrame:
    """A first batch stopped part way; the next goes on from its cursors and is run twice."""
    home = scratch_path(spark, "ledger")
    begun = ledger.to_outcomes(
        validate(derive.contacts(spark, folder).where("source_row_number <= c_nationkey * 2"))
    )
    ledger.commit_batch(spark, home, begun, 0)
    uploads = derive.upload_contacts(spark, folder)
    for _ in range(2):
        import_files(spark, home, uploads, derive.job_of_folder, batch_id=1)
    return ledger.read_ledger(spark, home).select(
        "job_id", "source_row_number", "outcome", "reason", "row_hash",
        F.col("batch_id").cast("int").alias("batch_id"),
    )


@query(f"""WITH {CHECKED}
SELECT job_id, source_row_number, outcome FROM checked
WHERE source_row_number > CASE WHEN c_nationkey % 3 = 0 THEN 0 ELSE c_nationkey END""")
def resume_from_cursor(spark: SparkSession, folder: str) -> DataFrame:
    rows = validate(derive.contacts(spark, folder)).select("job_id", "source_row_number", "outcome")
    held = _contact_jobs(spark, folder).where("c_nationkey % 3 != 0").select(
        F.col("id").alias("job_id"), F.col("c_nationkey").cast("bigint").alias("cursor")
    )
    return ledger.after_cursor(rows, held)


@query(f"""WITH {CHECKED}
SELECT job_id, source_row_number, outcome, row_hash,
       CASE WHEN c_nationkey % 4 < 3 THEN -3 ELSE 3 END AS batch_id FROM checked""")
def compact_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Four batches, of which the first three are put together."""
    home = scratch_path(spark, "ledger")
    rows = validate(derive.contacts(spark, folder))
    for batch in range(4):
        mine = rows.where(F.col("c_nationkey") % 4 == batch)
        ledger.commit_batch(spark, home, ledger.to_outcomes(mine), batch)
    ledger.compact(spark, home, 3)
    return ledger.read_ledger(spark, home).select(
        "job_id", "source_row_number", "outcome", "row_hash",
        F.col("batch_id").cast("int").alias("batch_id"),
    )


# --- progress ------------------------------------------------------------------------


def _outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.to_outcomes(validate(derive.contacts(spark, folder)))


@query(f"""WITH {CHECKED}, jobs AS (
    SELECT DISTINCT job_id FROM checked UNION ALL SELECT n_nationkey || '-none' FROM nation)
SELECT j.job_id, count(c.job_id) AS records
FROM jobs j LEFT JOIN checked c ON c.job_id = j.job_id AND c.reason IS NULL GROUP BY j.job_id""")
def records_per_job(spark: SparkSession, folder: str) -> DataFrame:
    empty = table(spark, folder, "nation").select(
        F.concat(F.col("n_nationkey").cast("string"), F.lit("-none")).alias("id")
    )
    jobs = _contact_jobs(spark, folder).select("id").unionByName(empty)
    return progress.records_per_job(ledger.imported_records(_outcomes(spark, folder)), jobs)


@query(f"""WITH {CHECKED}
SELECT job_id, CASE any_value(c_nationkey) % 3 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'PROCESSING'
           ELSE 'FAILED' END AS status,
       count(*) FILTER (reason IS NULL) AS processed_rows, count(reason) AS failed_rows,
       max(source_row_number) AS last_processed_row,
       CASE WHEN any_value(c_nationkey) % 3 = 0 THEN count(*) END AS total_rows,
       CASE WHEN count(reason) > 0 THEN any_value(c_nationkey) || '/' || job_id || '/errors.csv' END
           AS error_report_object_key
FROM checked GROUP BY job_id""")
def job_progress(spark: SparkSession, folder: str) -> DataFrame:
    status = (
        F.when(F.col("c_nationkey") % 3 == 0, "COMPLETED")
        .when(F.col("c_nationkey") % 3 == 1, "PROCESSING").otherwise("FAILED")
    )
    jobs = _contact_jobs(spark, folder).withColumn("status", status)
    return progress.job_progress(ledger.batch_counts(_outcomes(spark, folder)), jobs)


@query(f"""WITH {CHECKED}, shown AS (
    SELECT * FROM checked WHERE reason IS NULL OR (reason LIKE '%phone%' AND c_nationkey % 2 = 0))
SELECT job_id, count(reason) AS failed_rows,
       CASE WHEN count(reason) > 0 THEN any_value(c_nationkey) || '/' || job_id || '/errors.csv' END
           AS error_report_object_key
FROM shown GROUP BY job_id""")
def report_attachment(spark: SparkSession, folder: str) -> DataFrame:
    """A report key if and only if there are error rows; half the jobs keep none here."""
    rows = validate(derive.contacts(spark, folder)).where(
        "reason IS NULL OR (reason LIKE '%phone%' AND c_nationkey % 2 = 0)"
    )
    counts = ledger.batch_counts(rows)
    jobs = _contact_jobs(spark, folder).join(
        counts.select(F.col("job_id").alias("id")), "id", "left_semi"
    ).withColumn("status", F.lit("COMPLETED"))
    return progress.job_progress(counts, jobs).select(
        "job_id", "failed_rows", "error_report_object_key"
    )


@query(f"""WITH {CHECKED}, r AS (SELECT job_id, source_row_number FROM checked WHERE reason IS NULL),
e AS (SELECT job_id, source_row_number FROM checked
      WHERE reason IS NOT NULL OR (c_custkey % 40 = 3 AND c_nationkey % 2 = 0)),
told AS (SELECT job_id, count(*) FILTER (reason IS NULL)
                + CASE WHEN any_value(c_nationkey) % 5 = 0 THEN 1 ELSE 0 END AS processed_rows,
                count(reason) AS failed_rows FROM checked GROUP BY job_id),
found AS (SELECT t.job_id, processed_rows,
                 (SELECT count(*) FROM r WHERE r.job_id = t.job_id) AS imported_rows, failed_rows,
                 (SELECT count(*) FROM e WHERE e.job_id = t.job_id) AS error_rows,
                 (SELECT count(*) FROM r JOIN e USING (job_id, source_row_number)
                  WHERE r.job_id = t.job_id) AS rows_in_both
          FROM told t)
SELECT * FROM found WHERE processed_rows <> imported_rows OR failed_rows <> error_rows OR rows_in_both > 0""")
def ledger_reconcile(spark: SparkSession, folder: str) -> DataFrame:
    """Tables with planted faults: wrong counters, rows that are record and error at once."""
    rows = validate(derive.contacts(spark, folder))
    records = rows.where("outcome = 'VALID'")
    errors = rows.where("outcome = 'INVALID' OR (c_custkey % 40 = 3 AND c_nationkey % 2 = 0)")
    told = rows.groupBy(F.col("job_id").alias("id"), "c_nationkey").agg(
        F.count_if(F.col("reason").isNull()).alias("p"), F.count("reason").alias("failed_rows")
    )
    wrong = F.when(F.col("c_nationkey") % 5 == 0, 1).otherwise(0)
    return progress.reconcile(records, errors, told.withColumn("processed_rows", F.col("p") + wrong))


# --- reports -------------------------------------------------------------------------


@query(f"""WITH {CHECKED}
SELECT job_id, source_row_number || ',' || CASE WHEN contains(reason, ',') THEN '"' || reason || '"'
       ELSE reason END AS line FROM checked WHERE reason IS NOT NULL
UNION ALL SELECT DISTINCT job_id, 'row_number,error' FROM checked WHERE reason IS NOT NULL""")
def error_report(spark: SparkSession, folder: str) -> DataFrame:
    """Reports put at the keys that the jobs carry, and read back through those keys."""
    root = scratch_path(spark, "reports")
    rows = freeze(_outcomes(spark, folder))
    jobs = _contact_jobs(spark, folder).withColumn("status", F.lit("COMPLETED"))
    told = freeze(progress.job_progress(ledger.batch_counts(rows), jobs).select("job_id", "error_report_object_key"))
    report.write_reports(ledger.import_errors(rows), told, root)
    return report.read_reports(spark, root).join(told, "error_report_object_key").select("job_id", "line")


@query(f"""WITH {CHECKED}
SELECT source_row_number, reason FROM checked WHERE job_id = '7-0' AND reason IS NOT NULL
ORDER BY source_row_number""")
def errors_of_job(spark: SparkSession, folder: str) -> DataFrame:
    return report.errors_in_order(ledger.import_errors(_outcomes(spark, folder)), "7-0")


@query(f"""WITH {JOBS_SQL}
SELECT id, CASE WHEN CAST(id AS bigint) % 4 = 0 THEN 'errors.csv'
                ELSE org_id || '/' || id || '/errors.csv' END AS report_key FROM jobs""")
def report_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys with folders and keys without."""
    key = F.when(F.col("id").cast("bigint") % 4 == 0, "upload.csv").otherwise(F.col("source_object_key"))
    return derive.jobs(spark, folder).select("id", report_key(key).alias("report_key"))


# --- job queries ---------------------------------------------------------------------


@query(f"""WITH {JOBS_SQL}
SELECT id, CAST(org_id AS varchar) AS org_id, submitted_by, job_type, 'PENDING' AS status,
       org_id || '/u' || id || '/source.csv' AS source_object_key,
       CAST(0 AS bigint) AS processed_rows, CAST(0 AS bigint) AS failed_rows,
       CAST(0 AS bigint) AS last_processed_row, CAST(0 AS bigint) AS version, CAST(NULL AS bigint) AS total_rows,
       made AS created_at FROM jobs""")
def job_create(spark: SparkSession, folder: str) -> DataFrame:
    requests = derive.jobs(spark, folder).select("id", "org_id", "submitted_by", "created_at")
    made = job_ops.create_jobs(
        requests, F.concat(F.lit("u"), F.col("id")), F.col("created_at").cast("timestamp")
    )
    return made.select(
        "id", "org_id", "submitted_by", "job_type", "status", "source_object_key", "processed_rows",
        "failed_rows", "last_processed_row", "version", "total_rows", day("created_at"),
    )


def _page(rows: DataFrame) -> DataFrame:
    view = job_ops.public_view(rows)
    return view.select(*[day(c) if c in ("created_at", "updated_at") else c for c in view.columns])


@query(f"""WITH {JOBS_SQL} SELECT {PUBLIC_SQL} FROM
(SELECT * FROM jobs WHERE org_id = 2 ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 40)""")
def job_page(spark: SparkSession, folder: str) -> DataFrame:
    return _page(job_ops.list_jobs(derive.jobs(spark, folder), 2, page=2, size=20))


@query(f"""WITH {JOBS_SQL} SELECT {PUBLIC_SQL} FROM
(SELECT * FROM jobs WHERE org_id = 1 AND status = 'COMPLETED'
 ORDER BY created_at DESC, id DESC LIMIT 100 OFFSET 0)""")
def job_page_by_status(spark: SparkSession, folder: str) -> DataFrame:
    """Page and size out of range are pulled to 0 and 100."""
    return _page(job_ops.list_jobs(derive.jobs(spark, folder), 1, page=-3, size=500, status="COMPLETED"))


@query(f"""WITH {JOBS_SQL} SELECT {PUBLIC_SQL} FROM
(SELECT * FROM jobs WHERE org_id = 3 ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 1500)""")
def job_page_deep(spark: SparkSession, folder: str) -> DataFrame:
    """A page far down, found by number and not through a top-k."""
    return _page(job_ops.list_jobs(derive.jobs(spark, folder), 3, page=30, size=50, top_rows=1000))


@query(f"""WITH {JOBS_SQL}
SELECT 0 AS page, 20 AS size, count(*) AS total_elements, (count(*) + 19) // 20 AS total_pages
FROM jobs WHERE org_id = 2 AND status = 'QUEUED'""")
def job_page_summary(spark: SparkSession, folder: str) -> DataFrame:
    return job_ops.page_summary(derive.jobs(spark, folder), 2, status="QUEUED")


@query(f"""WITH {JOBS_SQL} SELECT {PUBLIC_SQL}, org_id FROM jobs WHERE id = '1000'""")
def job_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """One id asked for by each tenant: only its own finds it."""
    jobs = derive.jobs(spark, folder)
    found = [job_ops.find_job(jobs, "1000", org) for org in range(5)]
    rows = found[0]
    for other in found[1:]:
        rows = rows.unionByName(other)
    return rows.select(
        *[day(c) if c in ("created_at", "updated_at") else c for c in job_ops.PUBLIC_COLUMNS], "org_id"
    )


@query(f"""WITH {JOBS_SQL}
SELECT org_id, status IN ('COMPLETED', 'FAILED') AS terminal, count(*) AS jobs
FROM jobs GROUP BY ALL""")
def terminal_jobs(spark: SparkSession, folder: str) -> DataFrame:
    jobs = derive.jobs(spark, folder)
    return jobs.groupBy("org_id", job_ops.is_terminal().alias("terminal")).agg(
        F.count(F.lit(1)).alias("jobs")
    )


def _users(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    name = F.concat(F.lit("User"), (key % 1000).cast("string"), F.lit("@Example.com"))
    return table(spark, folder, "customer").select(
        key.alias("id"), F.when(key % 2 == 0, F.upper(name)).otherwise(name).alias("email"),
    )


USERS_SQL = """users AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0
    THEN upper('User' || (c_custkey % 1000) || '@Example.com')
    ELSE 'User' || (c_custkey % 1000) || '@Example.com' END AS email FROM customer)"""


@query(f"WITH {USERS_SQL} SELECT id, email FROM users WHERE lower(email) = 'user42@example.com'")
def user_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return job_ops.find_user(_users(spark, folder), "uSer42@example.COM")


@query(f"""WITH {JOBS_SQL}
SELECT id, org_id, CASE WHEN status = 'FAILED' THEN 'JOB_FAILED'
       WHEN status <> 'COMPLETED' THEN 'RESULT_NOT_READY'
       WHEN error_report_object_key IS NULL THEN 'NO_ERROR_REPORT' ELSE 'REPORT' END AS result,
       CASE WHEN status = 'COMPLETED' THEN error_report_object_key END AS report_key
FROM jobs""")
def result_outcome(spark: SparkSession, folder: str) -> DataFrame:
    return job_ops.result_outcome(derive.jobs(spark, folder))


@query(f"""WITH {JOBS_SQL}, sized AS (
    SELECT id, org_id, status, CASE WHEN CAST(id AS bigint) % 3 = 0 THEN 0
           ELSE (CAST(id AS bigint) // 10) % 4 * 100 END AS length FROM jobs)
SELECT id, org_id, status,
       CASE status WHEN 'QUEUED' THEN 'UNCHANGED'
            WHEN 'PENDING' THEN CASE WHEN length > 0 THEN 'QUEUED' ELSE 'UPLOAD_NOT_FOUND' END
            ELSE 'INVALID_JOB_STATE' END AS outcome,
       CASE WHEN status = 'PENDING' AND length > 0 THEN 'QUEUED' ELSE status END AS status_after
FROM sized""")
def upload_admission(spark: SparkSession, folder: str) -> DataFrame:
    """Confirmations against a listing in which a third of the objects are missing."""
    jobs = derive.jobs(spark, folder)
    number = F.col("id").cast("bigint")
    listing = jobs.where(number % 3 != 0).select(
        F.col("source_object_key").alias("object_key"),
        (F.floor(number / 10) % 4 * 100).alias("length"),
    )
    return job_ops.admit_uploads(jobs, listing)


# --- quality -------------------------------------------------------------------------


@query(f"""WITH {USERS_SQL} SELECT lower(email) AS email, count(*) AS rows_with_key
FROM users GROUP BY lower(email) HAVING count(*) > 1""")
def unique_lower_email(spark: SparkSession, folder: str) -> DataFrame:
    return quality.duplicate_keys(_users(spark, folder), email=F.lower("email"))


@query("""SELECT l_orderkey AS job_id, l_linenumber AS source_row_number, count(*) AS rows_with_key
FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def unique_row_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return quality.duplicate_keys(
        table(spark, folder, "lineitem"),
        job_id=F.col("l_orderkey"), source_row_number=F.col("l_linenumber"),
    )


@query("""SELECT o_custkey AS missing, count(*) AS child_rows FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0) GROUP BY o_custkey""")
def orphan_rows(spark: SparkSession, folder: str) -> DataFrame:
    parents = table(spark, folder, "customer").where("c_custkey % 7 != 0")
    return quality.orphans(table(spark, folder, "orders"), "o_custkey", parents, "c_custkey")


@query("""SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)""")
def orphan_records(spark: SparkSession, folder: str) -> DataFrame:
    parents = table(spark, folder, "customer").where("c_custkey % 7 != 0")
    children = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return quality.orphan_records(children, "o_custkey", parents, "c_custkey", ["o_orderkey"])


@query("""SELECT 'o_orderstatus' AS column_name, o_orderstatus AS value, count(*) AS rows_with_value
FROM orders WHERE o_orderstatus NOT IN ('F', 'O') GROUP BY o_orderstatus
UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders
WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') GROUP BY o_orderpriority""")
def domain_check(spark: SparkSession, folder: str) -> DataFrame:
    return quality.outside_domain(table(spark, folder, "orders"), {
        "o_orderstatus": ["F", "O"], "o_orderpriority": ["1-URGENT", "2-HIGH"],
    })


@query(f"""WITH {CHECKED}
SELECT unnest(['email', 'first_name', 'last_name', 'phone']) AS column_name,
       unnest([count(*) - count(email), count(*) - count(first_name),
               count(*) - count(last_name), count(*) - count(phone)]) AS nulls,
       count(*) AS all_rows FROM checked""")
def null_profile(spark: SparkSession, folder: str) -> DataFrame:
    return quality.null_counts(validate(derive.contacts(spark, folder)), CONTACT_FIELDS)


@query(f"""WITH {CONTACTS}, v AS (
    SELECT job_id, source_row_number, unnest([
        {{'c': 'email', 'n': length(email), 'm': 30}},
        {{'c': 'first_name', 'n': length(first_name), 'm': 5}},
        {{'c': 'phone', 'n': length(phone), 'm': 10}}]) AS f FROM contacts)
SELECT job_id, source_row_number, f.c AS column_name, CAST(f.n AS integer) AS value_length,
       f.m AS max_length
FROM v WHERE f.n > f.m""")
def length_check(spark: SparkSession, folder: str) -> DataFrame:
    limits = {"email": 30, "first_name": 5, "phone": 10}
    return quality.too_long_values(
        derive.contacts(spark, folder), limits, ["job_id", "source_row_number"]
    )


@query("""WITH organizations AS (
    SELECT n_nationkey AS id, CASE WHEN n_nationkey % 10 = 3 THEN NULL ELSE n_name END AS name FROM nation
), users AS (
    SELECT c_custkey AS id, CASE WHEN c_custkey % 20 = 1 THEN 'Same' || (c_custkey % 3) || '@x.co'
                WHEN c_custkey % 20 = 2 THEN upper('same' || (c_custkey % 3) || '@x.co')
                WHEN c_custkey % 50 = 5 THEN repeat('x', 300) || c_custkey
                ELSE c_name || '@x.co' END AS email,
           c_nationkey + CASE WHEN c_custkey % 30 = 0 THEN 100 ELSE 0 END AS org_id,
           CASE c_custkey % 4 WHEN 0 THEN 'ADMIN' WHEN 1 THEN 'MEMBER' WHEN 2 THEN 'GUEST' END AS role
    FROM customer
), jobs AS (
    SELECT o_orderkey AS id, o_custkey AS submitted_by,
           CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'OPEN' ELSE 'PROCESSING' END AS status
    FROM orders
), records AS (SELECT l_orderkey AS job_id, l_linenumber AS source_row_number FROM lineitem)
SELECT 'organizations' AS table_name, 'NOT NULL' AS rule, 'name' AS column_name,
       CAST(NULL AS varchar) AS value, count(*) AS violations
FROM organizations WHERE name IS NULL HAVING count(*) > 0
UNION ALL SELECT 'users', 'NOT NULL', 'role', NULL, count(*) FROM users WHERE role IS NULL HAVING count(*) > 0
UNION ALL SELECT 'users', 'UNIQUE', 'lower(email)', lower(email), count(*) FROM users
    GROUP BY lower(email) HAVING count(*) > 1
UNION ALL SELECT 'users', 'FOREIGN KEY', 'org_id', CAST(org_id AS varchar), count(*) FROM users
    WHERE org_id NOT IN (SELECT id FROM organizations) GROUP BY org_id
UNION ALL SELECT 'users', 'CHECK', 'role', role, count(*) FROM users WHERE role = 'GUEST' GROUP BY role
UNION ALL SELECT 'users', 'LENGTH', 'email', NULL, count(*) FROM users WHERE length(email) > 255
    HAVING count(*) > 0
UNION ALL SELECT 'jobs', 'FOREIGN KEY', 'submitted_by', CAST(submitted_by AS varchar), count(*) FROM jobs
    WHERE submitted_by NOT IN (SELECT id FROM users) GROUP BY submitted_by
UNION ALL SELECT 'jobs', 'CHECK', 'status', status, count(*) FROM jobs WHERE status = 'OPEN' GROUP BY status
UNION ALL SELECT 'imported_records', 'UNIQUE', 'job_id, source_row_number',
    job_id || ', ' || source_row_number, count(*) FROM records GROUP BY job_id, source_row_number
    HAVING count(*) > 1
UNION ALL SELECT 'imported_records', 'FOREIGN KEY', 'job_id', CAST(job_id AS varchar), count(*) FROM records
    WHERE job_id NOT IN (SELECT id FROM jobs) GROUP BY job_id""")
def table_violations(spark: SparkSession, folder: str) -> DataFrame:
    """All declared constraints on tables with planted faults."""
    nation, key = F.col("n_nationkey"), F.col("c_custkey")
    same = F.concat(F.lit("Same"), (key % 3).cast("string"), F.lit("@x.co"))
    status = F.col("o_orderstatus")
    return quality.table_violations({
        "organizations": table(spark, folder, "nation").select(
            nation.alias("id"), F.when(nation % 10 != 3, F.col("n_name")).alias("name")),
        "users": table(spark, folder, "customer").select(
            key.alias("id"),
            F.when(key % 20 == 1, same).when(key % 20 == 2, F.upper(same))
            .when(key % 50 == 5, F.concat(F.repeat(F.lit("x"), 300), key.cast("string")))
            .otherwise(F.concat("c_name", F.lit("@x.co"))).alias("email"),
            (F.col("c_nationkey") + F.when(key % 30 == 0, 100).otherwise(0)).alias("org_id"),
            F.when(key % 4 == 0, "ADMIN").when(key % 4 == 1, "MEMBER").when(key % 4 == 2, "GUEST")
            .alias("role")),
        "jobs": table(spark, folder, "orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("submitted_by"),
            F.when(status == "F", "COMPLETED").when(status == "O", "OPEN").otherwise("PROCESSING")
            .alias("status")),
        "imported_records": table(spark, folder, "lineitem").select(
            F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("source_row_number")),
    })


@query("""SELECT 'departing' AS table_name, 'column name holds ' || count(*) || ' NULLs, declared NOT NULL' AS problem
FROM customer WHERE c_custkey % 7 = 0
UNION ALL SELECT 'retyped', 'column id is bigint, declared string'
UNION ALL SELECT 'retyped', 'missing column created_at'
UNION ALL SELECT 'written', 'read: ' || count(*) FROM customer""")
def schema_check(spark: SparkSession, folder: str) -> DataFrame:
    """Stored tables held against their declaration: one written under it, a foreign one that keeps to it,
    one with NULLs and one of another shape."""
    made = table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"),
        F.timestamp_seconds("c_custkey").alias("created_at"),
    )
    home = scratch_path(spark, "tables")
    write_table(made, f"{home}/written", ORGANIZATIONS)
    made.write.parquet(f"{home}/foreign")
    made.withColumn("name", F.when(F.col("id").cast("bigint") % 7 != 0, F.col("name"))).write.parquet(
        f"{home}/departing")
    made.select(F.col("id").cast("bigint"), "name").write.parquet(f"{home}/retyped")
    problems = [
        (name, problem) for name in ("written", "foreign", "departing", "retyped")
        for problem in table_problems(spark.read.parquet(f"{home}/{name}"), ORGANIZATIONS)
    ]
    read = read_table(spark, f"{home}/written", ORGANIZATIONS).agg(
        F.lit("written").alias("table_name"),
        F.concat(F.lit("read: "), F.count(F.lit(1)).cast("string")).alias("problem"))
    return read.unionByName(spark.createDataFrame(problems, "table_name string, problem string"))


@query(f"""WITH {CHECKED}, left_over AS (SELECT * FROM checked WHERE c_nationkey % 5 <> 0)
SELECT 'jobs' AS table_name, job_id, CAST(NULL AS bigint) AS source_row_number
FROM (SELECT DISTINCT job_id FROM left_over)
UNION ALL SELECT CASE WHEN reason IS NULL THEN 'records' ELSE 'errors' END, job_id, source_row_number
FROM left_over""")
def cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    outcomes = _outcomes(spark, folder)
    jobs = _contact_jobs(spark, folder)
    deleted = jobs.where("c_nationkey % 5 = 0").select(F.col("id").alias("job_id"))
    kept = quality.cascade_delete(
        jobs, ledger.imported_records(outcomes), ledger.import_errors(outcomes), deleted
    )
    def rows(name, df, job, number):
        return df.select(F.lit(name).alias("table_name"), F.col(job).alias("job_id"),
                         number.cast("bigint").alias("source_row_number"))
    return (
        rows("jobs", kept[0], "id", F.lit(None))
        .unionByName(rows("records", kept[1], "job_id", F.col("source_row_number")))
        .unionByName(rows("errors", kept[2], "job_id", F.col("source_row_number")))
    )


@query(r"""WITH r AS (
    SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN '  ' ELSE c_mktsegment END AS o,
           CASE c_custkey % 8 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'nobody'
                ELSE 'a@example.com' END AS e,
           CASE c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'short' ELSE 'long enough' END AS p
    FROM customer)
SELECT c_custkey, concat_ws('; ',
    CASE WHEN trim(o) = '' THEN 'organizationName=must not be blank' END,
    CASE WHEN coalesce(trim(e), '') = '' THEN 'email=must not be blank'
         WHEN e = 'nobody' THEN 'email=must be a well-formed email address' END,
    CASE WHEN p = '' THEN 'password=must not be blank'
         WHEN p = 'short' THEN 'password=password must be at least 8 characters' END) AS errors
FROM r""")
def field_errors(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    rows = table(spark, folder, "customer").select(
        key,
        F.when(key % 9 == 0, "  ").otherwise(F.col("c_mktsegment")).alias("organization_name"),
        F.when(key % 8 == 0, F.lit(None)).when(key % 8 == 1, " ").when(key % 8 == 2, "nobody")
        .otherwise("a@example.com").alias("email"),
        F.when(key % 7 == 0, "").when(key % 7 == 1, "short").otherwise("long enough").alias("password"),
    )
    entries = F.map_entries(quality.registration_errors())
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")
    return rows.select("c_custkey", text.alias("errors"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'PENDING' ELSE o_orderstatus END
    AS status, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey END AS processed_rows FROM orders""")
def column_defaults(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = table(spark, folder, "orders").select(
        key.alias("id"), F.when(key % 2 != 0, F.col("o_orderstatus")).alias("status"),
        F.when(key % 3 != 0, key).alias("processed_rows"),
    )
    return job_ops.fill_defaults(rows, JOB_DEFAULTS)


# --- states --------------------------------------------------------------------------


@query(FINAL_STATE_SQL)
def job_state(spark: SparkSession, folder: str) -> DataFrame:
    states = lifecycle.job_states(derive.transition_log(spark, folder))
    return states.withColumn("updated_us", F.unix_micros(F.col("updated_at").cast("timestamp"))).drop(
        "updated_at"
    )


@query(f"""WITH RECURSIVE {LOG_SQL}
SELECT job_id, event_id, event, status_before, decision, status AS status_after
FROM states WHERE seq > 0""")
def job_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return lifecycle.log_decisions(derive.transition_log(spark, folder)).select(
        "job_id", "event_id", "event", "status_before", "decision", "status_after"
    )


MESSAGES_SQL = """messages AS (
    SELECT CAST(l_orderkey + CASE WHEN l_linenumber = 7 THEN 1000000000 ELSE 0 END AS varchar) AS job_id
    FROM lineitem)"""


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    astray = F.when(F.col("l_linenumber") == 7, 1_000_000_000).otherwise(0)
    return table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") + astray).cast("string").alias("jobId")
    )


@query(f"""WITH {JOBS_SQL}, {MESSAGES_SQL}
SELECT m.job_id, j.status, CASE WHEN j.id IS NULL THEN 'DISCARD' WHEN j.status = 'QUEUED' THEN 'CLAIM'
       WHEN j.status = 'PROCESSING' THEN 'RESUME' ELSE 'IGNORE' END AS decision
FROM (SELECT DISTINCT job_id FROM messages) m LEFT JOIN jobs j ON j.id = m.job_id""")
def claim_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Messages redelivered many times over, some for jobs nobody knows."""
    return lifecycle.claim_gate(_messages(spark, folder), derive.jobs(spark, folder))


@query(f"""WITH {JOBS_SQL}
SELECT id AS "jobId" FROM jobs WHERE status = 'QUEUED' AND CAST(id AS bigint) NOT IN
(SELECT l_orderkey FROM lineitem WHERE l_linenumber % 3 = 0)""")
def unpublished_jobs(spark: SparkSession, folder: str) -> DataFrame:
    sent = table(spark, folder, "lineitem").where("l_linenumber % 3 = 0").select(
        F.col("l_orderkey").cast("string").alias("jobId")
    )
    return lifecycle.unpublished_jobs(derive.jobs(spark, folder), sent)


@query("""WITH a AS (SELECT user_id || '-' || (event_id % 5) AS job_id,
                   count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY ALL)
SELECT job_id, failures, failures >= 5 AS exhausted,
       CASE WHEN failures < 5 THEN least(CAST(pow(2, failures - 1) AS bigint), 10) END AS wait_seconds
FROM a WHERE failures > 0""")
def retry_state(spark: SparkSession, folder: str) -> DataFrame:
    attempts = table(spark, folder, "events").select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), (F.col("event_id") % 5).cast("string"))
        .alias("job_id"), (F.col("event_type") == "error").alias("failed"),
    )
    return lifecycle.retry_state(attempts)


@query(f"""WITH {JOBS_SQL}, dead AS (
    SELECT CAST(l_orderkey AS varchar) AS id FROM lineitem WHERE l_returnflag = 'R'
    GROUP BY l_orderkey HAVING count(*) >= 3)
SELECT id AS job_id, status AS status_before,
       CASE WHEN status = 'COMPLETED' THEN 'COMPLETED' ELSE 'FAILED' END AS status_after
FROM jobs JOIN dead USING (id)""")
def dead_letter(spark: SparkSession, folder: str) -> DataFrame:
    attempts = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("job_id"),
        (F.col("l_returnflag") == "R").alias("failed"),
    )
    dead = lifecycle.dead_letters(attempts, max_attempts=3)
    return lifecycle.fail_dead_jobs(derive.jobs(spark, folder), dead)


# --- throttling ----------------------------------------------------------------------


@query(BUCKET_SQL)
def token_bucket(spark: SparkSession, folder: str) -> DataFrame:
    return throttle.token_bucket(table(spark, folder, "events"), "event_type", **BUCKET)


@query("""WITH m AS (
    SELECT user_id, event_id, count(*) OVER w AS calls,
           count(*) FILTER (event_type = 'error') OVER w AS failures
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id
                             ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT user_id, event_id, calls, failures, calls >= 5 AND failures * 2 >= calls AS tripped FROM m""")
def rolling_failure_rate(spark: SparkSession, folder: str) -> DataFrame:
    return throttle.rolling_failure_rate(derive.calls(spark, folder), "user_id")


# --- streaming -----------------------------------------------------------------------


@query(f"""WITH {CHECKED}
SELECT job_id AS id, 'COMPLETED' AS status, 4 + CASE WHEN count(reason) > 0 THEN 1 ELSE 0 END AS version,
       count(*) FILTER (reason IS NULL) AS processed_rows, count(reason) AS failed_rows,
       max(source_row_number) AS last_processed_row, count(*) AS total_rows,
       CASE WHEN count(reason) > 0 THEN 'REPORT' ELSE 'NO_ERROR_REPORT' END AS result
FROM checked GROUP BY job_id""")
def stream_import(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs created, uploads confirmed, published twice and imported by the stream."""
    from importflow.streaming.import_stream import (
        ImportHome, confirm_uploads, jobs_now, start_import,
    )

    home = ImportHome(scratch_path(spark, "home"))
    _put_contacts(spark, folder, home.folder("uploads"))
    requests = _contact_jobs(spark, folder).withColumn("submitted_by", F.lit("loader"))
    made = job_ops.create_jobs(requests).withColumn("source_object_key", source_key("org_id", F.col("id")))
    write_table(made, home.folder("jobs"), JOBS)
    asked = spark.read.parquet(home.folder("jobs")).select(F.col("id").alias("job_id"), "org_id")
    for number in (1, 2):       # the second confirmation finds all jobs queued
        confirm_uploads(spark, home, asked, number)
    publish(asked.select(F.col("job_id").alias("jobId")), home.folder("messages"))
    start_import(spark, home, available_now=True).awaitTermination()
    return _stream_results(freeze(jobs_now(spark, home)))


def _put_contacts(spark: SparkSession, folder: str, root: str, kept: Column | None = None) -> None:
    """The contact files at their source keys, those of the orgs for which ``kept`` holds."""
    rows = derive.contacts(spark, folder)
    lines = (rows if kept is None else rows.where(kept)).select(
        F.concat(F.col("c_nationkey").cast("string"), F.lit("/"), "job_id", F.lit("/source.csv")).alias("key"),
        "source_row_number", derive.csv_line(CONTACT_FIELDS).alias("line"),
    )
    headers = lines.where("source_row_number = 1").withColumns({
        "source_row_number": F.lit(0).cast("bigint"), "line": F.lit(",".join(CONTACT_FIELDS)),
    })
    put_objects(lines.unionByName(headers), root, "key", "source_row_number")


def _stream_results(now: DataFrame) -> DataFrame:
    results = job_ops.result_outcome(now).select("id", "result")
    return now.join(results, "id").select(
        "id", "status", F.col("version").cast("int").alias("version"), "processed_rows",
        "failed_rows", "last_processed_row", "total_rows", "result",
    )


@query(f"""WITH {CHECKED}, counted AS (
SELECT job_id AS id, any_value(c_nationkey) % 7 AS kind, count(*) FILTER (reason IS NULL) AS processed_rows,
       count(reason) AS failed_rows, max(source_row_number) AS last_row FROM checked GROUP BY job_id)
SELECT id, 'COMPLETED' AS status, 4 + CASE WHEN failed_rows > 0 THEN 1 ELSE 0 END AS version, processed_rows,
       failed_rows, last_row AS last_processed_row, processed_rows + failed_rows AS total_rows,
       CASE WHEN failed_rows > 0 THEN 'REPORT' ELSE 'NO_ERROR_REPORT' END AS result, 0 AS dead_letters
FROM counted WHERE kind NOT IN (3, 4) AND id NOT LIKE '5-%'
UNION ALL SELECT id, 'FAILED', 3, 0, 0, 0, NULL, 'JOB_FAILED', 1 FROM counted WHERE kind IN (3, 4) OR id LIKE '5-%'""")
def stream_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs whose object goes missing, is a folder of several or cannot be read, beside sound ones: those
    that cannot be read are tried again, then fail through the dead letters; the others are not held up."""
    import time

    from importflow.session import STATE_STORE
    from importflow.streaming.import_stream import (
        ImportHome, append_queued, jobs_now, start_dead_letters, start_import, start_retries,
    )

    home = ImportHome(scratch_path(spark, "home"))
    org = F.col("c_nationkey")
    kind = F.when(org == 5, "unread").when(org % 7 == 3, "missing").when(org % 7 == 4, "several").otherwise("sound")
    _put_contacts(spark, folder, home.folder("uploads"), kind == "sound")
    broken = _contact_jobs(spark, folder)
    several = broken.where(kind == "several").withColumn("part", F.explode(F.array(F.lit("/a.csv"), F.lit("/b.csv"))))
    put_objects(several.select(F.concat("source_object_key", "part").alias("key"), F.lit(0).alias("n"), F.lit("x").alias("line")),
                home.folder("uploads"), "key", "n")
    unread = broken.where(kind == "unread").withColumn("source_object_key", F.concat("source_object_key", F.lit(".gz")))
    put_objects(unread.select(F.col("source_object_key").alias("key"), F.lit(0).alias("n"), F.lit("no archive").alias("line")),
                home.folder("uploads"), "key", "n")
    requests = _contact_jobs(spark, folder).withColumn("submitted_by", F.lit("loader"))
    ending = F.when(F.col("org_id") == "5", ".gz").otherwise("")
    made = job_ops.create_jobs(requests).withColumn(
        "source_object_key", F.concat(source_key("org_id", F.col("id")), ending))
    write_table(made, home.folder("jobs"), JOBS)
    append_queued(spark, home, spark.read.parquet(home.folder("jobs")).select(F.col("id").alias("job_id")), 1)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    retries = None
    try:
        start_import(spark, home, available_now=True).awaitTermination()
        retries = start_retries(spark, home, max_attempts=2, initial_s=0.1)
        until = time.monotonic() + 120
        while time.monotonic() < until and retries.isActive:
            start_import(spark, home, available_now=True).awaitTermination()     # takes what was published again
            start_dead_letters(spark, home, available_now=True).awaitTermination()
            if not jobs_now(spark, home).where("status NOT IN ('COMPLETED', 'FAILED')").take(1):
                break
    finally:
        if retries is not None:
            retries.stop()
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    dead = spark.read.schema("jobId string").json(home.folder("dead_letters")).groupBy(F.col("jobId").alias("id")).count()
    letters = F.coalesce("count", F.lit(0)).cast("int").alias("dead_letters")
    found = _stream_results(freeze(jobs_now(spark, home)))
    return found.join(dead, "id", "left").select(*found.columns, letters)


def _run_stream(stream: DataFrame, name: str) -> str:
    """Run a stateful stream to its end, one folder per micro-batch."""
    from importflow.session import STATE_STORE

    spark = stream.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    out = scratch_path(spark, name)
    try:
        (
            stream.writeStream.outputMode("update").trigger(availableNow=True)
            .option("checkpointLocation", f"{out}/checkpoint")
            .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/rows/batch={n}"))
            .start().awaitTermination()
        )
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return f"{out}/rows"


@query(BUCKET_SQL)
def stream_token_bucket(spark: SparkSession, folder: str) -> DataFrame:
    from importflow.streaming.stateful import stream_token_bucket as decide

    events = table_stream(spark, folder, "events.parquet", table(spark, folder, "events").schema)
    rows = _run_stream(decide(events, "event_type", **BUCKET), "bucket")
    return spark.read.parquet(rows).drop("batch")


@query(FINAL_STATE_SQL)
def stream_job_state(spark: SparkSession, folder: str) -> DataFrame:
    from importflow.streaming.stateful import JOB_ROW, stream_job_states

    events = table_stream(spark, folder, "events.parquet", table(spark, folder, "events").schema)
    rows = _run_stream(stream_job_states(derive.log_of(events)), "states")
    latest = spark.read.parquet(rows).groupBy("job_id").agg(
        F.max(F.struct("batch", *[c for c in JOB_ROW.names if c != "job_id"])).alias("s")
    )
    return latest.select("job_id", "s.*").drop("batch")
