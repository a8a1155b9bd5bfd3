import datetime as dt

import pytest
from pyspark.sql import functions as F, types as T

from importflow import schemas
from importflow.functions import (
    backoff_seconds, clamp, email_matches, object_key_parts, report_key, row_hash, source_key,
    trim_to_null,
)
from importflow.operators import jobs as job_ops, lifecycle, progress, quality
from importflow.operators.validate import validate
from importflow.sources.tables import read_table, register, write_table
from importflow.sources.uploads import get_objects, list_uploads, look_up


def one(spark, column):
    return spark.range(1).select(column).first()[0]


# --- functions and validation --------------------------------------------------------


@pytest.mark.parametrize("text,wanted", [
    ("\t a \n", "a"), ("\x00\x1f a b\x01", "a b"), ("   ", None), ("", None), (None, None),
    ("\u00a0a", "\u00a0a"), ("a\u2028", "a\u2028"),
])
def test_trim_to_null(spark, text, wanted):
    assert one(spark, trim_to_null(F.lit(text))) == wanted


def test_keys_and_waits(spark):
    for key, wanted in {"o/u/source.csv": "o/u/errors.csv", "source.csv": "errors.csv",
                        "a/b/": "a/b/errors.csv", "": "errors.csv"}.items():
        assert one(spark, report_key(F.lit(key))) == wanted
    org, upload, name = one(spark, source_key(F.lit("org"))).split("/")
    assert org == "org" and len(upload) == 36 and name == "source.csv"
    assert tuple(one(spark, object_key_parts(F.lit("s3a://b/o/u/source.csv")))) == (
        "o", "u", "o/u/source.csv")
    waits = [one(spark, backoff_seconds(F.lit(k))) for k in range(1, 7)]
    assert waits == [1, 2, 4, 8, 10, 10]
    assert [one(spark, clamp(F.lit(n), 1, 100)) for n in (-3, 7, 500)] == [1, 7, 100]
    assert one(spark, email_matches(F.lit("Ann@X.co"), "aNN@x.CO"))


def test_hash_keeps_the_last_separator(spark):
    import hashlib

    got = one(spark, row_hash(F.lit("a@b.co"), F.lit("é"), F.lit("x|y"), F.lit(None).cast("string")))
    assert got == hashlib.sha256("a@b.co|é|x|y|".encode()).hexdigest()


@pytest.mark.parametrize("email,ok", [
    ("a@b.co", True), ("a@b", False), ("a b@c.co", False), ("a@@b.co", False), ("a@b.co\n", True),
    ("a@b.c.d", True), ("@b.co", False), ("a@.co", False), ("a@b.", False), ("a@b.co\u2028", True),
])
def test_email_pattern(spark, email, ok):
    df = spark.createDataFrame([(email, "A", "B", None)],
                               "email string, first_name string, last_name string, phone string")
    assert (validate(df).first()["outcome"] == "VALID") == ok


@pytest.mark.parametrize("phone,ok", [
    ("1234567", True), ("123456", False), ("+1 (555) 010-0100", True), ("1" * 20, True),
    ("1" * 21, False), ("555-0100x", False), ("555 0199\u2028", False), ("", True), (None, True),
])
def test_phone_pattern(spark, phone, ok):
    df = spark.createDataFrame([("a@b.co", "A", "B", phone)],
                               "email string, first_name string, last_name string, phone string")
    assert (validate(df).first()["outcome"] == "VALID") == ok


def test_reasons_keep_field_order(spark):
    df = spark.createDataFrame([("x", " ", None, "call"), (None, "A", "B", None)],
                               "email string, first_name string, last_name string, phone string")
    assert [r["reason"] for r in validate(df).collect()] == [
        "email is invalid; first_name is required; last_name is required; phone is invalid",
        "email is required"]


# --- jobs ----------------------------------------------------------------------------


def job_table(spark, rows):
    """rows: (id, org, status, second, report key)"""
    df = spark.createDataFrame(rows, "id string, org_id string, status string, s bigint, "
                                     "error_report_object_key string")
    return df.select(
        "id", "org_id", "status", F.timestamp_seconds("s").alias("created_at"),
        F.timestamp_seconds("s").alias("updated_at"), "error_report_object_key",
        F.lit("CSV_IMPORT").alias("job_type"), F.lit(None).cast("bigint").alias("total_rows"),
        F.lit(0).cast("bigint").alias("processed_rows"), F.lit(0).cast("bigint").alias("failed_rows"),
        F.concat("org_id", F.lit("/"), "id", F.lit("/source.csv")).alias("source_object_key"),
    )


def test_paging(spark):
    jobs = job_table(spark, [(f"j{i}", "a", "QUEUED", i // 2, None) for i in range(5)]
                     + [("x", "b", "QUEUED", 9, None)])
    pages = [[r["id"] for r in job_ops.list_jobs(jobs, "a", p, 2).collect()] for p in range(4)]
    assert pages == [["j4", "j3"], ["j2", "j1"], ["j0"], []]
    assert tuple(job_ops.page_summary(jobs, "a", 1, 2).first()) == (1, 2, 5, 3)
    assert tuple(job_ops.page_summary(jobs, "none").first()) == (0, 20, 0, 0)
    assert job_ops.Page.of(-1, 0) == job_ops.Page(0, 1)
    assert job_ops.Page.of(3, 101) == job_ops.Page(3, 100)


def test_tenants_see_their_own(spark):
    jobs = job_table(spark, [("j", "a", "COMPLETED", 1, None)])
    assert job_ops.find_job(jobs, "j", "a").count() == 1
    assert job_ops.find_job(jobs, "j", "b").count() == 0
    assert job_ops.list_jobs(jobs, "b").count() == 0
    assert job_ops.list_jobs(jobs, "a", status="FAILED").count() == 0
    assert job_ops.public_view(jobs).columns == job_ops.PUBLIC_COLUMNS


def test_result_outcomes(spark):
    jobs = job_table(spark, [
        ("r", "a", "COMPLETED", 1, "k"), ("n", "a", "COMPLETED", 1, None), ("q", "a", "QUEUED", 1, "k"),
        ("p", "a", "PROCESSING", 1, None), ("w", "a", "PENDING", 1, None), ("f", "a", "FAILED", 1, "k")])
    got = {r["id"]: (r["result"], r["report_key"]) for r in job_ops.result_outcome(jobs).collect()}
    assert got == {"r": ("REPORT", "k"), "n": ("NO_ERROR_REPORT", None), "q": ("RESULT_NOT_READY", None),
                   "p": ("RESULT_NOT_READY", None), "w": ("RESULT_NOT_READY", None),
                   "f": ("JOB_FAILED", None)}


def test_admission_against_real_objects(spark, uploads, tmp_path):
    jobs = job_table(spark, [("full", "a", "PENDING", 1, None), ("empty", "a", "PENDING", 1, None),
                             ("missing", "a", "PENDING", 1, None), ("queued", "a", "QUEUED", 1, None),
                             ("done", "a", "COMPLETED", 1, None)])
    uploads.put("full", "x", org="a")
    uploads.put("empty", "", org="a")
    listed = list_uploads(spark, str(tmp_path))
    assert {(r["object_key"], r["length"]) for r in listed.collect()} == {("a/full/source.csv", 1)}
    assert bytes(get_objects(spark, f"{tmp_path}/a/full/source.csv").first()["content"]) == b"x"
    got = {r["id"]: (r["outcome"], r["status_after"]) for r in job_ops.admit_uploads(jobs, listed).collect()}
    assert got == {"full": ("QUEUED", "QUEUED"), "empty": ("UPLOAD_NOT_FOUND", "PENDING"),
                   "missing": ("UPLOAD_NOT_FOUND", "PENDING"), "queued": ("UNCHANGED", "QUEUED"),
                   "done": ("INVALID_JOB_STATE", "COMPLETED")}


def test_created_jobs_have_defaults_and_the_declared_shape(spark, tmp_path):
    requests = spark.createDataFrame([("o1", "u1"), ("o2", "u2")], "org_id string, submitted_by string")
    path = str(tmp_path / "jobs")
    write_table(job_ops.create_jobs(requests), path, schemas.JOBS)
    rows = register(read_table(spark, path, schemas.JOBS), "jobs").orderBy("org_id").collect()
    assert [r["status"] for r in rows] == ["PENDING"] * 2 and rows[0]["version"] == 0
    assert rows[0]["id"] != rows[1]["id"] and rows[0]["total_rows"] is None
    assert rows[0]["source_object_key"].startswith("o1/")
    assert spark.sql("SELECT count(*) FROM jobs").first()[0] == 2


# --- quality -------------------------------------------------------------------------


def test_schema_check(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("x", 1)], "id string, name int").write.parquet(path)
    with pytest.raises(ValueError, match="column name is int, declared string; missing column created_at"):
        read_table(spark, path, schemas.ORGANIZATIONS)
    same = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.IntegerType())])
    assert quality.schema_differences(spark.read.parquet(path).schema, same) == []


def test_not_null_is_held_and_checked(spark, tmp_path):
    shape = "id string, name string, created_at timestamp"
    sound = spark.createDataFrame([("a", "A", dt.datetime(2024, 1, 1))], shape)
    broken = spark.createDataFrame([("b", None, dt.datetime(2024, 1, 1))], shape)
    write_table(sound, f"{tmp_path}/t", schemas.ORGANIZATIONS)
    with pytest.raises(Exception, match="column name must not be NULL"):
        write_table(broken, f"{tmp_path}/t", schemas.ORGANIZATIONS)
    read = read_table(spark, f"{tmp_path}/t", schemas.ORGANIZATIONS)
    assert read.count() == 1 and all(f.metadata for f in read.schema.fields)
    sound.unionByName(broken).write.parquet(f"{tmp_path}/foreign")
    with pytest.raises(ValueError, match="column name holds 1 NULLs, declared NOT NULL"):
        read_table(spark, f"{tmp_path}/foreign", schemas.ORGANIZATIONS)


def test_keys_are_asked_for_by_name(spark, uploads, tmp_path):
    keys = [uploads.put(f"u{i}", "x" * i) for i in range(40)]
    (tmp_path / "org" / "two").mkdir()
    for name in ("a.csv", "b.csv", "_c.csv", "d.txt"):
        (tmp_path / "org" / "two" / name).write_text("xyz")
    found = {k: rest for k, *rest in look_up(spark, str(tmp_path), [*keys, "org/two", "org/none"], "*.csv")}
    assert found == {"org/two": [2, 3], **{k: [int(i > 0), i] for i, k in enumerate(keys)}}


def test_constraints(spark):
    users = spark.createDataFrame([("1", "A@x.co", "ADMIN"), ("2", "a@X.co", "GUEST"), ("3", None, None)],
                                  "id string, email string, role string")
    clash = quality.duplicate_keys(users, email=F.lower("email"))
    assert [tuple(r) for r in clash.collect()] == [("a@x.co", 2)]
    bad = quality.outside_domain(users, {"role": schemas.ROLES})
    assert [tuple(r) for r in bad.collect()] == [("role", "GUEST", 1)]
    nulls = {r["column_name"]: r["nulls"] for r in quality.null_counts(users, ["id", "email"]).collect()}
    assert nulls == {"id": 0, "email": 1}
    long = quality.too_long_values(users, {"email": 5, "role": 32}, ["id"])
    assert sorted(r["id"] for r in long.collect()) == ["1", "2"]


def test_field_errors(spark):
    rows = spark.createDataFrame([("Org", "a@b.co", "long enough"), (" ", None, "short"), (None, "x", "\t")],
                                 "organization_name string, email string, password string")
    got = [r[0] for r in rows.select(quality.registration_errors()).collect()]
    assert got == [
        {}, {"organizationName": "must not be blank", "email": "must not be blank",
             "password": "password must be at least 8 characters"},
        {"organizationName": "must not be blank", "email": "must be a well-formed email address",
         "password": "must not be blank"}]
    assert list(got[1]) == ["organizationName", "email", "password"]


def test_orphan_records(spark):
    child = spark.createDataFrame([(1, i) for i in range(40)] + [(2, 40), (None, 41)], "f int, id int")
    parent = spark.createDataFrame([(2,)], "p int")
    for limits in ({}, {"piece": 5, "broadcast_rows": 0}):
        rows = quality.orphan_records(child, "f", parent, "p", ["id"], **limits)
        assert sorted(r["id"] for r in rows.collect()) == list(range(40))


def test_cascade(spark):
    jobs = spark.createDataFrame([("a",), ("b",)], "id string")
    rows = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "job_id string, source_row_number bigint")
    gone = spark.createDataFrame([("b",), ("b",)], "job_id string")
    left = quality.cascade_delete(jobs, rows, rows, gone)
    assert [df.count() for df in left] == [1, 1, 1]


# --- lifecycle -----------------------------------------------------------------------


def test_claim_gate(spark):
    jobs = spark.createDataFrame([(s, s) for s in schemas.JOB_STATUSES], "id string, status string")
    names = schemas.JOB_STATUSES + ["QUEUED", "unknown", None]
    messages = spark.createDataFrame([(n,) for n in names], "jobId string")
    got = {r["job_id"]: r["decision"] for r in lifecycle.claim_gate(messages, jobs).collect()}
    assert got == {"PENDING": "IGNORE", "QUEUED": "CLAIM", "PROCESSING": "RESUME", "COMPLETED": "IGNORE",
                   "FAILED": "IGNORE", "unknown": "DISCARD"}


def test_retries_and_dead_letters(spark):
    attempts = spark.createDataFrame(
        [("f", True)] * 5 + [("t", True)] * 2 + [("t", False), ("ok", False)] + [("c", True)] * 6
        + [("gone", True)] * 5, "job_id string, failed boolean")
    got = {r["job_id"]: tuple(r)[1:] for r in lifecycle.retry_state(attempts).collect()}
    assert got == {"f": (5, True, None), "t": (2, False, 2), "c": (6, True, None), "gone": (5, True, None)}
    jobs = spark.createDataFrame([("f", "PROCESSING"), ("c", "COMPLETED"), ("t", "PROCESSING")],
                                 "id string, status string")
    after = lifecycle.fail_dead_jobs(jobs, lifecycle.dead_letters(attempts))
    assert {r["job_id"]: r["status_after"] for r in after.collect()} == {"f": "FAILED", "c": "COMPLETED"}


def test_outbox(spark):
    jobs = spark.createDataFrame([("a", "QUEUED"), ("b", "QUEUED"), ("c", "PENDING")], "id string, status string")
    sent = spark.createDataFrame([("a",), ("a",)], "jobId string")
    assert [r["jobId"] for r in lifecycle.unpublished_jobs(jobs, sent).collect()] == ["b"]


def test_transition_table(spark):
    """Each event on each status, reached by the shortest way."""
    ways = {"PENDING": [], "QUEUED": ["CONFIRM"], "PROCESSING": ["CONFIRM", "CLAIM"],
            "COMPLETED": ["COMPLETE"], "FAILED": ["FAIL"]}
    wanted = {
        "CONFIRM": ["QUEUED CHANGED", "QUEUED SAME", "PROCESSING REJECTED", "COMPLETED REJECTED", "FAILED REJECTED"],
        "CONFIRM-": ["PENDING REJECTED", "QUEUED SAME", "PROCESSING REJECTED", "COMPLETED REJECTED", "FAILED REJECTED"],
        "CLAIM": ["PENDING IGNORED", "PROCESSING CHANGED", "PROCESSING SAME", "COMPLETED IGNORED", "FAILED IGNORED"],
        "FLUSH": ["PENDING CHANGED", "QUEUED CHANGED", "PROCESSING CHANGED", "COMPLETED CHANGED", "FAILED CHANGED"],
        "COMPLETE": ["COMPLETED CHANGED", "COMPLETED CHANGED", "COMPLETED CHANGED", "COMPLETED SAME", "COMPLETED CHANGED"],
        "ATTACH": ["PENDING CHANGED", "QUEUED CHANGED", "PROCESSING CHANGED", "COMPLETED CHANGED", "FAILED CHANGED"],
        "FAIL": ["FAILED CHANGED", "FAILED CHANGED", "FAILED CHANGED", "COMPLETED SAME", "FAILED SAME"],
    }
    rows = []
    for event in wanted:
        for status, way in ways.items():
            for n, step in enumerate(way + [event]):
                rows.append((f"{event} {status}", dt.datetime(2024, 1, 1), n, step.rstrip("-"),
                             not step.endswith("-"), 1, 0, 1, n == len(way)))
    log = spark.createDataFrame(rows, "job_id string, ts timestamp, event_id bigint, event string, "
                                "upload_present boolean, valid_rows bigint, invalid_rows bigint, "
                                "last_row bigint, final boolean")
    got = {r["job_id"]: f"{r['status_after']} {r['decision']}"
           for r in lifecycle.log_decisions(log).where("final").collect()}
    assert got == {f"{e} {s}": w for e, ws in wanted.items() for s, w in zip(ways, ws)}


def test_current_jobs_without_log(spark):
    made = job_ops.create_jobs(spark.createDataFrame([("o", "u")], "org_id string, submitted_by string"),
                               F.lit("up"), F.lit("2024-01-01").cast("timestamp"))
    log = spark.createDataFrame([], "job_id string, ts timestamp, event_id bigint, event string, "
                                "upload_present boolean, valid_rows bigint, invalid_rows bigint, last_row bigint")
    now = lifecycle.current_jobs(made, log)
    assert now.columns == made.columns and now.first()["status"] == "PENDING"


def test_report_attachment(spark):
    jobs = spark.createDataFrame([("a", "COMPLETED", "o/a/source.csv"), ("b", "COMPLETED", "o/b/source.csv"),
                                  ("c", "PROCESSING", "o/c/source.csv")],
                                 "id string, status string, source_object_key string")
    counts = spark.createDataFrame([("a", 3, 2, 5), ("c", 1, 0, 1), ("c", 2, 1, 4)],
                                   "job_id string, valid_rows bigint, invalid_rows bigint, last_row bigint")
    got = {r["job_id"]: tuple(r)[2:] for r in progress.job_progress(counts, jobs).collect()}
    assert got == {"a": (3, 2, 5, 5, "o/a/errors.csv"), "b": (0, 0, 0, 0, None),
                   "c": (3, 1, 4, None, "o/c/errors.csv")}
