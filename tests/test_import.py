import os

import pytest
from pyspark.sql import functions as F

from importflow.operators import ledger, progress, report
from importflow.sources import uploads as uploads_module
from importflow.operators.validate import validate
from importflow.plans import importer
from importflow.plans.importer import import_files

HEADER = "email,first_name,last_name,phone\n"
FIVE = HEADER + "a@x.co,A,A,\nb@x.co,B,B,\n,C,C,\nd@x.co,D,D,\ne@x.co,E,E,"


def _upload_of(files):
    return files.withColumn("job_id", F.element_at(F.split("file_path", "/"), -2))


def run(spark, uploads, root, batch=0, **kw):
    out = import_files(spark, root, uploads.pattern, _upload_of, batch, **kw)
    return {r["job_id"]: (r["status"], r["failed_row"]) for r in out.collect()}


def counters(spark, root):
    rows = ledger.read_progress(spark, root).groupBy("job_id").agg(
        F.sum("valid_rows"), F.sum("invalid_rows"), F.max("last_row")).collect()
    return {r[0]: tuple(r[1:]) for r in rows}


def stored(spark, root):
    return sorted(map(tuple, ledger.read_ledger(spark, root).drop("batch_id").collect()), key=repr)


def test_counters_and_report(spark, uploads, tmp_path):
    uploads.put("c", HEADER + "alice@x.co,A,B,+1-555-0100\n,Bob,Jones,\ncarol@x.co,C,D,\n"
                "not-email,Dan,Ray,\nerin@x.co,E,F,555 0199\n")
    uploads.put("g", HEADER + "alice@x.co,A,B,\ncarol@x.co,C,D,\nerin@x.co,E,F,\n")
    root = str(tmp_path / "ledger")
    assert run(spark, uploads, root) == {"c": ("COMPLETED", None), "g": ("COMPLETED", None)}
    assert counters(spark, root) == {"c": (3, 2, 5), "g": (3, 0, 3)}
    rows = ledger.read_ledger(spark, root)
    keys = spark.createDataFrame([("c", "org/c/errors.csv"), ("g", "org/g/errors.csv")],
                                 "job_id string, error_report_object_key string")
    assert report.write_reports(ledger.import_errors(rows), keys, str(tmp_path / "reports")) == 1
    assert os.listdir(tmp_path / "reports" / "org") == ["c"]       # neither staged files nor a report of g
    assert (tmp_path / "reports" / "org" / "c" / "errors.csv").read_bytes() == (
        b"row_number,error\r\n2,email is required\r\n4,email is invalid\r\n")


def test_report_in_blocks_and_quoting(spark, tmp_path):
    """One object from many ranges and blocks; a second report takes the place of the first."""
    reasons = {n: f'r{n}, "x"' for n in range(1, 2001)}
    errors = spark.createDataFrame([("j %/é", n, r) for n, r in reasons.items()],
                                   "job_id string, source_row_number bigint, reason string").repartition(7)
    keys = spark.createDataFrame([("j %/é", "a b/c%20+é/errors.csv")], "job_id string, error_report_object_key string")
    root = str(tmp_path / "r")
    lines = report.report_lines(errors).join(keys, "job_id")
    wanted = "row_number,error\r\n" + "".join(f'{n},"r{n}, ""x"""\r\n' for n in reasons)
    for block in (100, 1 << 20):
        assert uploads_module.put_objects(lines, root, "error_report_object_key", "source_row_number", "\r\n", block) == 1
        assert (tmp_path / "r" / "a b" / "c%20+é" / "errors.csv").read_bytes().decode() == wanted
    assert report.write_reports(errors.limit(0), keys, root) == 0
    back = report.read_reports(spark, root).collect()
    assert {r.error_report_object_key for r in back} == {"a b/c%20+é/errors.csv"} and len(back) == 2001


def test_resume_skips_committed_rows(spark, uploads, tmp_path):
    uploads.put("e", FIVE)
    root = str(tmp_path / "ledger")
    begun = spark.createDataFrame(
        [("e", 1, "a@x.co", "A", "A", None), ("e", 2, "b@x.co", "B", "B", None)],
        "job_id string, source_row_number bigint, email string, first_name string, "
        "last_name string, phone string")
    ledger.commit_batch(spark, root, ledger.to_outcomes(validate(begun)), 0)
    run(spark, uploads, root, 1)
    assert counters(spark, root) == {"e": (4, 1, 5)}
    once = stored(spark, root)
    run(spark, uploads, root, 1)        # the same batch again
    assert stored(spark, root) == once
    run(spark, uploads, root, 2)        # a redelivery as a later batch
    assert stored(spark, root) == once and counters(spark, root) == {"e": (4, 1, 5)}


def test_report_spans_the_resume_point(spark, uploads, tmp_path):
    uploads.put("f", HEADER + ",A,A,\nb@x.co,B,B,\n,C,C,\nd@x.co,D,D,\n,E,E,\n")
    root = str(tmp_path / "ledger")
    begun = spark.createDataFrame(
        [("f", 1, None, "A", "A", None), ("f", 2, "b@x.co", "B", "B", None)],
        "job_id string, source_row_number bigint, email string, first_name string, "
        "last_name string, phone string")
    ledger.commit_batch(spark, root, ledger.to_outcomes(validate(begun)), 0)
    run(spark, uploads, root, 1)
    errors = ledger.import_errors(ledger.read_ledger(spark, root))
    assert [r[0] for r in report.errors_in_order(errors, "f").collect()] == [1, 3, 5]
    assert counters(spark, root)["f"] == (2, 3, 5)


def test_crash_before_the_marker(spark, uploads, tmp_path, monkeypatch):
    """Rows written but not committed are not seen, and the retry replaces them."""
    uploads.put("e", FIVE)
    root = str(tmp_path / "ledger")

    def crash(rows):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(ledger, "batch_counts", crash)
        with pytest.raises(RuntimeError):
            run(spark, uploads, root)
    assert stored(spark, root) == [] and counters(spark, root) == {}
    run(spark, uploads, root)
    assert counters(spark, root) == {"e": (4, 1, 5)}


def test_a_replay_hides_nothing_until_it_is_done(spark, uploads, tmp_path):
    uploads.put("e", FIVE)
    root = str(tmp_path / "ledger")
    run(spark, uploads, root)
    before, begun = stored(spark, root), ledger.read_ledger(spark, root)
    fewer = begun.where("source_row_number < 3")
    more = spark.createDataFrame([("e", 3)], "job_id string, expected_rows bigint")
    with pytest.raises(RuntimeError, match="not committed"):
        ledger.commit_batch(spark, root, fewer, 0, more)
    assert stored(spark, root) == before
    ledger.commit_batch(spark, root, fewer, 0)
    assert ledger.read_ledger(spark, root).count() == 2 and begun.count() == len(before)
    ledger.commit_batch(spark, root, fewer, 0)
    assert ledger.read_ledger(spark, root).count() == 2
    assert len(list((tmp_path / "ledger" / "rows" / "batch_id=0").glob("attempt=*"))) == 2


def test_compaction(spark, uploads, tmp_path, monkeypatch):
    root = str(tmp_path / "ledger")
    for batch, name in enumerate("abcd"):
        uploads.put(name, FIVE)
        run(spark, uploads, root, batch)
    before, told = stored(spark, root), counters(spark, root)

    def crash(*args, **kw):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:        # lost before the marker
        m.setattr(ledger, "batch_counts", crash)
        with pytest.raises(RuntimeError):
            ledger.compact(spark, root, 3)
    assert ledger.committed_batches(spark, root) == [0, 1, 2, 3] and stored(spark, root) == before
    real, calls = ledger.file_system, []

    def lose_later(spark, path):
        calls.append(path)
        if "batch_id=0" in path:            # lost before the old folders are gone
            raise RuntimeError("lost")
        return real(spark, path)

    with monkeypatch.context() as m:
        m.setattr(ledger, "file_system", lose_later)
        with pytest.raises(RuntimeError):
            ledger.compact(spark, root, 3)
    assert ledger.committed_batches(spark, root) == [-3, 3]
    assert stored(spark, root) == before and counters(spark, root) == told
    run(spark, uploads, root, 3)            # the last batch can still be replayed
    ledger.compact(spark, root, 4)
    assert ledger.committed_batches(spark, root) == [-4]
    assert stored(spark, root) == before and counters(spark, root) == told


@pytest.mark.parametrize("chunk_rows", [1, 2, 100])
def test_chunked_commits_end_alike(spark, uploads, tmp_path, chunk_rows, monkeypatch):
    uploads.put("e", FIVE)
    uploads.put("g", HEADER + "a@x.co,A,A,\n" * 7)
    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    run(spark, uploads, whole)
    if chunk_rows == 2:     # lost after the second range, then run again
        real, calls = importer.commit_batch, []

        def flaky(*args):
            calls.append(args)
            if len(calls) == 3:
                raise RuntimeError("lost")
            real(*args)

        with monkeypatch.context() as m:
            m.setattr(importer, "commit_batch", flaky)
            with pytest.raises(RuntimeError):
                run(spark, uploads, parts, chunk_rows=chunk_rows)
        assert counters(spark, parts) == {"e": (3, 1, 4), "g": (4, 0, 4)}
    run(spark, uploads, parts, chunk_rows=chunk_rows)
    assert stored(spark, parts) == stored(spark, whole)


def test_poison_rows(spark, uploads, tmp_path):
    row = "a@x.co,A,B,\n"
    uploads.put("long", HEADER + row * 1100 + f"a@x.co,{'x' * 256},B,\n" + row * 10)
    uploads.put("long_invalid", HEADER + row + f",{'x' * 300},B,\n" + row)   # never stored
    uploads.put("broken", HEADER + row * 600 + 'a@x.co,"A"x,B,\n' + row)
    mixed = (row * 2 + ",A,B,\n") * 800      # rows 749, 1499 and 2249 are each a 500th valid one
    uploads.put("mixed", HEADER + mixed + 'a@x.co,"A"x,B,\n')
    uploads.put("fits", HEADER + f"a@x.co,{'x' * 255},B,\n")
    uploads.put("blank_name", "email,,last_name,phone\n" + row)
    root = str(tmp_path / "ledger")
    assert run(spark, uploads, root) == {
        "long": ("FAILED", 1101), "long_invalid": ("COMPLETED", None), "broken": ("FAILED", 601),
        "mixed": ("FAILED", 2401), "fits": ("COMPLETED", None), "blank_name": ("FAILED", 1)}
    assert counters(spark, root) == {
        "long": (1000, 0, 1000), "long_invalid": (2, 1, 3), "broken": (500, 0, 500), "fits": (1, 0, 1),
        "mixed": (1500, 749, 2249)}


def test_one_file_per_job(spark, uploads, tmp_path):
    uploads.put("a", FIVE)
    uploads.put("b", FIVE)
    with pytest.raises(ValueError, match="more than one source file"):
        import_files(spark, str(tmp_path / "l"), uploads.pattern,
                     lambda f: f.withColumn("job_id", F.lit("same")), 0)


def test_insert_if_absent(spark):
    shape = "job_id string, source_row_number bigint, v string"
    there = spark.createDataFrame([("j", 1, "old"), ("j", 2, "old")], shape)
    new = spark.createDataFrame([("j", 2, "x"), ("j", 3, "b"), ("j", 3, "a"), ("k", 1, None)], shape)
    added = ledger.insert_if_absent(new, there, ledger.KEY, ["v"])
    assert sorted(map(tuple, added.collect())) == [("j", 3, "a"), ("k", 1, None)]


def test_a_batch_that_lost_rows_is_not_committed(spark, uploads, tmp_path, monkeypatch):
    uploads.put("e", FIVE)
    root = str(tmp_path / "ledger")
    real = importer.to_outcomes
    with monkeypatch.context() as m:
        m.setattr(importer, "to_outcomes", lambda rows: real(rows).where("source_row_number != 3"))
        with pytest.raises(RuntimeError, match="4 rows written, 5 expected"):
            run(spark, uploads, root)
    assert stored(spark, root) == []


def test_commit_needs_no_shuffle(spark, uploads, tmp_path, monkeypatch):
    uploads.put("e", FIVE)
    plans = []
    real = importer.commit_batch

    def look(spark, root, rows, *rest):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        real(spark, root, rows, *rest)

    monkeypatch.setattr(importer, "commit_batch", look)
    run(spark, uploads, str(tmp_path / "ledger"))
    assert "Exchange hashpartitioning" not in plans[0] and "BroadcastHashJoin" in plans[0]


def test_reconcile_finds_nothing_after_an_import(spark, uploads, tmp_path):
    uploads.put("e", FIVE)
    root = str(tmp_path / "ledger")
    run(spark, uploads, root)
    rows = ledger.read_ledger(spark, root)
    told = ledger.read_progress(spark, root).select(
        F.col("job_id").alias("id"), F.col("valid_rows").alias("processed_rows"),
        F.col("invalid_rows").alias("failed_rows"))
    records, errors = ledger.imported_records(rows), ledger.import_errors(rows)
    assert progress.reconcile(records, errors, told).collect() == []
    assert progress.reconcile(records, errors.limit(0), told).collect()


def test_rows_keep_their_ids_and_times(spark, uploads, tmp_path):
    """A replay repeats the ids, a compaction also the times, and no two rows share an id."""
    uploads.put("e", FIVE)
    root = str(tmp_path / "ledger")

    def rows(times):
        stored_rows = ledger.read_ledger(spark, root, times=True)
        both = [*ledger.record_table(stored_rows).collect(), *ledger.error_table(stored_rows).collect()]
        return sorted((r.id, r.job_id, r.source_row_number, *([r.created_at] if times else [])) for r in both)

    run(spark, uploads, root)
    once = rows(False)
    assert once and len({r[0] for r in once}) == len(once)
    run(spark, uploads, root)
    assert rows(False) == once
    more = ledger.read_ledger(spark, root).where("outcome = 'INVALID'").withColumn(
        "source_row_number", F.col("source_row_number") + 100)
    last = 1 + max(ledger.committed_batches(spark, root))
    ledger.commit_batch(spark, root, more.drop("batch_id"), last)
    before = rows(True)
    ledger.compact(spark, root, last + 1)
    assert rows(True) == before and all(r[3] for r in before) and len({r[3] for r in before}) == 2
