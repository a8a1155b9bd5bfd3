import os

import pytest

import __spark_entry__ as entry
from importflow.plans import catalog
from tests.oracle import compare, connect

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_agrees_with_its_sql(spark, con, name):
    result = compare(spark, con, FOLDER, name)
    assert result["same"], result


LARGE = ["import_contacts", "csv_roundtrip", "failed_files", "resume_import", "resume_from_cursor", "cascade_delete",
         "orphan_records", "job_page_deep", "job_decisions", "token_bucket", "rolling_failure_rate"]


@pytest.mark.parametrize("name", LARGE)
def test_ways_for_large_keys_and_tables(spark, con, name, monkeypatch):
    """With tiny limits every key is hot and nothing may be broadcast; results stay the same."""
    from importflow.operators import ordered, skew, throttle
    from importflow.sources import csv_files

    monkeypatch.setattr(ordered, "GROUP_ROWS", 5)
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(skew, "PIECE_ROWS", 4)
    monkeypatch.setattr(throttle, "CHUNK_ROWS", 12)
    monkeypatch.setattr(csv_files, "PRUNE_FILES", 2)
    result = compare(spark, con, FOLDER, name)
    assert result["same"], result


def test_every_query_has_its_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES) <= set(entry.oracle_sql())


def test_flagship(spark):
    assert entry.entry(spark).count() == 25
