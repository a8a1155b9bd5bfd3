import random

import pytest
from pyspark.sql import functions as F

from importflow.operators.validate import pick_fields, validate
from importflow.schemas import CONTACT_FIELDS
from importflow.sources import csv_files
from importflow.sources.csv_files import read_contact_files
from tests import plain_csv

HEADER = "email,first_name,last_name,phone\n"


def _upload_of(files):
    return files.withColumn("job_id", F.element_at(F.split("file_path", "/"), -2))


def outcomes(spark, uploads, **kw):
    rows = read_contact_files(spark, uploads.pattern, _upload_of, **kw).rows
    found = {}
    for r in validate(pick_fields(rows)).collect():
        found.setdefault(r["job_id"], {})[r["source_row_number"]] = r
    return found


def test_mixed_file(spark, uploads):
    uploads.put("a", HEADER + (
        "alice@example.com,Alice,Smith,+1 555 123 4567\n,Bob,Jones,555-0000\n"
        "carol@example.com,,Doe,\nnot-an-email,Dan,Ray,\nerin@example.com,Erin,Fox,\n"))
    rows = outcomes(spark, uploads)["a"]
    assert {n: r["reason"] for n, r in rows.items()} == {
        1: None, 2: "email is required", 3: "first_name is required", 4: "email is invalid", 5: None}
    assert len(rows[1]["row_hash"]) == 64 and rows[5]["phone"] is None


def test_every_kind_of_file(spark, uploads):
    uploads.put("wrong_header", "id,name\n1,alice\n")
    uploads.put("other_case", "Email,first_name,last_name,phone\na@b.co,A,B,\n")
    uploads.put("reordered", "phone,last_name,first_name,email\n1234567,L,F,e@x.co,extra\n")
    uploads.put("doubled", "email,first_name,last_name,phone,email\nx,F,L,,second@x.co\n")
    uploads.put("short", HEADER + "a@b.co,A,B\na@b.co\n")
    uploads.put("blanks", HEADER + "\n\na@b.co,A,B,\n   \n\r\nb@b.co,A,B,")
    uploads.put("tabs", HEADER + "\t a@b.co \t, A ,\x01B\x02,\t\n")
    uploads.put("quotes", HEADER + '"a@b.co" ,"A, ""x""", "B",\n')
    uploads.put("phone", HEADER + "a@b.co,A,B,5550199 \n")
    uploads.put("bars", HEADER + "a@b.co,A|,B|C,\n")
    uploads.put("bom", b"\xef\xbb\xbf" + HEADER.encode() + b"a@b.co,A,B,\n")
    uploads.put("bad_bytes", HEADER.encode() + b"a@b.co,A\xffZ,B,\n")
    uploads.put("crlf", HEADER.replace("\n", "\r\n") + "a@b.co,A,B,\r\n")
    uploads.put("cr", HEADER.replace("\n", "\r") + "a@b.co,A,B,\ra@b.co,C,D,\r")
    uploads.put("empty_lines_only", "\n\n")
    uploads.put("header_only", HEADER)
    found = outcomes(spark, uploads)
    reasons = {u: [rows[n]["reason"] for n in sorted(rows)] for u, rows in found.items()}
    short = "malformed row: Index for header '{}' is {} but CSVRecord only has {} values!"
    assert reasons == {
        "wrong_header": ["malformed row: Mapping for email not found, expected one of [id, name]"],
        "other_case": ["malformed row: Mapping for email not found, expected one of "
                       "[Email, first_name, last_name, phone]"],
        "reordered": [None], "doubled": [None],
        "short": [short.format("phone", 3, 3), short.format("first_name", 1, 1)],
        "blanks": [None, short.format("first_name", 1, 1), None],
        "tabs": [None], "quotes": [None], "phone": ["phone is invalid"], "bars": [None], "bom": [None],
        "bad_bytes": [None], "crlf": [None], "cr": [None, None],
    }
    assert found["doubled"][1]["email"] == "second@x.co"
    assert found["tabs"][1]["first_name"] == "A" and found["tabs"][1]["last_name"] == "B"
    assert found["quotes"][1]["first_name"] == 'A, "x"' and found["quotes"][1]["last_name"] == '"B"'
    assert found["bad_bytes"][1]["first_name"] == "A�Z"
    assert found["bars"][1]["row_hash"] == __import__("hashlib").sha256(b"a@b.co|A||B|C|").hexdigest()


def test_files_that_fail(spark, uploads):
    uploads.put("open_quote", HEADER + 'a@b.co,A,B,\nb@b.co,"open,B,\nc@b.co,C,D,\n')
    uploads.put("text_after", HEADER + 'a@b.co,A,B,\nb@b.co,B,C,\nc@b.co,"x"y,D,\n')
    uploads.put("blank_name", "email,,last_name\na,b,c\n")
    uploads.put("open_header", 'email,"first_name\na,b\n')
    uploads.put("sound", HEADER + 'a@b.co,"A\nB",C,\n')
    files = {r["job_id"]: r for r in
             read_contact_files(spark, uploads.pattern, _upload_of).files.collect()}
    assert {k: r["failed_row"] for k, r in files.items()} == {
        "open_quote": 2, "text_after": 3, "blank_name": 1, "open_header": 0, "sound": None}
    assert files["blank_name"]["failed_why"] == "A header name is missing in [email, , last_name]"


def test_a_record_beyond_the_limit_fails_its_file(spark, uploads, monkeypatch):
    monkeypatch.setattr(csv_files, "RECORD_BYTES", 60)
    uploads.put("x", HEADER + 'a@b.co,"A\nB",C,\nb@b.co,"' + "y\n" * 40 + '",C,\nc@b.co,A,B,\n')
    found = read_contact_files(spark, uploads.pattern, _upload_of)
    assert found.files.first()["failed_row"] == 2
    assert found.files.first()["failed_why"] == csv_files.RECORD_TOO_LONG
    assert [r["source_row_number"] for r in found.rows.collect()] == [1]


def test_volume(spark, uploads):
    uploads.put("big", HEADER + "".join(
        f"user{i}@example.com,First{i},Last{i},\n" for i in range(1, 50_001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        rows = validate(pick_fields(read_contact_files(spark, uploads.pattern).rows))
        told = rows.agg(
            F.count_if(F.col("outcome") == "VALID"), F.max("source_row_number"),
            F.count_if(F.col("email") == F.concat(
                F.lit("user"), F.col("source_row_number").cast("string"), F.lit("@example.com"))),
        ).first()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert tuple(told) == (50_000, 50_000, 50_000)


def _random_file(rng: random.Random, quoted: bool) -> str:
    end = rng.choice(["\n", "\r\n", "\n", "\r"])
    parts = [HEADER.strip() + end]
    for _ in range(rng.randrange(0, 30)):
        if rng.random() < 0.1:
            parts.append(rng.choice(["", " "]) + end)
            continue
        fields = []
        for _ in range(rng.choice([4, 4, 4, 3, 5])):
            kind = rng.random()
            if quoted and kind < 0.35:
                inner = "".join(rng.choice(['""', "a", ",", "\n", "\r\n", "\r", " ", "é"])
                                for _ in range(rng.randrange(0, 9)))
                fields.append(f'"{inner}"' + rng.choice(["", "", " "]))
            elif kind < 0.45:
                fields.append(rng.choice(['5" pipe', ' "x"', 'b""c', 'q"']))
            else:
                fields.append("".join(rng.choice("abc@. \té") for _ in range(rng.randrange(0, 9))))
        parts.append(",".join(fields) + end)
    if quoted and rng.random() < 0.15:
        parts.insert(rng.randrange(1, len(parts) + 1), rng.choice(['a,"open', 'a,"x"y,b' + end]))
    return "".join(parts)


@pytest.mark.parametrize("seed,split,few", [(1, 64, False), (2, 200, True), (3, 10_000, False)])
def test_random_files_against_a_plain_reader(spark, uploads, monkeypatch, seed, split, few):
    """Small splits, several blocks per task, quoted line ends across splits."""
    rng = random.Random(seed)
    texts = {f"f{i}": _random_file(rng, quoted=i % 3 != 0) for i in range(60)}
    for name, text in texts.items():
        uploads.put(name, text)
    if few:     # tables too large for broadcast, file list too long for the scan
        monkeypatch.setattr(csv_files, "PRUNE_FILES", 3)
        from importflow.operators import skew
        monkeypatch.setattr(skew, "BROADCAST_ROWS", 5)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0" if seed == 2 else "50")
    try:
        found = read_contact_files(spark, uploads.pattern, _upload_of)
        values = F.transform("tokens", csv_files.unquote).alias("tokens")
        rows = found.rows.select("job_id", "source_row_number", values).collect()
        failed = {r["job_id"]: r["failed_row"] for r in found.files.collect()}
        counted = {r["job_id"]: r["data_rows"] for r in found.files.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = {}
    for r in rows:
        got.setdefault(r["job_id"], {})[r["source_row_number"]] = r["tokens"]
    for name, text in texts.items():
        header, data, broken = plain_csv.read(text)
        wanted = {i + 1: fields for i, fields in enumerate(data)}
        assert got.get(name, {}) == wanted, name
        assert failed[name] == (len(data) + 1 if broken else None), name
        assert broken or counted[name] == len(data), name


def test_columns_are_picked_by_name(spark, uploads):
    uploads.put("x", "last_name,ignored,phone,email,first_name\nL,,1234567,e@x.co,F\n")
    row = pick_fields(read_contact_files(spark, uploads.pattern).rows).first()
    assert [row[f] for f in CONTACT_FIELDS] == ["e@x.co", "F", "L", "1234567"]


def test_splits_are_planned_once(spark, uploads):
    """Rows keep their numbers when the settings that cut files change between the scans."""
    for job in ("a", "b"):
        uploads.put(job, HEADER + "".join(f"u{i}@x.co,{job}{i},L,\n" for i in range(1, 3001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = read_contact_files(spark, uploads.pattern, _upload_of).rows
        for size in ("7000", "100000000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found = pick_fields(rows).select("job_id", "source_row_number", "first_name").collect()
            assert sorted(r["first_name"] for r in found) == sorted(f"{j}{i}" for j in "ab" for i in range(1, 3001))
            assert all(r["first_name"] == f"{r['job_id']}{r['source_row_number']}" for r in found)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("few", [1000, 0])
def test_rows_of_some_files(spark, uploads, tmp_path, few, monkeypatch):
    """A short list of files is read by itself: the others may be gone by then."""
    monkeypatch.setattr(csv_files, "PRUNE_FILES", few)
    for job in ("a", "b", "c"):
        uploads.put(job, HEADER + f'u@x.co,{job},"two\nlines",\n' + "u@x.co,F,L,\n" * 50)
    found = read_contact_files(spark, uploads.pattern, _upload_of)
    if few:
        (tmp_path / "org" / "a" / "source.csv").unlink()
    rows = pick_fields(found.rows_of(found.files.where("job_id = 'b'"))).collect()
    assert {r["job_id"] for r in rows} == {"b"}
    assert sorted(r["source_row_number"] for r in rows) == list(range(1, 52))
    assert [r["last_name"] for r in rows if r["source_row_number"] == 1] == ["two\nlines"]
