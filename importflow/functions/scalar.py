"""Scalar column functions; all of them stay inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from importflow.schemas import RETRY_INITIAL_S, RETRY_MAX_S, RETRY_MULTIPLIER

# Everything up to and including the blank, as a trim set.
_LOW_CHARACTERS = "".join(chr(c) for c in range(0x21))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_to_null(c) -> Column:
    """Strip characters <= U+0020 on both sides; nothing left means NULL."""
    return F.nullif(F.btrim(_col(c), F.lit(_LOW_CHARACTERS)), F.lit(""))


def row_hash(email="email", first_name="first_name", last_name="last_name", phone="phone") -> Column:
    """SHA-256 over the four fields; a missing phone still leaves its separator."""
    text = F.concat_ws(
        "|", _col(email), _col(first_name), _col(last_name), F.coalesce(_col(phone), F.lit(""))
    )
    return F.sha2(text, 256)


def row_id(kind: str, job_id="job_id", row_number="source_row_number") -> Column:
    """The id of a record or error by its name, the same in every replay; NULL if a part is.

    An MD5 in the form of a UUID whose version (8) says that its bits are the maker's own.
    """
    name = F.concat(F.lit(f"{kind}/"), _col(job_id), F.lit("/"), _col(row_number).cast("string"))
    digest = F.md5(name)
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-8"), F.substring(digest, 14, 3),
        F.lit("-a"), F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )


def report_key(source_object_key) -> Column:
    """``errors.csv`` beside the source object."""
    key = _col(source_object_key)
    name = F.substring_index(key, "/", -1)
    return F.concat(F.left(key, F.length(key) - F.length(name)), F.lit("errors.csv"))


def source_key(org_id, upload_id: Column | None = None) -> Column:
    return F.concat(
        _col(org_id), F.lit("/"), F.uuid() if upload_id is None else upload_id, F.lit("/source.csv")
    )


def object_key_parts(path) -> Column:
    """(org_id, upload_id, object key) from a full path ending in such a key."""
    parts = F.split(_col(path), "/")
    return F.struct(
        F.try_element_at(parts, F.lit(-3)).alias("org_id"),
        F.try_element_at(parts, F.lit(-2)).alias("upload_id"),
        F.array_join(F.slice(parts, -3, 3), "/").alias("object_key"),
    )


def email_matches(email, wanted: str) -> Column:
    return F.lower(_col(email)) == F.lower(F.lit(wanted))



def clamp(c, low: int, high: int) -> Column:
    return F.least(F.greatest(_col(c), F.lit(low)), F.lit(high))


def page_count(total, size) -> Column:
    return F.ceil(_col(total) / _col(size)).cast("bigint")


def backoff_seconds(
    attempt, initial=RETRY_INITIAL_S, multiplier=RETRY_MULTIPLIER, longest=RETRY_MAX_S
) -> Column:
    """Wait after the given (1-based) failed attempt."""
    grown = F.lit(initial) * F.pow(F.lit(multiplier), _col(attempt) - 1)
    return F.least(grown, F.lit(longest).cast("double")).cast("bigint")


def default_to(c, value) -> Column:
    return F.coalesce(_col(c), value if isinstance(value, Column) else F.lit(value))
