"""Row validation: one pass that routes every record to VALID or INVALID."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from importflow.functions import row_hash, trim_to_null
from importflow.schemas import CONTACT_FIELDS, RECORD_LENGTHS
from importflow.sources.csv_files import unquote

# --- fixed values -----------------------------------------------------------------
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+\z"
PHONE_PATTERN = r"^[+0-9().\-\s]{7,20}\z"
REQUIRED = "{} is required"
INVALID = "{} is invalid"
MALFORMED = "malformed row: "
NO_HEADER = "Mapping for {} not found, expected one of "
TOO_SHORT = "Index for header '{}' is %d but CSVRecord only has %d values!"
# ----------------------------------------------------------------------------------


def email_problem(email: Column) -> Column:
    return F.when(email.isNull(), REQUIRED.format("email")).when(
        ~email.rlike(EMAIL_PATTERN), INVALID.format("email")
    )


def required_problem(value: Column, name: str) -> Column:
    return F.when(value.isNull(), REQUIRED.format(name))


def phone_problem(phone: Column) -> Column:
    return F.when(phone.isNotNull() & ~phone.rlike(PHONE_PATTERN), INVALID.format("phone"))


def malformed_problem() -> Column:
    """First contact field the record cannot supply; needs ``tokens``, ``at_*``, ``header_names``."""
    problems = []
    for name in CONTACT_FIELDS:
        at = F.col(f"at_{name}")
        problems.append(
            F.when(at.isNull(), F.concat(F.lit(NO_HEADER.format(name)), F.col("header_names")))
            .when(at >= F.size("tokens"),
                  F.format_string(TOO_SHORT.format(name), at, F.size("tokens")))
        )
    return F.concat(F.lit(MALFORMED), F.coalesce(*problems))


def pick_fields(rows: DataFrame) -> DataFrame:
    """Named fields from the tokens, plus the ``malformed`` text where there are none."""
    picked = rows.withColumn("malformed", malformed_problem())
    return picked.withColumns(
        {f: unquote(F.get("tokens", F.col(f"at_{f}"))) for f in CONTACT_FIELDS}
    ).drop("tokens", "header_names", *[f"at_{f}" for f in CONTACT_FIELDS])


def validate(rows: DataFrame) -> DataFrame:
    """Add ``outcome``, ``reason`` and ``row_hash``; trim the four fields.

    An optional ``malformed`` column replaces all other checks of its row.
    """
    trimmed = rows.withColumns({f: trim_to_null(f) for f in CONTACT_FIELDS})
    problems = F.concat_ws(
        "; ",
        email_problem(F.col("email")),
        required_problem(F.col("first_name"), "first_name"),
        required_problem(F.col("last_name"), "last_name"),
        phone_problem(F.col("phone")),
    )
    if "malformed" in rows.columns:
        problems = F.coalesce(F.col("malformed"), problems)
    checked = trimmed.withColumn("reason", F.nullif(problems, F.lit(""))).drop("malformed")
    valid = F.col("reason").isNull()
    return checked.withColumns({
        "outcome": F.when(valid, "VALID").otherwise("INVALID"),
        "row_hash": F.when(valid, row_hash()),
    })


def too_long() -> Column:
    """Whether a valid row holds a value the record table has no room for."""
    over = [F.length(f) > RECORD_LENGTHS[f] for f in CONTACT_FIELDS]
    any_over = F.coalesce(over[0], F.lit(False))
    for o in over[1:]:
        any_over = any_over | F.coalesce(o, F.lit(False))
    return (F.col("outcome") == "VALID") & any_over
