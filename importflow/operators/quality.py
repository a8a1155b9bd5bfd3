"""Constraint checks: each returns what breaks the rule, so no rows means it holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from importflow.functions import trim_to_null
from importflow.operators.ledger import delete_jobs
from importflow.operators.skew import filter_by_keys
from importflow.operators.validate import EMAIL_PATTERN
from importflow.schemas import CONSTRAINTS, TABLES

# --- fixed values -----------------------------------------------------------------
NOT_BLANK = "must not be blank"
NOT_AN_EMAIL = "must be a well-formed email address"
SHORT_PASSWORD = "password must be at least 8 characters"
PASSWORD_LENGTH = 8
# ----------------------------------------------------------------------------------


def duplicate_keys(df: DataFrame, **keys: Column) -> DataFrame:
    """Key values held by more than one row; keys may be expressions.  NULLs never clash."""
    keyed = df.select(*[e.alias(n) for n, e in keys.items()]).dropna(how="any")
    return (
        keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_with_key"))
        .where(F.col("rows_with_key") > 1)
    )


def orphans(child: DataFrame, foreign: str, parent: DataFrame, primary: str) -> DataFrame:
    """Foreign key values without a parent, and how many rows hold each.

    Counting first leaves one row per value, so a value that a third of the rows share
    weighs no more in the join than any other.
    """
    held = (
        child.where(F.col(foreign).isNotNull()).groupBy(F.col(foreign).alias("missing"))
        .agg(F.count(F.lit(1)).alias("child_rows"))
    )
    return held.join(parent.select(F.col(primary).alias("missing")), "missing", "left_anti")


def orphan_records(
    child: DataFrame, foreign: str, parent: DataFrame, primary: str, by: list[str], **limits
) -> DataFrame:
    """The child rows themselves; ``by`` are columns that tell the rows of one key apart."""
    missing = orphans(child, foreign, parent, primary).select(F.col("missing").alias(foreign))
    return filter_by_keys(child, missing, foreign, by, keep=True, **limits)


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, nulls, all_rows) per column that must not be NULL; one pass."""
    counted = df.agg(
        F.count(F.lit(1)).alias("all_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    )
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in columns
    ])
    return counted.select("all_rows", F.explode(pairs).alias("p")).select(
        "p.column_name", "p.nulls", "all_rows"
    )


def outside_domain(df: DataFrame, domains: dict[str, list[str]]) -> DataFrame:
    """(column_name, value, rows_with_value) for values that are not on the column's list."""
    pairs = F.array(*[
        F.when(~F.col(c).isin(values),
               F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")))
        for c, values in domains.items()
    ])
    return (
        df.select(F.explode(F.array_compact(pairs)).alias("p"))
        .groupBy("p.column_name", "p.value").agg(F.count(F.lit(1)).alias("rows_with_value"))
    )


def too_long_values(df: DataFrame, lengths: dict[str, int], keys: list[str]) -> DataFrame:
    """One row per over-long value: keys, column, its length and the limit."""
    pairs = F.array(*[
        F.when(F.length(c) > n, F.struct(
            F.lit(c).alias("column_name"), F.length(c).alias("value_length"),
            F.lit(n).alias("max_length")))
        for c, n in lengths.items()
    ])
    return df.select(*keys, F.explode(F.array_compact(pairs)).alias("p")).select(*keys, "p.*")


def table_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Every declared constraint checked on the tables given, foreign keys among them.

    Columns a table does not have are not checked.  Returns ``table_name, rule, column_name,
    value, violations``; the value is NULL where a rule is counted per column.
    """
    found = []

    def add(table: str, rule: str, df: DataFrame, column, value, violations: str) -> None:
        found.append(df.select(
            F.lit(table).alias("table_name"), F.lit(rule).alias("rule"),
            (F.lit(column) if isinstance(column, str) else column).alias("column_name"),
            value.cast("string").alias("value"), F.col(violations).cast("bigint").alias("violations"),
        ))

    for name, df in tables.items():
        rules, has = CONSTRAINTS[name], set(df.columns)
        needed = [f.name for f in TABLES[name].fields if not f.nullable and f.name in has]
        nulls = null_counts(df, needed).where("nulls > 0")
        add(name, "NOT NULL", nulls, F.col("column_name"), F.lit(None), "nulls")
        for key in rules["unique"]:
            parts = {f"k{i}": F.expr(e) for i, e in enumerate(key)}
            if not {e.removeprefix("lower(").removesuffix(")") for e in key} <= has:
                continue
            add(name, "UNIQUE", duplicate_keys(df, **parts), ", ".join(key),
                F.concat_ws(", ", *[F.col(p).cast("string") for p in parts]), "rows_with_key")
        for column, parent in rules.get("foreign", {}).items():
            if column in has and parent in tables:
                add(name, "FOREIGN KEY", orphans(df, column, tables[parent], "id"), column,
                    F.col("missing"), "child_rows")
        domains = {c: v for c, v in rules.get("domains", {}).items() if c in has}
        if domains:
            add(name, "CHECK", outside_domain(df, domains), F.col("column_name"), F.col("value"),
                "rows_with_value")
        lengths = {c: n for c, n in rules.get("lengths", {}).items() if c in has}
        if lengths:
            long = too_long_values(df, lengths, []).groupBy("column_name").count()
            add(name, "LENGTH", long, F.col("column_name"), F.lit(None), "count")
    return reduce(DataFrame.unionByName, found)


def cascade_delete(
    jobs: DataFrame, records: DataFrame, errors: DataFrame, deleted: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after the jobs in ``deleted`` (``job_id``) are gone."""
    gone = deleted.select(F.col("job_id").alias("id")).distinct()
    return (
        jobs.join(gone, "id", "left_anti"), delete_jobs(records, deleted), delete_jobs(errors, deleted)
    )


def field_errors(rules: list[tuple[str, Column, str]]) -> Column:
    """Map of field to its first broken rule, fields in rule order.

    A rule is (field, condition that breaks it, message).
    """
    fields = list(dict.fromkeys(field for field, _, _ in rules))
    entries = []
    for field in fields:
        first = reduce(
            lambda chain, rule: chain.when(rule[1], rule[2]) if chain is not None
            else F.when(rule[1], rule[2]),
            [r for r in rules if r[0] == field], None,
        )
        entries.append(F.struct(F.lit(field).alias("key"), first.alias("value")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def registration_errors(organization="organization_name", email="email", password="password") -> Column:
    """Field errors of a registration; the email rule is the contact rows' pattern."""
    def blank(c):
        return trim_to_null(c).isNull()

    return field_errors([
        ("organizationName", blank(organization), NOT_BLANK),
        ("email", blank(email), NOT_BLANK),
        ("email", ~F.col(email).rlike(EMAIL_PATTERN), NOT_AN_EMAIL),
        ("password", blank(password), NOT_BLANK),
        ("password", F.length(password) < PASSWORD_LENGTH, SHORT_PASSWORD),
    ])


def schema_differences(actual: T.StructType, declared: T.StructType) -> list[str]:
    """Where a table's shape departs from the declared one; extra columns are allowed.

    File readers report every column as nullable, so a declared NOT NULL is not compared
    here; ``sources.tables`` marks it on what it writes and checks it at load.
    """
    found = {f.name: f.dataType for f in actual.fields}
    problems = []
    for field in declared.fields:
        if field.name not in found:
            problems.append(f"missing column {field.name}")
        elif found[field.name] != field.dataType:
            problems.append(
                f"column {field.name} is {found[field.name].simpleString()}, "
                f"declared {field.dataType.simpleString()}"
            )
    return problems


def require_schema(df: DataFrame, declared: T.StructType) -> DataFrame:
    problems = schema_differences(df.schema, declared)
    if problems:
        raise ValueError("; ".join(problems))
    return df
