"""Parquet tables of jobs, users and organisations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from importflow.operators.quality import null_counts, require_schema, schema_differences

HELD = {"not_null": True}       # the mark of a column that was written under this rule


def table_problems(df: DataFrame, declared: T.StructType) -> list[str]:
    """Where a table departs from its declaration, NOT NULL among it.

    A column that carries the mark of ``write_table`` holds no NULL.  Those that do not are counted,
    all in one pass.
    """
    problems = schema_differences(df.schema, declared)
    marked = {f.name for f in df.schema.fields if f.metadata.get("not_null")}
    doubtful = [f.name for f in declared.fields if not f.nullable and f.name in set(df.columns) - marked]
    if doubtful:
        held = null_counts(df, doubtful).where("nulls > 0").orderBy("column_name").collect()
        problems += [f"column {r['column_name']} holds {r['nulls']} NULLs, declared NOT NULL" for r in held]
    return problems


def read_table(spark: SparkSession, path: str, declared: T.StructType) -> DataFrame:
    """Open a table and check its shape first, and what is declared NOT NULL."""
    df = spark.read.parquet(path)
    problems = table_problems(df, declared)
    if problems:
        raise ValueError("; ".join(problems))
    return df


def _held(field: T.StructField) -> Column:
    if field.nullable:
        return F.col(field.name)
    refused = F.raise_error(F.lit(f"column {field.name} must not be NULL"))
    value = F.when(F.col(field.name).isNull(), refused).otherwise(F.col(field.name))
    return value.alias(field.name, metadata=HELD)


def write_table(df: DataFrame, path: str, declared: T.StructType, mode: str = "append") -> None:
    """Write the declared columns; a NULL where none may be fails the write, before any row is visible."""
    require_schema(df, declared).select(*map(_held, declared.fields)).write.mode(mode).parquet(path)


def register(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df
