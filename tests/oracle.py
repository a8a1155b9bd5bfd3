"""Compare registered queries with their SQL."""

from __future__ import annotations

import glob
import os
import time

import duckdb

import __spark_entry__ as entry


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    return int(value) if isinstance(value, bool) else value


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(plain, key=repr)


def _missing(rows, other, most=5):
    other = set(map(repr, other))
    return [r for r in rows if repr(r) not in other][:most]


def compare(spark, con, folder: str, name: str) -> dict:
    start = time.time()
    got = entry.queries()[name](spark, folder)
    columns, rows = got.columns, [tuple(r) for r in got.collect()]
    took = time.time() - start
    result = con.execute(entry.oracle_sql()[name])
    wanted_columns = [d[0] for d in result.description]
    wanted = result.fetchall()
    same = sorted(columns) == sorted(wanted_columns) and _sorted(columns, rows) == _sorted(
        wanted_columns, wanted
    )
    return {"name": name, "same": same, "rows": len(rows), "wanted": len(wanted), "sec": took,
            "columns": (sorted(columns), sorted(wanted_columns)),
            "got": _missing(_sorted(columns, rows), _sorted(wanted_columns, wanted)),
            "want": _missing(_sorted(wanted_columns, wanted), _sorted(columns, rows))}
