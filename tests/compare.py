"""Compare the named queries with their SQL counterparts, run by DuckDB on the same files.

``python tests/compare.py [folder] [query ...]`` prints one line per query.
"""

from __future__ import annotations

import decimal
import math
import os
import sys
import time
from typing import Any

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
DEFAULT_FOLDER = "/root/testdata/sf0.01"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')"
        )
    return connection


def plain(value: Any) -> Any:
    """A value in the form both engines share."""
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def table_rows(names: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    """Columns in name order, rows in a fixed order."""
    places = sorted(range(len(names)), key=lambda i: names[i])
    plain_rows = [tuple(plain(row[i]) for i in places) for row in rows]
    keyed = sorted(plain_rows, key=lambda row: [(v is not None, str(v)) for v in row])
    return [names[i] for i in places], keyed


def difference(spark_result, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if both results are the same, else a short description."""
    left_names, left = table_rows(spark_result.columns, spark_result.collect())
    relation = connection.execute(sql)
    names = [d[0] for d in relation.description]
    right_names, right = table_rows(names, relation.fetchall())
    if left_names != right_names:
        return f"columns {left_names} != {right_names}"
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)} rows"
    for a, b in zip(left, right, strict=True):
        if a != b or [type(v) for v in a] != [type(v) for v in b]:
            return f"{a} != {b}"
    return None


def main(arguments: list[str]) -> int:
    import __spark_entry__ as entry
    from lustra import build_session

    folder = arguments[0] if arguments else DEFAULT_FOLDER
    queries, sql = entry.queries(), entry.oracle_sql()
    chosen = arguments[1:] or list(sql)
    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    failures = 0
    for name in chosen:
        started = time.time()
        try:
            found = difference(queries[name](spark, folder), connection, sql[name])
        except Exception as error:
            found = f"{type(error).__name__}: {str(error)[:400]}"
        failures += found is not None
        print(f"{name:28} {time.time() - started:6.2f}s {found or 'same'}"[:700], flush=True)
    print(f"{len(chosen) - failures} of {len(chosen)} the same")
    return int(failures > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
