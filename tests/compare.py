"""Run a query and its SQL on the same tables and compare whole results."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def database(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in (row[i] for i in order)) for row in rows]
    return [columns[i] for i in order], sorted(clean, key=lambda row: tuple((v is None, str(type(v)), v) for v in row))


def differences(df, connection, sql: str) -> str:
    """Empty if both sides agree exactly."""
    found = connection.execute(sql)
    names, expected = _rows([d[0] for d in found.description], found.fetchall())
    ours, actual = _rows(df.columns, [tuple(row) for row in df.collect()])
    if ours != names:
        return f"columns {ours} != {names}"
    if len(actual) != len(expected):
        return f"{len(actual)} rows != {len(expected)}"
    wrong = [(a, b) for a, b in zip(actual, expected) if a != b]
    return f"{len(wrong)} of {len(actual)} rows differ, first {wrong[0]}" if wrong else ""
