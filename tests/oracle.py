"""Compares a query with its SQL, row by row."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in glob.glob(f"{folder}/*.parquet"):
        source = t if os.path.isfile(t) else f"{t}/*.parquet"
        c.execute(f"CREATE VIEW {os.path.basename(t)[:-8]} AS SELECT * FROM '{source}'")
    return c


def cell(v) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, list):
        return str([cell(x) for x in v])
    return "NULL" if v is None else str(v)


def rows_of(df) -> tuple[list[str], list[tuple]]:
    columns = sorted(df.columns)
    return columns, sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())


def rows_of_sql(c: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = c.execute(sql)
    names = [d[0] for d in cursor.description]
    columns = sorted(names)
    return columns, sorted(tuple(cell(r[names.index(k)]) for k in columns) for r in cursor.fetchall())
