"""Run a registered query and its checking SQL and compare the rows."""

from __future__ import annotations

import math

import duckdb

from fathom.catalog.standins import BASE_TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _kind(arrow_type) -> str:
    return str(arrow_type).replace("large_", "")


def _text(value) -> str:
    if value is None:
        return "<null>"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def _rows(table):
    names = sorted(table.column_names)
    columns = [[_text(v) for v in table[n].to_pylist()] for n in names]
    return names, sorted(zip(*columns)) if columns else []


def difference(df, con, sql: str) -> str | None:
    """``None`` if both give the same columns and rows, else what differs."""
    left = df.toArrow()
    right = con.sql(sql).to_arrow_table()
    left_names, left_rows = _rows(left)
    right_names, right_rows = _rows(right)
    if left_names != right_names:
        return f"columns {left_names} != {right_names}"
    kinds = [
        (n, _kind(left.schema.field(n).type), _kind(right.schema.field(n).type))
        for n in left_names
        if _kind(left.schema.field(n).type) != _kind(right.schema.field(n).type)
    ]
    if kinds:
        return f"types {kinds}"
    if len(left_rows) != len(right_rows):
        return f"rows {len(left_rows)} != {len(right_rows)}"
    wrong = [(a, b) for a, b in zip(left_rows, right_rows) if a != b]
    return f"{len(wrong)} of {len(left_rows)} rows, first {wrong[0]}" if wrong else None
