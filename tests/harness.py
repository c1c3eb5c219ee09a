"""Runs named queries and their SQL counterparts and compares the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def cell(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(cell(v) for v in value)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shaped = [tuple(cell(row[i]) for i in order) for row in rows]
    return sorted(shaped, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, otherwise what differs."""
    result = con.execute(sql)
    want_columns = [c[0] for c in result.description]
    want_types = {c[0]: str(c[1]) for c in result.description}
    want = rows_of(want_columns, result.fetchall())
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(want_columns) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(want_columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, columns {sorted(want_columns)}: {bad[:2]}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = {
        f.name: (f.dataType.simpleString(), want_types[f.name])
        for f in spark_df.schema
        if not _same_kind(kinds.get(f.dataType.simpleString(), f.dataType.simpleString()), want_types[f.name])
    }
    return f"types differ: {odd}" if odd else None


def _same_kind(a: str, b: str) -> bool:
    names = {"STRING": "VARCHAR", "BOOL": "BOOLEAN", "NUMBER": None}
    return names.get(b, b) in (a, None)
