"""Comparing a Spark result with the answer of DuckDB over the same files."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(value: object) -> object:
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, datetime.date) and not isinstance(value, datetime.datetime):
        return datetime.datetime(value.year, value.month, value.day)
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return value + 0.0
    return value


def canonical(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(plain, key=lambda r: tuple((v is None, str(type(v)), v) if v is not None else (True, "", 0) for v in r))


def oracle_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple], list[str]]:
    cur = con.execute(sql)
    return [c[0] for c in cur.description], cur.fetchall(), [str(c[1]) for c in cur.description]


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """``None`` when both agree, else what differs."""
    names, rows, kinds = oracle_rows(con, sql)
    spark_rows = [tuple(r) for r in df.collect()]
    a_names, a = canonical(df.columns, spark_rows)
    b_names, b = canonical(names, rows)
    if a_names != b_names:
        return f"columns {a_names} vs {b_names}"
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    if wrong:
        shown = [
            {n: (p, q) for n, p, q in zip(a_names, x, y, strict=True) if p != q} for x, y in wrong[:3]
        ]
        return f"{len(wrong)} of {len(a)} rows differ, e.g. {shown}"
    spark_kinds = dict(df.dtypes)
    expected = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
                "TIMESTAMP": "timestamp_ntz"}
    off = {n: (spark_kinds[n], k) for n, k in zip(names, kinds, strict=True) if expected.get(k) != spark_kinds[n]}
    return f"types {off}" if off else None
