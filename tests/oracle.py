"""Run a query in Spark and its SQL in DuckDB and compare the two results."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, int):
        return float(value)
    return str(value)


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if equal, else what differs."""
    names = sorted(df.columns)
    got = [tuple(_plain(r[n]) for n in names) for r in df.select(*names).collect()]
    result = con.sql(sql)
    if sorted(result.columns) != names:
        return f"columns: {names} against {sorted(result.columns)}"
    kinds = dict(zip(result.columns, map(str, result.types)))
    ours = dict(df.dtypes)
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
            "float": "FLOAT"}
    odd = [(n, ours[n], kinds[n]) for n in names if same.get(ours[n]) != kinds[n]]
    at = [result.columns.index(n) for n in names]
    want = [tuple(_plain(r[i]) for i in at) for r in result.fetchall()]
    if len(got) != len(want):
        return f"rows: {len(got)} against {len(want)}"
    got.sort(key=_key), want.sort(key=_key)
    for a, b in zip(got, want):
        if a != b:
            return f"values:\n   {a}\n   {b}"
    return f"types: {odd}" if odd else None
