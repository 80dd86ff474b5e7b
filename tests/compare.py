"""Rows of a query and of its SQL twin in DuckDB, in a form that compares."""

from __future__ import annotations

import math
import os

import duckdb


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{file}')")
    return con


def rows_of_spark(df) -> list[tuple]:
    columns = sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)


def rows_of_sql(con: duckdb.DuckDBPyConnection, text: str) -> tuple[list[str], list[tuple]]:
    found = con.execute(text)
    names = [x[0] for x in found.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=str)
