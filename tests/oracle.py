"""Compares a query with its SQL in DuckDB."""

from __future__ import annotations

import decimal
import os

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        at = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}{'/*.parquet' if os.path.isdir(at) else ''}'")
    return con


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, np.generic):
        v = v.item()
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return None if isinstance(v, float) and v != v else v


def sorted_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def check(df, con: duckdb.DuckDBPyConnection, sql: str) -> int:
    """Equal columns and rows, floats to nine digits; returns the number of rows."""
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    want, have = sorted_rows(names, got.fetchall()), sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    assert len(have) == len(want)
    for a, b in zip(have, want):
        assert all(x == y or isinstance(x, float) and isinstance(y, (int, float)) and abs(x - y) <= 1e-9 * max(1, abs(x)) for x, y in zip(a, b)), (a, b)
    return len(have)
