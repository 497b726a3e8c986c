"""Comparing a query with its SQL on the same tables."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return db


def plain(value):  # noqa: ANN001, ANN201
    """A value that both engines give alike: floats to nine significant digits."""
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows(names: list[str], records) -> list[tuple]:  # noqa: ANN001
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


def same(df, db: duckdb.DuckDBPyConnection, sql: str) -> None:  # noqa: ANN001
    """Assert equal column names and equal rows, as multisets."""
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    wanted = rows(names, result.fetchall())
    assert sorted(df.columns) == sorted(names)
    got = rows(df.columns, df.collect())
    assert len(got) == len(wanted), (len(got), len(wanted))
    wrong = [(a, b) for a, b in zip(got, wanted, strict=True) if a != b]
    assert not wrong, wrong[:3]
