"""Rows of a Spark result against rows of DuckDB, columns by name, order free."""

from __future__ import annotations

import glob
from decimal import Decimal
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, Decimal):
        return v.normalize()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(columns: list[str], values) -> list:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


def same(df, con: duckdb.DuckDBPyConnection, sql: str) -> int:
    """Hold the rows against those of the SQL; how many there are."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    got, want = rows(df.columns, df.collect()), rows(names, cur.fetchall())
    assert len(got) == len(want)
    assert got == want
    return len(got)
