"""Rows of a Spark query against rows of SQL in DuckDB."""

from pathlib import Path

import duckdb


def connected(folder: Path) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(folder.iterdir()):
        con.sql(f"CREATE VIEW {p.name.removesuffix('.parquet')} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


def assert_same(df, con, sql: str) -> None:
    rel = con.sql(sql)
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(plain(r[k]) for k in at) for r in rel.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert len(got) == len(want)
    assert got == want
