"""Comparing a query with its SQL: rows as sorted plain tuples, columns by name."""

from __future__ import annotations

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(folder) / f"{t}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list:
    """Rows that only one side has, the first few; [] if the two agree."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted((tuple(plain(r[names.index(n)]) for n in order) for r in found.fetchall()), key=str)
    got = sorted((tuple(plain(r[n]) for n in order) for r in df.collect()), key=str)
    return [] if got == want else [x for x in zip(got, want, strict=False) if x[0] != x[1]][:3] or [(len(got), len(want))]
