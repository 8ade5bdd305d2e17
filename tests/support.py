"""Comparing a query with its SQL."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return c


def plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, float):
        return round(x, 9)
    if hasattr(x, "item"):
        return plain(x.item())
    return x


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def same(spark, query, sql: str, sf_dir: str) -> None:
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    found = oracle(sf_dir).execute(sql)
    want = rows_of([c[0] for c in found.description], found.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1]):
        assert a == b
