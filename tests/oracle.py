"""Compares a query with its SQL on the same tables."""

from __future__ import annotations

import decimal
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(x):
    if isinstance(x, float | decimal.Decimal):
        return f"{float(x):.9g}"
    if isinstance(x, list | tuple):
        return tuple(map(plain, x))
    return x


def compare(spark, sf_dir: str, query, sql: str) -> None:
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    found = connect(sf_dir).sql(sql)
    assert sorted(found.columns) == cols
    at = [found.columns.index(c) for c in cols]
    want = sorted((tuple(plain(r[k]) for k in at) for r in found.fetchall()), key=repr)
    assert got == want
