"""Runs the registered queries against their SQL in DuckDB, as multisets of rows."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def compare(spark, query, sql, sf_dir):
    got = query(spark, sf_dir)
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    cursor = connection(sf_dir).execute(sql)
    names = [d[0] for d in cursor.description]
    at = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=repr)
    assert sorted(names) == columns
    assert len(rows) == len(want), (len(rows), len(want))
    assert rows == want, next((a, b) for a, b in zip(rows, want) if a != b)
    return len(rows)
