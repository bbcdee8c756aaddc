"""Compare a query with its SQL on DuckDB."""

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if hasattr(x, "isoformat"):
        return x.isoformat()
    if isinstance(x, float):
        return round(x, 6)
    if hasattr(x, "tolist"):
        return str(x.tolist())
    return str(x) if isinstance(x, (list, tuple, dict)) else x


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in found), key=repr)


def duck(sql, sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        if glob.glob(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = con.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


def check(spark, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    mine, theirs = rows(df.columns, [tuple(r) for r in df.collect()]), None
    columns, found = duck(sql, sf_dir)
    theirs = rows(columns, found)
    assert sorted(df.columns) == sorted(columns), (name, sorted(df.columns), sorted(columns))
    assert len(mine) == len(theirs), (name, len(mine), len(theirs))
    for a, b in zip(mine, theirs, strict=True):
        assert a == b, (name, a, b)
    return len(mine)
