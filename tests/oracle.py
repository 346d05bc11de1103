"""Compares a registered query with its SQL on the synthetic tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def connection():
    con = duckdb.connect()
    for name in TABLES:
        path = f"{FOLDER}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(value):
    return round(value, 5) + 0.0 if isinstance(value, float) else value


def assert_equal(spark, con, query, sql):
    df = query(spark, FOLDER)
    names = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names
    assert got == sorted(repr([plain(r[columns.index(c)]) for c in names]) for r in result.fetchall())
