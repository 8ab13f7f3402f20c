"""Comparison of a Spark result with DuckDB SQL over the same tables, rows in any order."""

import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, float):
        return None if x != x else round(x, 6)
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


def duck(sql, sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    return sorted(columns), rows(columns, cur.fetchall())


def same(df, sql, sf=SF):
    columns, expected = duck(sql, sf)
    assert sorted(df.columns) == columns
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == expected
