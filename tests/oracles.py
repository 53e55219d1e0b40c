"""Comparing queries with their SQL over the small tables."""

import math
import os
from collections import Counter

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return tuple(v) if isinstance(v, list) else v


def compare(spark, con, name, query, sql):
    df = query(spark, SF)
    got = df.collect()
    want = con.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns), name
    order = sorted(columns)
    mine = Counter(tuple(plain(r[c]) for c in order) for r in got)
    theirs = Counter(tuple(plain(r[columns.index(c)]) for c in order) for r in want.fetchall())
    assert mine == theirs, (name, list((mine - theirs).items())[:3], list((theirs - mine).items())[:3])
