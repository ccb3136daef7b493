"""Runs a query beside its SQL twin."""

import math
import os

import duckdb


def both(spark, sf, name, queries, sql):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries[name](spark, sf)
    rel = con.sql(sql[name])
    assert sorted(got.columns) == sorted(rel.columns), (sorted(got.columns), sorted(rel.columns))
    cols = sorted(got.columns)

    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else v
        if isinstance(v, (list, tuple)):
            return tuple(plain(x) for x in v)
        return v

    a = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=repr)
    at = [rel.columns.index(c) for c in cols]
    b = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    return a, b
