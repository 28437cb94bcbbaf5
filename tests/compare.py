"""Runs a registered query and its SQL side by side."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


def both(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    mine = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    rel = con.sql(sql)
    assert sorted(rel.columns) == sorted(df.columns)
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    return sorted(mine, key=repr), sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
