"""Runs a registered query and its SQL on the same tables and compares rows and column names."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def compare(spark, name, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = query(spark, sf_dir)
    rel = con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns), (name, df.columns, rel.columns)
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    at = [rel.columns.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[k]) for k in at) for r in rel.fetchall()), key=key)
    assert len(mine) == len(theirs), (name, len(mine), len(theirs))
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    assert not bad, (name, columns, bad[:3])
    return len(mine)
