"""Runs a query and its SQL on the same tables and compares the rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int | float):
        return None if value != value else round(float(value), 6) + 0.0
    return str(value)


def same(spark, query, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    frame = query(spark, sf_dir)
    names = sorted(frame.columns)
    found = con.sql(sql)
    assert sorted(found.columns) == names
    at = [found.columns.index(n) for n in names]
    key = lambda row: tuple(map(str, row))
    want = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=key)
    got = sorted((tuple(plain(r[n]) for n in names) for r in frame.collect()), key=key)
    assert got == want
