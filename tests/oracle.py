"""Rows of a query and of its DuckDB SQL, made comparable."""

import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, float):
        return None if value != value else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return round(float(value), 9)


def ordered(columns, rows):
    place = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in place) for r in rows), key=repr)


def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def compare(con, sql, df):
    got = ordered(df.columns, df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = ordered(names, cursor.fetchall())
    assert got == want
    return len(got)
