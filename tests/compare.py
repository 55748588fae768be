"""A query's rows against its SQL in DuckDB: same columns, same rows in any order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if value is None or type(value).__name__ in ("NAType", "NaTType"):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return "null" if isinstance(value, float) and math.isnan(value) else str(round(float(value), 6))
    return str(value)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(plain, r)) for r in frame[columns].itertuples(index=False))


def by_sql(folder, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con.sql(sql).df()


def assert_same(frame, folder, sql):
    got, want = rows(frame), rows(by_sql(folder, sql))
    assert got[0] == want[0]
    assert got[1] == want[1]
