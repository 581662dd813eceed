"""Spark against DuckDB on the same Parquet tables, columns by name, rows in any order."""

import math

import duckdb

from tessera.plans import TABLES


def connect(base):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{base}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if v is not None and v.__class__.__name__ == "Decimal":
        return float(f"{float(v):.9g}")
    return bytes(v) if isinstance(v, bytearray) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, f, sql, base):
    df = f(spark, base)
    rel = con.sql(sql)
    a = rows_of(df.columns, df.collect())
    b = rows_of(list(rel.columns), rel.fetchall())
    assert a[0] == b[0], (a[0], b[0])
    assert len(a[1]) == len(b[1]), (len(a[1]), len(b[1]))
    for x, y in zip(a[1], b[1], strict=True):
        assert x == y, (x, y)
    return len(a[1])
