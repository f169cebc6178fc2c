"""Run a query and its SQL for DuckDB and compare them as sorted rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb

DATA = os.environ.get("FOLIOFLOW_DATA", "/root/testdata/sf0.001")


def connection(d: str = DATA):
    c = duckdb.connect()
    for p in glob.glob(f"{d}/*.parquet"):
        name = os.path.basename(p).removesuffix(".parquet")
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "item"):
        return plain(v.item())
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, query, sql, d: str = DATA):
    df = query(spark, d)
    left = rows_of(df.columns, df.collect())
    rel = connection(d).sql(sql)
    right = rows_of(rel.columns, rel.fetchall())
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(left) == len(right)
    bad = [(a, b) for a, b in zip(left, right, strict=True) if a != b]
    assert not bad, bad[:3]
    return dict(df.dtypes), dict(zip(rel.columns, map(str, rel.types), strict=True))
