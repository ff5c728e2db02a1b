"""Results as sorted rows that can be compared across engines."""

from __future__ import annotations

import math
import os

import duckdb


def plain(x):
    if x is None:
        return None
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if hasattr(x, "as_tuple"):
        return round(float(x), 6)
    if hasattr(x, "asDict"):
        return tuple(plain(v) for v in x)
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return x


def rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=repr)


def duck(folder: str):
    c = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        if f.endswith(".parquet"):
            c.sql(f"create view {f[:-8]} as select * from '{folder}/{f}'")
    return c


def duck_rows(c, sql: str):
    rel = c.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    return [rel.columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=repr)
