"""Runs a query and its SQL counterpart and compares rows, whatever their order."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "asDict"):
        return tuple(map(plain, v))
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(map(plain, v))
    return v


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def differences(df, con, sql: str) -> list[str]:
    found = con.sql(sql)
    columns, rows = found.columns, found.fetchall()
    if sorted(df.columns) != sorted(columns):
        return [f"columns {sorted(df.columns)} and {sorted(columns)}"]
    order = sorted(columns)
    ours = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in rows), key=repr)
    if len(ours) != len(theirs):
        return [f"{len(ours)} rows and {len(theirs)}"]
    return [f"{a} and {b}" for a, b in zip(ours, theirs, strict=True) if a != b][:3]
