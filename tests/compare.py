"""Rows of a query against rows of its SQL, in any order."""

import datetime
import math
from pathlib import Path

import duckdb


def connect(sf: str):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return tuple(map(plain, v))
    if hasattr(v, "asDict"):
        return tuple(map(plain, v.asDict().values()))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return v


def rows(columns, found):
    return sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in found), key=lambda r: tuple((v is None, str(v)) for v in r))


def spark_rows(df):
    return rows(df.columns, df.collect())


def sql_rows(c, sql):
    q = c.sql(sql)
    names = q.columns
    return names, rows(names, [dict(zip(names, r, strict=True)) for r in q.fetchall()])
