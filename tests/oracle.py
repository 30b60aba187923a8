"""Compares queries with their SQL in DuckDB, as sets of rows of rounded values."""

from __future__ import annotations

import datetime
import decimal
import glob
import os
from collections import Counter

import duckdb


def plain(v: object) -> object:
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if v != v else round(v, 5) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "tolist"):
        return plain(v.tolist())
    return int(v) if isinstance(v, bool) else v


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        src = p + "/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{src}'")
    return con


def compare(spark, query, sql: str, sf_dir: str, con=None) -> tuple[int, int, list, list]:
    """Rows of both, and up to three rows that only one of them has."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    ours = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    cur = (con or connect(sf_dir)).execute(sql)
    have = [d[0] for d in cur.description]
    assert sorted(have) == names, (sorted(have), names)
    order = [have.index(c) for c in names]
    theirs = Counter(tuple(plain(r[i]) for i in order) for r in cur.fetchall())
    return sum(ours.values()), sum(theirs.values()), list((ours - theirs).elements())[:3], list((theirs - ours).elements())[:3]
