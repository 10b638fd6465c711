"""Runs a query and its oracle SQL and compares rows without regard to order."""

from __future__ import annotations

import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        path = f"{sf_dir}/{name}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{name}") else "")
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    return con


def _value(x):
    if isinstance(x, bool) or x is None:
        return repr(x)
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        y = float(x)
        return "nan" if math.isnan(y) else f"{y:.6g}" if abs(y) < 1e15 else repr(x)
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql, sf_dir):
    """None, or what differs."""
    df = query(spark, sf_dir)
    mine = df.collect()
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    theirs = cur.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows and {len(theirs)} rows"
    a, b = rows_of(df.columns, [tuple(r) for r in mine]), rows_of(columns, theirs)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, first {str(bad[0])[:600]}" if bad else None
