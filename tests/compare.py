"""Runs registered queries in Spark and DuckDB and compares the rows."""

from __future__ import annotations

import math
from datetime import datetime

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(value):
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_cell(r[i]) for i in order) for r in rows),
        key=lambda r: tuple((x is not None, str(type(x)), str(x)) for x in r),
    )


def compare(spark, con, fn, sql, sf_dir):
    """None when equal, else a short description of the difference."""
    got = fn(spark, sf_dir)
    mine = _rows(got.columns, [tuple(r) for r in got.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = _rows(names, cur.fetchall())
    if sorted(got.columns) != sorted(names):
        return f"columns {sorted(got.columns)} vs {sorted(names)}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} vs {len(theirs)}: {mine[:2]} {theirs[:2]}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"{sorted(names)}\n  spark {a}\n  duck  {b}"
    if not mine:
        return "empty on both sides"
    return None
