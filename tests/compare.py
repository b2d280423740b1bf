"""Compare a Spark query with its SQL twin on the same parquet folder."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{root}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _kind(value) -> str:
    if isinstance(value, bool):
        return "bool"
    return type(value).__name__


def _norm(value):
    if isinstance(value, float):
        return None if math.isnan(value) else f"{value:.6g}" if abs(value) > 1e6 else round(value, 6) + 0.0
    return value


def difference(spark_df, con, sql: str) -> str | None:
    """None when both sides hold the same bag of rows under the same column names."""
    rel = con.sql(sql)
    ours, theirs = sorted(spark_df.columns), sorted(rel.columns)
    if ours != theirs:
        return f"columns {ours} != {theirs}"
    left = [tuple(_norm(r[c]) for c in ours) for r in spark_df.collect()]
    at = [rel.columns.index(c) for c in ours]
    right = [tuple(_norm(r[i]) for i in at) for r in rel.fetchall()]
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    if not left:
        return "no rows on either side"
    key = lambda row: tuple((x is None, str(x)) for x in row)
    for a, b in zip(sorted(left, key=key), sorted(right, key=key)):
        if a != b:
            return f"{ours}: {a} != {b}"
        kinds = [(x, y) for x, y in zip(map(_kind, a), map(_kind, b)) if x != y]
        if kinds:
            return f"{ours}: types {kinds} in {a} / {b}"
    return None
