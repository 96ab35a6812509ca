"""Holds query results against DuckDB on the same Parquet files, without regard to row order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf_dir, t)}.parquet')")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return float(v)
    if hasattr(v, "item"):
        return plain(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    try:
        return round(float(v), 6) if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


def differences(spark_df, con, sql: str) -> str:
    """Empty if both give the same columns and rows."""
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)}, not {sorted(names)}"
    got = [tuple(r[n] for n in sorted(names)) for r in spark_df.collect()]
    place = sorted(range(len(names)), key=lambda k: names[k])
    a = sorted((tuple(map(plain, r)) for r in got), key=repr)
    b = sorted((tuple(plain(r[k]) for k in place) for r in want), key=repr)
    if len(a) != len(b):
        return f"{len(a)} rows, not {len(b)}; only here {[x for x in a if x not in set(b)][:2]}, only there {[x for x in b if x not in set(a)][:2]}"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(bad)} of {len(a)} rows differ: {bad[:2]}" if bad else ""
