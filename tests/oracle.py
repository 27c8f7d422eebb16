"""Runs a query in Spark and its SQL in DuckDB over the same tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection(sf_dir: str = SF_DIR):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, dict):
        return tuple(sorted((str(k), plain(v)) for k, v in x.items()))
    if hasattr(x, "asDict"):
        return tuple(sorted((k, plain(v)) for k, v in x.asDict().items()))
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    if x.__class__.__name__ == "Decimal":
        return round(float(x), 6)
    return x


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, sql: str, con) -> str:
    """Empty if both have the same rows, else what differs."""
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got == want:
        return ""
    a, b = [x for x in got if x not in set(want)][:3], [x for x in want if x not in set(got)][:3]
    return f"{len(got)} and {len(want)} rows; only Spark {a}; only SQL {b}"
