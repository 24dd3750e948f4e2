"""Comparison of a Spark result with its SQL counterpart in DuckDB."""

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            files = f"{sf}/{t}.parquet" + ("/*.parquet" if os.path.isdir(f"{sf}/{t}.parquet") else "")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{files}')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, int):
        return float(f"{v:.15g}") if abs(v) < 1 << 50 else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v)


def compared(df, con, sql):
    """None, or what differs."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = [dict(zip(names, r)) for r in cur.fetchall()]
    got = [r.asDict() for r in df.collect()]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    key = lambda r: tuple(plain(r[c]) for c in sorted(names))
    a, b = sorted(map(key, got), key=repr), sorted(map(key, want), key=repr)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    odd = [(x, y) for x, y in zip(a, b) if x != y and not all(p == q or (isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, rel_tol=1e-9, abs_tol=1e-9)) for p, q in zip(x, y))]
    return f"{len(odd)} of {len(a)} rows differ ({sorted(names)}): {odd[:3]}" if odd else None
