"""Order-insensitive comparison of two result sets (Spark vs the oracle)."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v, approx: bool):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}") if approx else v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x, approx) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x, approx)) for k, x in v.items()))
    return v


def rows_of(cols, rows, approx: bool = False) -> Counter:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(norm(r[i], approx) for i in order) for r in rows)


def duck_connect(sf_dir: str):
    import os

    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(df, con, sql: str) -> tuple[bool, str]:
    scols, srows = df.columns, [tuple(r) for r in df.collect()]
    res = con.execute(sql)
    dcols, drows = [d[0] for d in res.description], res.fetchall()
    if sorted(scols) != sorted(dcols):
        return False, f"columns differ: {sorted(scols)} vs {sorted(dcols)}"
    a, b = rows_of(scols, srows), rows_of(dcols, drows)
    if a == b:
        return True, f"{len(srows)} rows"
    return False, f"spark={len(srows)} duck={len(drows)} only-spark={list((a - b).items())[:2]} " \
                  f"only-duck={list((b - a).items())[:2]}"
