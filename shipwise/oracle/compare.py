"""Compare a Spark result with a DuckDB oracle query (row count, columns, values).

Mirrors the correctness gate: columns are sorted by name, rows are compared
as an order-insensitive multiset. Floats are compared exactly unless
``digits`` is given. Used by the tests and by ``scripts/check_oracle.py``.
"""

from __future__ import annotations

import datetime as _dt
import decimal
import math
import os
from collections import Counter

# The driver's table names.
DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v, digits):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        if digits is not None:
            v = round(v, digits)
        return 0.0 if v == 0 else v
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, _dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict(), digits)
    return v


def spark_result(df, digits=None):
    cols = df.columns
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    rows = [tuple(_norm(r[i], digits) for i in order) for r in df.collect()]
    return [cols[i] for i in order], rows


def duck_result(con, sql, digits=None):
    rel = con.sql(sql)
    cols = rel.columns
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    rows = [tuple(_norm(r[i], digits) for i in order) for r in rel.fetchall()]
    return [cols[i] for i in order], rows


def compare(df, con, sql, digits=None, show=5):
    """Return (ok, message)."""
    sc, sr = spark_result(df, digits)
    dc, dr = duck_result(con, sql, digits)
    if sc != dc:
        return False, f"columns differ: spark={sc} duck={dc}"
    if len(sr) != len(dr):
        return False, f"row count differs: spark={len(sr)} duck={len(dr)}"
    a, b = Counter(sr), Counter(dr)
    if a != b:
        only_s = list((a - b).elements())[:show]
        only_d = list((b - a).elements())[:show]
        return False, f"values differ ({len(sr)} rows); spark-only {only_s}; duck-only {only_d}"
    return True, f"{len(sr)} rows match"
