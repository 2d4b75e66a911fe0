"""Order-insensitive comparison of a Spark result with a DuckDB result (test helper)."""

from __future__ import annotations

import datetime as dt
import decimal
import math


def _norm(v, digits: int):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v if digits is None else round(v, digits)
    if isinstance(v, decimal.Decimal):
        return float(v) if digits is None else round(float(v), digits)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, int):
        return float(v) if abs(v) < 2 ** 53 else v
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    try:  # numpy / pandas scalars
        import numpy as np
        if isinstance(v, np.generic):
            return _norm(v.item(), digits)
    except ImportError:  # pragma: no cover
        pass
    return v


def normalize_rows(columns, rows, digits: int = 9):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i], digits) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0)
                                           for x in t))


def spark_rows(df):
    return list(df.columns), [tuple(r) for r in df.collect()]


def duck_rows(con, sql):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return cols, cur.fetchall()


def compare(spark_df, con, sql, digits: int = 9):
    """Return (ok, message)."""
    sc, sr = spark_rows(spark_df)
    dc, dr = duck_rows(con, sql)
    if sorted(sc) != sorted(dc):
        return False, f"columns differ: spark={sc} duck={dc}"
    if len(sr) != len(dr):
        return False, f"row count differs: spark={len(sr)} duck={len(dr)}"
    a = normalize_rows(sc, sr, digits)
    b = normalize_rows(dc, dr, digits)
    for x, y in zip(a, b):
        if x != y:
            return False, f"first differing row: spark={x} duck={y}"
    return True, f"{len(sr)} rows equal"


def duck_connection(sf_dir: str, tables=("region", "nation", "customer", "supplier", "part",
                                         "orders", "lineitem", "events", "documents",
                                         "embeddings", "pages", "benchmark", "labels",
                                         "conversations")):
    import duckdb
    import os
    con = duckdb.connect()
    for t in tables:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con
