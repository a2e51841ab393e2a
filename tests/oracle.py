"""Runs a query and its SQL side by side, as the driver does."""

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v + 0.0, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=str)


def differ(con, df, sql):
    """None, or what differs."""
    a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    b = rows_of(rel.columns, rel.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"{len(a[1])} and {len(b[1])} rows"
    for x, y in zip(a[1], b[1], strict=True):
        for p, q in zip(x, y, strict=True):
            if p != q and not (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 2e-6 * max(1, abs(p))):
                return f"{x} and {y}"
    return None


assert glob
