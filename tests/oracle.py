"""Compares a query's rows with those of its SQL."""

import glob
import math
import os

import duckdb


def connect(folder):
    c = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, bool | str | int):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.6g}") + 0.0
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def near(a, b):
    if isinstance(a, float | int) and isinstance(b, float | int) and not isinstance(a, bool):
        return math.isclose(a, b, rel_tol=1e-5, abs_tol=2e-6)
    return a == b


def differences(df, cursor):
    """What sets the two apart, in words; empty if nothing does."""
    names = [d[0] for d in cursor.description]
    want, got = rows_of(names, cursor.fetchall()), rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)}, in SQL {sorted(names)}"
    if len(want) != len(got):
        return f"{len(got)} rows, in SQL {len(want)}; first {got[:2]} and {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if not all(map(near, g, w))]
    return f"{len(bad)} rows differ: {bad[:2]}" if bad else ""
