"""Run a query and its SQL twin on the same files and compare the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def _rows(rows, order):
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def differences(df, con, sql: str) -> str | None:
    """None when equal, else a short description."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    expected = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    got = [tuple(r) for r in df.collect()]
    if len(got) != len(expected):
        return f"{len(got)} rows != {len(expected)}"
    cols = sorted(names)
    a = _rows(got, [df.columns.index(c) for c in cols])
    b = _rows(expected, [names.index(c) for c in cols])
    for x, y in zip(a, b):
        if x != y:
            bad = [(c, p, q) for c, p, q in zip(cols, x, y) if p != q or type(p) is not type(q)]
            return f"first difference: {str(bad)[:600]}"
    return None
