"""Hold queries against their SQL: same rows, columns by name, floats within a small tolerance."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    r = con.execute(sql)
    names = [c[0] for c in r.description]
    return names, r.fetchall()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "as_tuple"):
        return float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def same(df, sql: str, sf_dir: str) -> str | None:
    """None if equal, else what differs."""
    a, x = rows_of(df.columns, [tuple(r) for r in df.collect()])
    b, y = rows_of(*oracle(sql, sf_dir))
    if a != b:
        return f"columns {a} against {b}"
    if len(x) != len(y):
        return f"{len(x)} rows against {len(y)}"
    for p, q in zip(x, y):
        if p != q and not all(u == v or isinstance(u, (int, float)) and isinstance(v, (int, float)) and math.isclose(u, v, rel_tol=1e-7, abs_tol=1e-9) for u, v in zip(p, q)):
            return f"row {p} against {q}"
    return None
