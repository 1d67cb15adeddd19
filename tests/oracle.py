"""Comparing a DataFrame with what DuckDB makes of SQL over the same files."""

from __future__ import annotations

import math
import os

import duckdb

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows_of(sql: str, folder: str = SMALL) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        if f.endswith(".parquet"):
            path = f"{folder}/{f}" + ("/*.parquet" if os.path.isdir(f"{folder}/{f}") else "")
            con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{path}')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return names, got.fetchall()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "as_tuple"):
        return float(f"{float(v):.9g}")
    return v


def same(df, sql: str, folder: str = SMALL) -> None:
    names, want = rows_of(sql, folder)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    key = lambda r: [(v is None, str(type(v)), v) for v in r]
    a = sorted(([plain(r[c]) for c in order] for r in df.collect()), key=key)
    at = [names.index(c) for c in order]
    b = sorted(([plain(r[i]) for i in at] for r in want), key=key)
    assert len(a) == len(b), (len(a), len(b), a[:2], b[:2])
    for x, y in zip(a, b, strict=True):
        assert x == y or all(p == q or (isinstance(p, float) and math.isclose(p, q, rel_tol=1e-7, abs_tol=1e-9)) for p, q in zip(x, y, strict=True)), (order, x, y)
