"""Compares a query with its DuckDB SQL: row count, column names, and values without regard to order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def oracle(sf_dir: str):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, bool) or v is None:
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return float(v) if isinstance(v, int) or type(v).__name__ == "Decimal" else v


def compare(got, con, sql: str) -> None:
    want = con.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    rows = lambda data, cols: sorted((tuple(plain(r[cols.index(n)]) for n in names) for r in data), key=repr)
    a, b = rows([tuple(r) for r in got.collect()], got.columns), rows(want.fetchall(), want.columns)
    assert len(a) == len(b), (len(a), len(b))
    assert a == b, next((x, y) for x, y in zip(a, b, strict=True) if x != y)
