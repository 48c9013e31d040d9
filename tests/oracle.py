"""Side-by-side comparison of registered queries with their SQL on the same files."""

from __future__ import annotations

import glob
import math
import os
import time

import duckdb


def connect(sf: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple("" if c is None else c for c in r))


def compare(spark, sf, query, sql, con) -> tuple[bool, str]:
    start = time.time()
    df = query(spark, sf)
    left_columns, left = _rows(df.columns, df.collect())
    took = time.time() - start
    found = con.execute(sql)
    right_columns, right = _rows([d[0] for d in found.description], found.fetchall())
    if left_columns != right_columns:
        return False, f"columns {left_columns} / {right_columns}"
    if len(left) != len(right):
        return False, f"rows {len(left)} / {len(right)}"
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    if wrong:
        return False, f"{len(wrong)} of {len(left)} differ, first: {left_columns} {wrong[0]}"
    return True, f"{len(left)} rows, {took:.2f}s"
