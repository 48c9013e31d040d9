"""Exact top-k against brute force, with ties, odd vectors, many blocks and large numbers."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditspark.llm import topk

SCHEMA = "vec_id long, embedding array<double>, score long"


def _rows():
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.2, 12).tolist(), 0) for i in range(300)]
    rows += [(300 + i, [0.3] * 12, 0) for i in range(60)]  # one vector many times
    rows += [(400, None, 0), (401, [None, 1.0], 0), (402, [float("nan")], 0), (403, [float("inf")] * 3, 0), (404, [], 0),
             (405, [5.0], 0), (None, [0.4] * 12, 0), (100, [0.1] * 12, 0), (500, [-9.0] * 20, 0)]
    return rows


def _brute(rows, k, divisor):
    known = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows
             if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, v) in enumerate(known):
        if i is None or i % divisor:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), (j is None, j or 0)) for m, (j, w) in enumerate(known) if m != n)
        out += [(i, r + 1, None if none else j, -s) for r, (s, (none, j)) in enumerate(scored[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("rows_at_once, queries_at_once", [(8192, 4096), (50, 3)])
def test_top_k(spark, rows_at_once, queries_at_once):
    table = spark.createDataFrame(_rows(), SCHEMA).repartition(5)
    got = topk.top_k(table, F.col("vec_id") % 20 == 0, 10, rows_at_once=rows_at_once, queries_at_once=queries_at_once)
    assert sorted((tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()), key=str) == _brute(_rows(), 10, 20)


def test_fewer_rows_than_k_and_none(spark):
    table = spark.createDataFrame(_rows()[:4], SCHEMA)
    got = topk.top_k(table, F.col("vec_id") % 2 == 0, 10).collect()
    assert sorted((tuple(r) for r in got), key=str) == _brute(_rows()[:4], 10, 2)
    assert topk.top_k(table.limit(0), F.col("vec_id") % 2 == 0, 10).count() == 0


def test_products_stay_exact():
    big = np.array([[1 << 40, 3], [-(1 << 40), 5]])
    small = np.array([[1 << 20, 1]])
    assert topk.products(big, small).tolist() == [[(1 << 60) + 3], [-(1 << 60) + 5]]
    assert topk.products(big, big)[0, 0] == (1 << 63) - 2  # held at the limit
