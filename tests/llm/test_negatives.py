"""Hard negatives against brute force: ties, copies, odd vectors, deep trees and small slabs; and the tree's ranges."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditspark.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, score long, leaf int"


def _rows():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 0.25, (12, 6))
    rows = [(i, (centres[rng.integers(0, 12)] + rng.normal(0, 0.05, 6)).tolist(), int(rng.integers(0, 4))) for i in range(500)]
    rows += [(500 + i, [0.3] * 6, i % 2) for i in range(90)]  # one vector many times, in two classes
    rows += [(600, None, 1), (601, [None, 1.0], 1), (602, [float("nan")], 1), (603, [float("inf")] * 3, 1), (604, [], 1),
             (605, [0.5], 2), (606, [0.2] * 6, None), (None, [0.4] * 6, 3), (20, [0.1] * 6, 1), (640, [0.3] * 6, 9), (660, [-2.0] * 9, 2)]
    return [(*r, 3, 4) for r in rows]


def _brute(rows, divisor, positives=5, count=5, part=4, of=5):
    known = [(i, [math.floor(256 * x) for x in v], c) for i, v, c, *_ in rows
             if c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, v, c) in enumerate(known):
        if i is None or i % divisor:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), (j is None, j or 0), d == c) for m, (j, w, d) in enumerate(known) if m != n),
                        key=lambda x: x[:2])
        unknown = lambda x: None if x[0] else x[1]
        for score, positive, _ in [x for x in scored if x[2]][:positives]:
            hard = [x for x in scored if not x[2] and part * -score <= of * -x[0] <= of * -score][:count]
            out += [(i, unknown(positive), r + 1, unknown(x[1]), -score, -x[0]) for r, x in enumerate(hard)]
    return Counter(out)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(4).cache()


@pytest.mark.parametrize("options", [
    {}, {"leaf_rows": 4, "slab_rows": 16, "block_rows": 3}, {"leaf_rows": 1, "sample": 40, "slab_rows": 5}, {"sample": 1}])
def test_against_brute_force(table, options):
    got = negatives.mine(table, F.col("vec_id") % 20 == 0, **options)
    assert Counter(tuple(r) for r in got.collect()) == _brute(_rows(), 20)


def test_other_counts_and_share(table):
    got = negatives.mine(table, F.col("vec_id") % 20 == 0, positives=2, negatives=3, share=(1, 2), leaf_rows=8)
    assert Counter(tuple(r) for r in got.collect()) == _brute(_rows(), 20, 2, 3, 1, 2)


def test_no_rows_no_anchors_few_rows(spark, table):
    assert negatives.mine(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert negatives.mine(table, F.lit(False)).count() == 0
    few = spark.createDataFrame(_rows()[:3], SCHEMA)
    assert Counter(tuple(r) for r in negatives.mine(few, F.lit(True)).collect()) == _brute(_rows()[:3], 1)


def test_huge_components_stay_exact(spark):
    rows = [(0, [1e10, 1.0], 1, 0, 0), (1, [1e3, 1.0], 1, 0, 0), (2, [9e2, 2.0], 2, 0, 0), (3, [1.0, 1.0], 1, 0, 0), (4, [1.0, 0.9], 2, 0, 0)]
    got = negatives.mine(spark.createDataFrame(rows, SCHEMA), F.lit(True))
    assert Counter(tuple(r) for r in got.collect()) == _brute(rows, 1)


def test_tree_passes_by_leaves_but_never_a_row_in_a_window():
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 60, (40, 8))
    rows = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(0, 4, (4000, 8))).astype(np.int64)
    longest = float(np.sqrt((rows.astype(float) ** 2).sum(1).max()))
    tree, ranges = negatives.Tree(rows[:300], 2, longest), {}
    leaf = tree.place(negatives.lift(rows, longest), ranges)
    tree.set_ranges([(n, c, list(r[0]), list(-r[1])) for (n, c), r in ranges.items()])
    anchors = rows[::40]
    scores = anchors @ rows.T
    best = np.sort(scores, 1)[:, -6]
    alive = tree.meets(anchors, np.stack([best, (best * 0.99).astype(np.int64)], 1), np.stack([best + 1, best], 1))
    inside = ((scores >= best[:, None]) & (scores <= best[:, None] + 1)) | ((scores >= (best * 0.99).astype(np.int64)[:, None]) & (scores <= best[:, None]))
    for n, found in enumerate(inside):
        assert alive[n][leaf[found]].all()
    assert alive.mean() < 0.5 < len(np.unique(leaf)) / tree.leaves


def test_best_of_keeps_ties_in_column_order():
    scores, allowed = np.array([[5, 5, 1, 5, 9], [0, 0, 0, 0, 0]]), np.array([[1, 1, 1, 1, 0], [0, 0, 0, 0, 0]], bool)
    row, column = negatives.best_of(scores, allowed, 2)
    assert row.tolist() == [0, 0] and column.tolist() == [0, 1]
