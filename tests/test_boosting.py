"""Boosted trees grown side by side against separate fits of Spark ML."""

from __future__ import annotations

import random

import numpy as np
import pytest

from creditspark.plans import boosting as B
from creditspark.plans import folds as P
from creditspark.plans import modelling as M
from creditspark.session import materialize


def _frame(spark, n, parts=3):
    draw, rows = random.Random(6), []
    for i in range(n):
        y = int(draw.random() < 0.3)
        rows.append((i, y, y + draw.gauss(0, 0.9), None if draw.random() < 0.2 + 0.2 * y else draw.gauss(y, 2), draw.randint(0, 4) + y,
                     3.0, None, None if i % 23 == 0 else f"c{draw.randint(0, 30)}"))
    return spark.createDataFrame(rows, "id long, y long, strong double, gappy double, few int, constant double, empty double, "
                                       "kind string").repartition(parts, "id")


COLUMNS = ["strong", "gappy", "few", "constant", "empty"]


@pytest.fixture(scope="module")
def rows(spark):
    return P.FoldRows.build(_frame(spark, 700), "id", "y", COLUMNS, ["kind"], folds=3, repeats=2)


def _apart(rows, classifier, sets):
    return {(r.id, r.repeat): r.p for s in sets for r in rows.held_out(s, classifier.fit(rows.training(s))).collect()}


def test_all_sets_together_equal_separate_fits(rows):
    classifier = M.classifiers("y", rounds=6)["GradientBoosting"]
    got = {(r.id, r.repeat): r.p for r in rows.out_of_fold(classifier).collect()}
    assert len(got) == 2 * 700
    alone = _apart(rows, classifier, range(6))
    assert all(got[k] == pytest.approx(p, abs=1e-9) for k, p in alone.items()) and len(alone) == len(got)


def test_draws_are_those_of_spark(spark):
    one = spark._jvm.org.apache.spark.util.random.XORShiftRandom(98)
    start, other = B._states(spark, 90, 8)[7], B._states(spark, 98, 1)[0]
    want = [one.nextDouble() for _ in range(300)]
    assert B.draws(start, 0, 300).tolist() == want and B.draws(other, 0, 1).tolist() != want[:1]
    assert B.draws(start, 37, 20).tolist() == want[37:57] and len(B.draws(start, 5, 0)) == 0


@pytest.mark.parametrize("rows_in_task", [0, 10_000])
def test_trials_of_other_parameters_equal_separate_fits(spark, rows, monkeypatch, rows_in_task):
    classifier = M.classifiers("y", rounds=4)["GradientBoosting"]
    maps = M.sample_params(classifier, {"maxIter": ("int", 2, 5), "maxDepth": ("int", 2, 4), "stepSize": ("log", 0.03, 0.3),
                                        "subsamplingRate": ("uniform", 0.6, 0.95), "minInstancesPerNode": ("int", 1, 30)}, 3)
    monkeypatch.setattr(B, "HISTOGRAMS", 200_000)
    monkeypatch.setattr(B, "ROWS_IN_TASK", rows_in_task)
    found = rows.boosted_scores([classifier.copy(m) for m in maps])
    got = {(r.id, r.repeat): r.p for r in found.collect()}
    for t, params in enumerate(maps):
        alone = _apart(rows, classifier.copy(params), (1, 4))
        assert alone and all(got[k][t] == pytest.approx(p, abs=1e-9) for k, p in alone.items())


@pytest.mark.parametrize("rows_in_task", [0, 10_000])
def test_several_parts_and_counts_by_class(spark, monkeypatch, rows_in_task):
    """Rows of several parts, whose weights come from counts, and samples that start anew in every part."""
    monkeypatch.setattr(P, "ROWS_PER_TASK", 300)
    monkeypatch.setattr(B, "ROWS_IN_TASK", rows_in_task)
    rows = P.FoldRows.build(_frame(spark, 900, 4), "id", "y", ["strong", "gappy"], folds=2, repeats=1)
    rows = P.FoldRows(materialize(rows.rows.repartition(3, "id")), "id", "y", rows.fixed, rows.varying, 2, 1)
    assert rows.training(0).rdd.getNumPartitions() == 2
    base = M.classifiers("y", rounds=3, depth=3)["GradientBoosting"]
    for classifier in (base, base.copy({base.subsamplingRate: 0.7})):
        got = {(r.id, r.repeat): r.p for r in rows.out_of_fold(classifier).collect()}
        alone = _apart(rows, classifier, (0, 1))
        assert np.mean([abs(got[k] - p) < 1e-9 for k, p in alone.items()]) > 0.97


def test_a_search_grows_all_trials_together(rows, monkeypatch):
    seen = []
    monkeypatch.setattr(B, "fit", lambda *args, run=B.fit: (seen.append(len(args[2])), run(*args)))
    space = {"maxIter": ("int", 2, 3), "subsamplingRate": ("uniform", 0.6, 1.0)}
    classifier = M.classifiers("y", rounds=3)["GradientBoosting"]
    _, table = M.search_params(classifier, rows, space, trials=3)
    assert seen == [18] and [r.percent for r in table.collect()] == [100] * 3
    assert not B.grow_together([classifier.copy({classifier.featureSubsetStrategy: "sqrt"})])
    assert not B.grow_together([classifier, classifier.copy({classifier.maxBins: 16})])


def test_no_cuts_and_one_class(spark, rows):
    classifier = M.classifiers("y", rounds=3)["GradientBoosting"]
    frame = _frame(spark, 60)
    flat = P.FoldRows.build(frame, "id", "y", ["constant"], folds=2, repeats=1)
    one = P.FoldRows.build(frame.filter("y = 1"), "id", "y", ["strong"], folds=2, repeats=1)
    for made in (flat, one):
        got = {(r.id, r.repeat): r.p for r in made.out_of_fold(classifier).collect()}
        alone = _apart(made, classifier, (0, 1))
        assert alone and all(got[k] == pytest.approx(p, abs=1e-9) for k, p in alone.items())


def test_best_split_leaves_out_small_sides():
    sums = np.zeros((4, 1, 2, 3))
    sums[:, 0, 0] = [[1, 2, 9], [1, -2, 9], [1, 2, 9], [1, 2, 9]]
    sums[:, 0, 1] = [[6, 6, 0], [5, 3, 0], [6, 6, 0], [6, 6, 0]]
    column, cut, parents, sides = B.best_splits(sums, np.array([3, 2]), None, 1, 0.0)
    assert (column[0], cut[0]) == (0, 1) and parents[:, 0].tolist() == [12, 8, 12, 12]
    assert sides[0, :, 0].tolist() == [3, -1, 3, 3] and sides[1, :, 0].tolist() == [9, 9, 9, 9]
    assert B.best_splits(sums, np.array([3, 2]), None, 4, 0.0)[0][0] == 1
    assert B.best_splits(sums, np.array([3, 2]), None, 7, 0.0)[0][0] == -1
