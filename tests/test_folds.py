"""Cross-validation facts against brute force, logistic models against separate fits, and leaks."""

from __future__ import annotations

import random
import threading

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.sql import functions as F

from creditspark.operators.ranks import roc_auc
from creditspark.plans import folds as P
from creditspark.plans import modelling as M
from creditspark.session import in_threads

COLUMNS = ["strong", "weak", "gappy", "constant", "empty"]


def _rows(n=360):
    draw = random.Random(4)
    out = []
    for i in range(n):
        y = int(draw.random() < 0.25)
        out.append((i, y if i % 59 else None, y + draw.gauss(0, 0.6), 1000 + 50 * y + draw.gauss(0, 90),
                    None if draw.random() < 0.2 + 0.3 * y else draw.gauss(y, 2), 3.0, None,
                    None if i % 23 == 0 else f"c{draw.randint(0, 30)}", f"unique {i}", "all"))
    return out


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(
        _rows(), "id long, y long, strong double, weak double, gappy double, constant double, empty double, "
                 "kind string, own string, same string").repartition(3).cache()


@pytest.fixture(scope="module")
def rows(frame):
    return P.FoldRows.build(frame, "id", "y", COLUMNS, ["kind"], folds=3, repeats=2)


def test_encodings_leave_out_the_held_out_fold_and_the_row_s_own(frame, rows):
    found = rows.rows.collect()
    kind = {r[0]: r[7] for r in _rows()}
    for s in range(6):
        r, k = divmod(s, 3)
        train = [x for x in found if x.folds[r] != k]
        prior = sum(x.y for x in train) / len(train)
        for row in found[::7]:
            others = [x for x in train if kind[x.id] == kind[row.id] and x.folds[r] != row.folds[r]]
            own = (sum(x.y for x in others) + prior) / (len(others) + 1) if kind[row.id] is not None else prior
            assert row.v[s] == pytest.approx(own, abs=1e-12)


def test_facts_match_each_training_set(rows):
    facts, found = rows.facts(), rows.rows.collect()
    for s in range(6):
        r, k = divmod(s, 3)
        train = [x for x in found if x.folds[r] != k]
        x = np.array([t.x for t in train])
        y = np.array([t.y for t in train])
        known = np.sort(x[:, 2][~np.isnan(x[:, 2])])
        assert facts.medians[s, 2] == known[(len(known) + 1) // 2 - 1]
        assert list(facts.gaps) == [2, 4] and facts.empty[s].tolist() == [False, False, False, False, True]
        n = np.array([(y == 0).sum(), (y == 1).sum()])
        assert facts.weights[s] == pytest.approx(len(y) / (2 * n))
        w = facts.weights[s][y.astype(int)]
        filled = np.where(np.isnan(x[:, 2]), facts.medians[s, 2], x[:, 2])
        mean = np.average(filled, weights=w)
        spread = (w * (filled - mean) ** 2).sum() / (w.sum() - (w ** 2).sum() / w.sum())
        assert facts.mean[s, 2] == pytest.approx(mean) and facts.deviation[s, 2] == pytest.approx(np.sqrt(spread))
        assert facts.deviation[s, 3] == 0 and facts.deviation[s, 4] == 0


def test_logistic_equals_separate_fits(rows):
    classifier = LogisticRegression(labelCol="y", featuresCol=P.FEATURES, weightCol=P.WEIGHT, maxIter=200, regParam=0.01, tol=1e-12)
    got = {(r.id, r.repeat): r.p for r in rows.out_of_fold(classifier).collect()}
    assert len(got) == 2 * rows.rows.count()
    for s in (0, 4):
        alone = rows.held_out(s, classifier.fit(rows.training(s))).collect()
        assert alone and all(got[r.id, r.repeat] == pytest.approx(r.p, abs=2e-5) for r in alone)


def test_penalties_are_fitted_together(rows):
    both = rows.logistic([0.01, 1.0])
    assert both.shape == (2, 6, 1 + 5 + 2 + 1)
    assert both[0] == pytest.approx(rows.logistic([0.01])[0], abs=1e-6)
    assert np.abs(both[1, :, 1:]).sum() < np.abs(both[0, :, 1:]).sum()


def test_held_out_rows_change_nothing(frame, rows):
    """Other values and labels in a fold leave the facts and the model of the set that holds it out as they were."""
    folds = {r.id: r.folds[0] for r in rows.rows.collect()}
    held = F.col("id").isin([i for i, k in folds.items() if k == 0])
    shaken = rows.rows.withColumns({
        "x": F.when(held, F.transform("x", lambda v: v * 7 + 1)).otherwise(F.col("x")),
        "y": F.when(held, 1 - F.col("y")).otherwise(F.col("y"))})
    other = P.FoldRows(shaken, "id", "y", rows.fixed, rows.varying, 3, 2)
    a, b = rows.facts(), other.facts()
    for name in ("weights", "mean", "deviation", "empty"):
        assert getattr(a, name)[0] == pytest.approx(getattr(b, name)[0], abs=1e-9)
    assert np.nan_to_num(a.medians[0]) == pytest.approx(np.nan_to_num(b.medians[0]), rel=5e-3, abs=5e-2)
    assert rows.logistic()[0, 0] == pytest.approx(other.logistic()[0, 0], abs=5e-2)


@pytest.mark.parametrize("name", ["Logistic", "RandomForest"])
def test_random_labels_and_a_value_per_row_give_chance(spark, name):
    classifier = M.classifiers("y", trees=10)[name]
    draw = random.Random(9)
    frame = spark.createDataFrame([(i, int(draw.random() < 0.5), f"own {i}", f"pair {i // 2}") for i in range(2000)],
                                  "id long, y long, own string, pair string")
    scores = P.FoldRows.build(frame, "id", "y", [], ["own", "pair"], folds=3, repeats=1).out_of_fold(classifier)
    assert roc_auc(scores, "p", "y").first().auc == pytest.approx(0.5, abs=0.04)


def test_baseline_has_no_label_leak(spark):
    draw = random.Random(8)
    frame = spark.createDataFrame([(i, int(draw.random() < 0.5), f"own {i}", draw.random()) for i in range(2000)],
                                  "id long, y long, own string, noise double")
    summary = M.baseline(frame, "id", "y", rounds=3, folds=3, repeats=1)[1].first()
    assert summary.overall_auc == pytest.approx(0.5, abs=0.05)


def test_expressions_over_risks(frame):
    made = P.FoldRows.build(frame, "id", "y", ["weak"], folds=2, repeats=1, risks=["kind"], varying={
        "doubled": F.transform("_risk_kind", lambda x: x * 2), "weak": F.transform("_risk_kind", lambda x: F.lit(None).cast("double"))})
    assert made.fixed == [] and made.varying == ["doubled", "weak"]
    assert all(0 <= v <= 2 for r in made.rows.collect() for v in r.v[:2]) and made.rows.first().v[2:] == [0.0, 0.0]


def test_no_columns_one_class_and_no_rows(spark, frame):
    bare = P.FoldRows.build(frame, "id", "y", [], folds=2, repeats=1)
    classifier = LogisticRegression(labelCol="y", featuresCol=P.FEATURES, weightCol=P.WEIGHT, regParam=0.01)
    assert {round(r.p, 6) for r in bare.out_of_fold(classifier).collect()} == {0.5}
    one = P.FoldRows.build(frame.filter("y = 1"), "id", "y", ["strong"], folds=2, repeats=1)
    assert one.out_of_fold(classifier).filter("p < 0.5").isEmpty()


def test_rows_of_one_partition_are_stored_in_several(frame, monkeypatch):
    monkeypatch.setattr(M, "ROWS_PER_TASK", 100)
    one = frame.select("id", "y", "strong", "same").coalesce(1)
    stored, columns, high = M.with_indicators(one, "id", "y", False)
    sizes = [len(part) for part in stored.rdd.glom().collect()]
    assert len(sizes) == 4 and max(sizes) <= 150
    assert columns == ["strong", "same_all"] and high == []
    assert sorted(map(tuple, stored.select("id", "strong").collect())) == sorted(map(tuple, one.select("id", "strong").collect()))
    assert M.with_indicators(one.limit(90), "id", "y", False)[0].rdd.getNumPartitions() == 1


def test_vectors_of_each_training_set(rows):
    facts = rows.facts()
    for s in (1, 5):
        got = sorted(tuple(r[P.FEATURES].toArray()) for r in rows.training(s).collect())
        train = [r for r in rows.rows.collect() if r.folds[s // 3] != s % 3]
        kept = np.where(facts.empty[s], 0.0, facts.medians[s])
        want = []
        for r in train:
            x = np.array(r.x)
            flags = np.isnan(x[facts.gaps]) & facts.flagged[s]
            want.append((*np.where(np.isnan(x), kept, x), *flags.astype(float), r.v[s]))
        assert got == sorted(want)


def test_doubles_read_back_from_their_literals(spark):
    values = [0.1, -2.5e-300, 1e22, 1 / 3, -0.0, 5e-324, float("inf"), float("-inf"), float("nan")]
    found = spark.sql(f"SELECT array({', '.join(P._double(v) for v in values)})").first()[0]
    assert list(map(repr, found)) == list(map(repr, values))


@pytest.mark.parametrize("name", ["RandomForest", "GradientBoosting"])
def test_trees_stay_in_the_jvm_until_asked_for(rows, name, tmp_path):
    model = M.classifiers("y", trees=3, rounds=3)[name].fit(rows.training(0))
    assert rows.held_out(0, model).count() and "trees" not in vars(model)
    assert len(model.trees) == 3
    model.save(f"{tmp_path}/model")
    assert type(model).__base__.load(f"{tmp_path}/model").featureImportances == model.featureImportances


def test_jobs_in_threads_share_no_local_properties(spark):
    context, both = spark.sparkContext, threading.Barrier(2, timeout=60)
    context.setLocalProperty("from_caller", "yes")

    def work(job):
        context.setLocalProperty("job", str(job))
        both.wait()
        return job, context.getLocalProperty("job"), context.getLocalProperty("from_caller")

    assert in_threads(spark, work, range(2)) == [(0, "0", "yes"), (1, "1", "yes")]
    assert in_threads(spark, work, []) == []
    context.setLocalProperty("from_caller", None)
