from __future__ import annotations

import random

import numpy as np
import pytest

from creditspark.operators.ranks import roc_auc
from creditspark.plans import modelling as M


@pytest.fixture(scope="module")
def separable(spark):
    """One strong column, one weak, one of noise, with gaps; about a fifth in class 1."""
    draw = random.Random(0)
    rows = []
    for i in range(400):
        y = int(draw.random() < 0.2)
        rows.append((i, y, None if i % 17 == 0 else y + draw.gauss(0, 0.35), 0.3 * y + draw.gauss(0, 1),
                     draw.random(), None))
    return spark.createDataFrame(
        rows, "id long, y long, strong double, weak double, noise double, empty double").repartition(2).cache()


COLUMNS = ["strong", "weak", "noise", "empty"]


def trainer(name, **options):
    return M.Trainer(M.classifiers("y", **{"trees": 10, "rounds": 3, "steps": 20, **options})[name], COLUMNS, "y")


def test_training_facts(separable):
    gaps, empty, classes = M.training_facts(separable, COLUMNS, "y")
    assert gaps == ["strong"] and empty == ["empty"] and sum(classes.values()) == 400


def test_class_weights_balance(separable):
    _, _, classes = M.training_facts(separable, COLUMNS, "y")
    sums = M.with_class_weights(separable, "y", classes).groupBy("y").sum("_weight").collect()
    assert [r["sum(_weight)"] for r in sums] == [pytest.approx(200), pytest.approx(200)]


@pytest.mark.parametrize("name", ["GradientBoosting", "RandomForest", "Logistic"])
def test_models_learn_and_rank_the_strong_column_first(separable, name):
    train, validation = M.train_validation(separable, "id")
    model = trainer(name).fit(train)
    scored = model.probability(validation, ["id", "y"])
    assert scored.count() == validation.count()
    assert roc_auc(scored, "p", "y").first().auc > 0.9
    assert model.importances().first().feature == "strong"
    assert "strong__missing" in model.feature_names() and "empty" not in model.feature_names()


def test_cross_validation_scores_every_row_once_per_repeat(separable):
    mean, summary = M.cross_validate(trainer("Logistic"), separable, "id", folds=3, repeats=2)
    assert mean.count() == 400 and mean.select("id").distinct().count() == 400
    row = summary.first()
    assert row.n_folds == 6 and row.overall_auc > 0.9 and row.ci_lower <= row.mean_score <= row.ci_upper
    assert mean.filter("predicted <> cast(p > 0.5 as int)").isEmpty()


def test_fold_scores_match_a_direct_count(separable):
    scores = M.out_of_fold(trainer("Logistic"), separable, "id", folds=2, repeats=1).collect()
    spark = separable.sparkSession
    got = {r.fold: r.auc for r in M.fold_scores(spark.createDataFrame(scores), "y").collect()}
    for fold in (0, 1):
        ones = np.array([r.p for r in scores if r.fold == fold and r.y == 1])
        zeros = np.array([r.p for r in scores if r.fold == fold and r.y == 0])
        wins = (ones[:, None] > zeros[None, :]).mean() + 0.5 * (ones[:, None] == zeros[None, :]).mean()
        assert got[fold] == pytest.approx(wins, abs=1e-12)


def test_random_search_returns_the_best_trial(separable):
    space = {"regParam": ("log", 1e-4, 10.0), "elasticNetParam": ("choice", 0.0, 1.0), "maxIter": ("int", 5, 10)}
    best, trials = M.random_search(trainer("Logistic"), separable, "id", space, trials=3, folds=2)
    assert trials.count() == 3 and trials.agg({"auc": "max"}).first()[0] > 0.9
    # three trials on a quarter of the rows, two on a half, one on all
    assert sorted(r.percent for r in trials.collect()) == [25, 50, 100]
    assert roc_auc(best.probability(separable, ["y"]), "p", "y").first().auc > 0.9
    classifier = trainer("Logistic").classifier
    again = M.sample_params(classifier, space, 3)
    assert again == M.sample_params(classifier, space, 3)
    assert all(5 <= v <= 10 for m in again for p, v in m.items() if p.name == "maxIter")
    with pytest.raises(ValueError):
        M.sample_params(trainer("Logistic").classifier, {"maxIter": ("other", 1)}, 1)


def test_every_trial_is_fitted_on_all_rows_of_all_folds(separable):
    rows = trainer("RandomForest").fold_rows(separable, "id", 3, 1)
    forest = trainer("RandomForest").classifier
    space = {"numTrees": ("int", 3, 6), "maxDepth": ("int", 1, 3)}
    best, table = M.search_params(forest, rows, space, trials=4)
    found = {r.trial: r for r in table.collect()}
    assert [r.percent for r in found.values()] == [100] * 4
    for trial, params in enumerate(M.sample_params(forest, space, 4)):
        alone = M.fold_scores(rows.out_of_fold(forest.copy(params)), "y").collect()
        assert len(alone) == 3 and found[trial].auc == pytest.approx(np.mean([r.auc for r in alone]), abs=1e-9)
    assert M.shown(best) == max(found.values(), key=lambda r: (r.auc, -r.trial)).params


def test_weight_grid_covers_the_simplex():
    grid = M.weight_grid(3, 4)
    assert len(grid) == 15 and len({tuple(w) for w in grid}) == 15
    assert all(sum(w) == pytest.approx(1) and min(w) >= 0 for w in grid)


def test_weight_search_finds_the_better_score(spark):
    draw = random.Random(2)
    rows = [(y, y + draw.gauss(0, 0.5), draw.random()) for y in (0, 1) for _ in range(100)]
    df = spark.createDataFrame(rows, "y int, good double, bad double")
    found = M.weight_search(df, ["good", "bad"], "y", 4).collect()
    assert len(found) == 5 and [r.auc for r in found] == sorted((r.auc for r in found), reverse=True)
    assert found[0].w_good >= 0.5
    lone = [r for r in found if r.w_good == 1.0][0]
    assert lone.auc == pytest.approx(roc_auc(df, "good", "y").first().auc)
    # all candidates tie on one informative column: the most even weights come first
    same = df.select("y", "good", df.good.alias("bad"))
    assert M.best_weights(same, ["good", "bad"], "y", 4)[0] == [0.5, 0.5]


def test_importances_divide_by_all_models(spark, separable):
    model = trainer("RandomForest").fit(separable)
    forest, names = model.model.stages[-1], model.feature_names()
    alone = {r.feature: r.importance for r in M.model_importance([forest], names, spark).collect()}
    half = {r.feature: r.importance for r in M.model_importance([forest, object()], names, spark).collect()}
    assert sum(alone.values()) == pytest.approx(1)
    assert all(half[n] == pytest.approx(alone[n] / 2) for n in names)


def test_forest_and_ensemble_importance(spark, separable):
    from pyspark.sql import functions as F

    rows = separable.withColumn("kind", F.when(F.col("y") == 1, "bad one").otherwise("fine"))
    first = M.forest_importance(rows.drop("strong"), "id", "y", trees=10).first()
    assert first.feature in ("kind_bad_one", "kind_fine")
    assert M.ensemble_importance(separable, "id", "y", 2, 5, 2).first().feature == "strong"


def test_fits_read_stored_vectors_and_samples(spark, separable, monkeypatch):
    seen = []

    class Forest(M.RandomForestClassifier):
        def fit(self, dataset, params=None):
            seen.append(dataset)
            return super().fit(dataset, params)

    monkeypatch.setattr(M, "RandomForestClassifier", Forest)
    trainer("RandomForest").fit(separable)
    M.ensemble_importance(separable, "id", "y", 1, 5, 2)
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in seen]
    assert seen[0].columns == ["y", M.WEIGHT, M.FEATURES] and plans[0].startswith("LogicalRDD")
    assert "md5" not in plans[1]


def test_large_fits_read_few_parts_and_run_few_at_once(spark, separable, monkeypatch):
    assert [M.fit_tasks(n) for n in (0, 20_000, 90_000, 160_000, 900_000, 5_400_000)] == [1, 1, 5, 8, 9, 54]
    assert [M.fits_at_once(n) for n in (0, 900_000, 2_000_000, 50_000_000)] == [8, 8, 4, 2]
    parts, at_once = [], []

    class Forest(M.RandomForestClassifier):
        def fit(self, dataset, params=None):
            parts.append(dataset.rdd.getNumPartitions())
            return super().fit(dataset, params)

    def in_threads(spark, work, jobs, parallelism=8):
        at_once.append(parallelism)
        return run(spark, work, jobs, parallelism)

    run = M.in_threads
    monkeypatch.setattr(M, "RandomForestClassifier", Forest)
    monkeypatch.setattr(M, "in_threads", in_threads)
    monkeypatch.setattr(M, "ROWS_PER_TASK", 20)
    monkeypatch.setattr(M, "ROWS_PER_FIT_TASK", 100)
    monkeypatch.setattr(M, "ROWS_IN_FITS", 1_200)
    wide = separable.repartition(20)
    trainer("RandomForest").fit(wide)
    M.ensemble_importance(wide, "id", "y", 1, 5, 2)
    assert parts == [8, 8] and at_once == [3]


def test_kept_places_of_rows_give_the_same_forest(separable):
    rows = M.as_doubles(separable, [*COLUMNS, "y"])
    found = []
    for cached in (False, True):
        one = M.Trainer(M.RandomForestClassifier(labelCol="y", featuresCol=M.FEATURES, weightCol=M.WEIGHT, numTrees=10,
                                                 seed=M.SEED, cacheNodeIds=cached), COLUMNS, "y")
        found.append(one.fit(rows).model.stages[-1].toDebugString.split("\n", 1)[1])
    assert found[0] == found[1]


def test_baseline_and_score_table(spark, separable):
    mean, summary = M.baseline(separable.drop("empty"), "id", "y", rounds=2, folds=2, repeats=1)
    assert mean.count() == 400 and summary.first().overall_auc > 0.8
    rows = [("a", "post_fe", 0.7), ("a", "post_tuning", 0.75), ("b", "post_fe", 0.6)]
    got = {r.model: (r.post_fe, r.post_tuning) for r in M.score_table(rows, spark).collect()}
    assert got == {"a": (0.7, 0.75), "b": (0.6, None)}


def test_penalties_are_searched_together(separable):
    best, trials = M.random_search(trainer("Logistic"), separable, "id", {"regParam": ("log", 1e-4, 10.0)}, trials=6, folds=2)
    rows = trials.collect()
    assert [r.percent for r in rows] == [100] * 6
    chosen = best.model.stages[-1].getRegParam()
    top = max(rows, key=lambda r: r.auc)
    assert top.params == f"regParam={chosen:.6g}"
    one = trainer("Logistic").classifier
    alone = M.cross_validate(M.Trainer(one.copy({one.regParam: chosen}), COLUMNS, "y"), separable, "id", folds=2, repeats=1)[1].first()
    assert alone.mean_score == pytest.approx(top.auc, abs=1e-9)


def test_votes_of_cross_validated_models(spark, separable, tmp_path):
    import duckdb

    rows = trainer("Logistic").fold_rows(separable, "id", 2, 2)
    models = {n: trainer(n).classifier for n in ("RandomForest", "Logistic")}
    scores = M.out_of_fold_models(rows, models)
    columns = ["p_RandomForest", "p_Logistic"]
    assert scores.count() == 800 and scores.dropna().count() == 800
    mean, weights = M.voted(scores, "id", "y", columns)
    mean.write.parquet(f"{tmp_path}/votes")
    scores.write.parquet(f"{tmp_path}/scores")
    wrong = duckdb.sql(f"""
        WITH m AS (SELECT id, avg(p_RandomForest) AS f, avg(p_Logistic) AS l FROM '{tmp_path}/scores/*.parquet' GROUP BY id)
        SELECT count(*) FROM m JOIN '{tmp_path}/votes/*.parquet' v USING (id)
        WHERE abs(v.soft - (f + l) / 2) > 1e-12 OR abs(v.weighted - ({weights[0]} * f + {weights[1]} * l)) > 1e-12""").fetchall()[0][0]
    assert wrong == 0 and mean.count() == 400
    found = {r.model: r for r in M.vote_stability(scores, "y", columns, weights).collect()}
    assert set(found) == {*columns, "soft", "weighted"} and all(r.n_folds == 4 and r.mean_score > 0.85 for r in found.values())


def test_compare_models(separable):
    spaces = {"GradientBoosting": {"maxDepth": ("int", 2, 3)}, "RandomForest": {"maxDepth": ("int", 2, 4)}, "Logistic": M.SPACES["Logistic"]}
    rows = trainer("Logistic").fold_rows(separable, "id", 2, 1)
    searching = trainer("Logistic").fold_rows(separable, "id", 2, 1, seed=5)
    table, scores = M.compare_models(rows, searching, M.classifiers("y", trees=5, rounds=2), trials=2, spaces=spaces)
    rows = table.collect()
    assert {r.model for r in rows} == set(spaces) and all(r.post_fe > 0.85 and r.post_tuning > 0.85 for r in rows)
    assert len(scores) == 6 and all(s.count() == 400 for s in scores.values())
