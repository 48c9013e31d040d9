from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from creditspark.catalog import model_queries
from creditspark.operators.align import align_to
from creditspark.operators.ranks import roc_auc
from creditspark.plans import modelling
from creditspark.plans.features import HistoryStore, history_features, history_frame
from creditspark.plans.scoring import ScoringModel, fit_scoring, prune_lists, score_bundle, weaker_variants
from creditspark.sources.files import read_bundle
from creditspark.sources.schemas import KEY, TABLES
from creditspark.streaming.scoring import client_stream, read_scores, score_stream
from tests.frames import many_clients, only, without_target


@pytest.fixture(scope="module")
def fitted(spark, tmp_path_factory):
    tables = {name: df.cache() for name, df in many_clients(spark).items()}
    path = str(tmp_path_factory.mktemp("model"))
    keep = [f.name for f in tables["client"].schema.fields
            if f.name in (KEY, "TARGET") or not tables["client"].select(f.name).dropna().isEmpty()]
    slim = {**tables, "client": tables["client"].select(*keep, "AMT_REQ_CREDIT_BUREAU_YEAR",
                                                        "OBS_30_CNT_SOCIAL_CIRCLE", "DEF_30_CNT_SOCIAL_CIRCLE")}
    fit_scoring(slim, "Logistic", rounds=2, trees=5, select_iterations=1, variant_iterations=1).save(spark, path)
    return tables, path


def test_saved_model_separates_the_classes(spark, fitted):
    tables, path = fitted
    records = ScoringModel.load(spark, path).score(without_target(tables))
    joined = records.join(tables["client"].select(KEY, "TARGET"), records.client_id == tables["client"][KEY])
    assert joined.count() == 200
    assert roc_auc(joined, "default_probability", "TARGET").first().auc > 0.95
    tiers = {(r.default_probability > 0.7, r.risk_score == "high") for r in records.collect()}
    assert tiers <= {(True, True), (False, False)}


def test_one_client_scores_as_in_the_batch(spark, fitted):
    tables, path = fitted
    model = ScoringModel.load(spark, path)
    whole = {r.client_id: r.default_probability for r in model.score(without_target(tables)).collect()}
    alone = model.score(only(without_target(tables), 16)).collect()
    assert len(alone) == 1 and alone[0].default_probability == pytest.approx(whole[16], abs=1e-12)


def test_bundle_scoring_writes_json(spark, fitted, tmp_path):
    tables, path = fitted
    for name, schema in TABLES.items():
        align_to(tables[name], schema).write.csv(str(tmp_path / f"{name}.csv"), header=True)
    got = score_bundle(spark, str(tmp_path), path, str(tmp_path / "out"))
    assert got.count() == 200 and set(got.columns) == {"client_id", "default_probability", "risk_score"}
    assert got.filter("default_probability is null").isEmpty()


def test_bundle_clients_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(modelling, "ROWS_PER_TASK", 50)
    tables = {name: df.coalesce(1) for name, df in many_clients(spark).items()}
    model_queries._write_bundle(tables, str(tmp_path))
    assert len(list((tmp_path / "client.csv").glob("part-*"))) == 4
    back = read_bundle(spark, str(tmp_path))
    assert set(back) == set(TABLES)
    for name, schema in TABLES.items():
        given = align_to(tables[name], schema)
        assert back[name].exceptAll(given).isEmpty() and given.exceptAll(back[name]).isEmpty()


def test_arriving_clients_are_spread_over_two_tasks_or_more(spark, monkeypatch):
    few = spark.range(90).coalesce(1)
    assert modelling.spread(few, 2).rdd.getNumPartitions() == 2 and modelling.spread(few).rdd.getNumPartitions() == 1
    monkeypatch.setattr(modelling, "ROWS_PER_TASK", 10)
    assert modelling.spread(few, 2).rdd.getNumPartitions() == 9


def test_stream_scores_each_client_once_and_only_new_files_later(spark, fitted, tmp_path):
    tables, path = fitted
    model = ScoringModel.load(spark, path)
    incoming, out, progress = (str(tmp_path / n) for n in ("incoming", "out", "progress"))
    clients = align_to(tables["client"], TABLES["client"])
    history = HistoryStore.write(history_frame(tables), str(tmp_path / "history"), buckets=16)

    def run():
        score_stream(client_stream(spark, incoming), history, model, out, progress).awaitTermination()
        return {r.client_id: r.default_probability for r in read_scores(spark, out).collect()}

    clients.filter(f"{KEY} < 20").coalesce(1).write.csv(incoming, header=True)
    first = run()
    assert set(first) == set(range(20))
    clients.filter(f"{KEY} between 20 and 24").coalesce(1).write.mode("append").csv(incoming, header=True)
    second = run()
    assert set(second) == set(range(25)) and read_scores(spark, out).count() == 25
    batch = {r.client_id: r.default_probability for r in model.score(without_target(tables)).collect()}
    assert all(second[k] == pytest.approx(batch[k], abs=1e-12) for k in second)


def test_selection_keeps_the_most_important_columns(spark, fitted):
    tables, _ = fitted
    client = tables["client"].select(KEY, "TARGET", "AMT_CREDIT", "AMT_INCOME_TOTAL", "AMT_ANNUITY", "FLAG_OWN_CAR",
                                     "FLAG_OWN_REALTY", "DAYS_EMPLOYED", "DAYS_BIRTH", "OCCUPATION_TYPE",
                                     "REGION_RATING_CLIENT_W_CITY", "OBS_30_CNT_SOCIAL_CIRCLE",
                                     "DEF_30_CNT_SOCIAL_CIRCLE", "AMT_REQ_CREDIT_BUREAU_YEAR")
    model = fit_scoring({**tables, "client": client}, "RandomForest", select_iterations=1, trees=5, rounds=2, variant_iterations=0)
    whole = len(model.encoding.transform(model.features.transform({**tables, "client": client.withColumn(
        "OCCUPATION_TYPE_missing", client.TARGET)})).columns) - 2
    assert len(model.selection.kept) <= whole and "AMT_CREDIT" in model.selection.kept
    assert model.score(without_target({**tables, "client": client})).count() == 200


def test_prune_lists(spark, fitted):
    tables, _ = fitted
    left = prune_lists(tables["client"]).columns
    assert "CNT_CHILDREN" not in left and "AMT_REQ_CREDIT_BUREAU_DAY" not in left and KEY in left


def test_history_holds_every_feature_once(fitted):
    tables, _ = fitted
    whole = history_frame(tables)
    assert whole.count() == whole.select(KEY).distinct().count()
    rows = {r[KEY]: r.asDict() for r in whole.collect()}
    for part in history_features(tables):
        for r in part.collect():
            assert all(rows[r[KEY]][c] == v for c, v in r.asDict().items())


def test_a_batch_reads_its_clients_folders_only(spark, fitted, tmp_path):
    tables, _ = fitted
    history = history_frame(tables)
    store = HistoryStore.write(history, str(tmp_path / "history"), buckets=16)
    every = len(store.rows.inputFiles())
    few = store.of(tables["client"].filter(f"{KEY} in (3, 7)"))
    assert {3, 7} <= {r[KEY] for r in few.collect()}
    # the scan lists the folders that are left, two of sixteen at most
    scan = [line for line in few._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in line]
    assert scan and "bucket" in scan[0]
    read = few.select("_metadata.file_path").distinct().count()
    assert read <= 2 < every
    assert store.of(tables["client"].limit(0)).count() == 0


def test_selection_is_saved_and_drops_weaker_variants(spark, fitted):
    tables, path = fitted
    model = ScoringModel.load(spark, path)
    assert "CNT_CHILDREN" in model.selection.dropped and model.selection.kept
    client = tables["client"].select(KEY, "TARGET").withColumns({
        "APARTMENTS_AVG": F.rand(1), "APARTMENTS_MODE": F.col("TARGET") + F.rand(2) / 10, "APARTMENTS_MEDI": F.rand(3),
        "LANDAREA_AVG": F.rand(4)})
    assert weaker_variants(client, 1, 5, 2) == ["APARTMENTS_AVG", "APARTMENTS_MEDI"]
