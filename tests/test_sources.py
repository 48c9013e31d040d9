from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import types as T

from creditspark.sources import files
from creditspark.sources import schemas as S


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_csv_blanks_and_nan_are_null(spark, tmp_path):
    path = str(tmp_path / "b.csv")
    write(path, "SK_ID_BUREAU,MONTHS_BALANCE,STATUS\n1,-1,0\n2,,C\n3,-3,\n")
    got = [tuple(r) for r in files.read_csv(spark, path, S.BUREAU_BALANCE).orderBy("SK_ID_BUREAU").collect()]
    assert got == [(1, -1, "0"), (2, None, "C"), (3, -3, None)]
    write(path, "a,b\n1,NaN\n2,1.5\n")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.DoubleType())])
    assert [tuple(r) for r in files.read_csv(spark, path, schema).orderBy("a").collect()] == [(1, None), (2, 1.5)]


def test_csv_with_another_header_is_refused(spark, tmp_path):
    path = str(tmp_path / "b.csv")
    write(path, "SK_ID_BUREAU,STATUS,MONTHS_BALANCE\n1,0,-1\n")
    with pytest.raises(Exception):
        files.read_csv(spark, path, S.BUREAU_BALANCE).collect()


def test_bundle_names_match_in_any_case(spark, tmp_path):
    for name, schema in S.TABLES.items():
        header = ",".join(f.name for f in schema.fields)
        shown = "POS_CASH_balance" if name == "pos_cash_balance" else name
        write(str(tmp_path / f"{shown}.csv"), header + "\n" + "1" + "," * (len(schema.fields) - 1) + "\n")
    bundle = files.read_bundle(spark, str(tmp_path))
    assert set(bundle) == set(S.TABLES)
    assert {name: df.count() for name, df in bundle.items()} == dict.fromkeys(S.TABLES, 1)
    assert bundle["bureau_balance"].schema["STATUS"].dataType == T.StringType()


def test_schemas_have_the_documented_sizes():
    assert {n: len(s.fields) for n, s in S.TABLES.items()} == {
        "client": 121, "bureau": 17, "bureau_balance": 3, "previous_application": 37, "credit_card_balance": 23,
        "installments_payments": 8, "pos_cash_balance": 8}
    assert len(S.BUILDING_COLUMNS) == 42 and S.CLIENT_TRAIN.fields[1].name == "TARGET"


def test_fitted_state_round_trips(spark, tmp_path):
    params = {"a": [1.5, None], "b": {"c": "é"}}
    files.write_params(spark, params, str(tmp_path / "p"))
    files.write_params(spark, params, str(tmp_path / "p"))
    assert files.read_params(spark, str(tmp_path / "p")) == params
    df = spark.createDataFrame([(1, "x", 2.0)], "z long, a string, m double")
    files.write_columns(df, str(tmp_path / "c"))
    assert files.read_columns(spark, str(tmp_path / "c")).names == ["z", "a", "m"]
    files.write_table(df, str(tmp_path / "t"))
    assert files.read_table(spark, str(tmp_path / "t")).collect() == df.collect()


def test_scored_outputs(spark, tmp_path):
    from pyspark.ml.linalg import Vectors

    rows = [(1, Vectors.dense([0.2, 0.8])), (2, Vectors.dense([0.9, 0.1]))]
    scored = spark.createDataFrame(rows, ["SK_ID_CURR", "probability"])
    files.write_predictions(scored, str(tmp_path / "pred"))
    back = spark.read.csv(str(tmp_path / "pred"), header=True, inferSchema=True).orderBy("SK_ID_CURR")
    assert back.columns == ["SK_ID_CURR", "TARGET"] and [r.TARGET for r in back.collect()] == [0.8, 0.1]
    files.write_scores(files.score_records(scored), str(tmp_path / "json"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "json")).collect()]
    assert {r["client_id"]: r["risk_score"] for r in lines} == {1: "high", 2: "low"}


def test_shape_preview_and_types(spark):
    df = spark.createDataFrame([(i, "x") for i in range(9)], "a long, b string")
    assert files.shape(df) == (9, 2) and files.preview(df).count() == 5
    assert {r.data_type: r.n_columns for r in files.type_counts(df).collect()} == {"bigint": 1, "string": 1}
