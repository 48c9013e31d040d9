"""Readers and writers: CSV tables and bundles, fitted tables, column lists, predictions, scored JSON."""

from __future__ import annotations

import json

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditspark.functions.columns import nan_to_null, risk_tier
from creditspark.sources.schemas import KEY, TABLES, TARGET


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header row and a declared schema; blank cells and NaN are NULL.

    The header must match the schema, and a value that does not fit its type is an error rather than
    a silent NULL.
    """
    df = spark.read.csv(path, schema=schema, header=True, enforceSchema=False, mode="FAILFAST")
    return nan_to_null(df)


def _any_case(name: str) -> str:
    """Glob matching ``name`` in any letter case."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in name)


def read_bundle(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The seven tables of one request folder, keyed by table name."""
    return {
        name: read_csv(spark, f"{folder}/{_any_case(name)}.csv", schema)
        for name, schema in TABLES.items()
    }


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_params(spark: SparkSession, params: dict, path: str) -> None:
    """Small fitted values (scalars and name lists) as one JSON text file."""
    one = spark.range(1).select(F.lit(json.dumps(params)).alias("value"))
    one.coalesce(1).write.mode("overwrite").text(path)


def read_params(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def write_columns(df: DataFrame, path: str) -> None:
    """Ordered column list with types."""
    write_params(df.sparkSession, {"schema": df.schema.json()}, path)


def read_columns(spark: SparkSession, path: str) -> T.StructType:
    return T.StructType.fromJson(json.loads(read_params(spark, path)["schema"]))


def class_one(probability: str = "probability") -> Column:
    return vector_to_array(F.col(probability))[1]


def predictions(scored: DataFrame, key: str = KEY, label: str = TARGET) -> DataFrame:
    """Key and probability of class 1, in the layout of the predictions file."""
    return scored.select(F.col(key), class_one().alias(label))


def write_predictions(scored: DataFrame, path: str, key: str = KEY, label: str = TARGET) -> None:
    predictions(scored, key, label).write.mode("overwrite").csv(path, header=True)


def score_records(scored: DataFrame, key: str = KEY) -> DataFrame:
    """One record per client: id, default probability and risk tier."""
    p = class_one()
    return scored.select(
        F.col(key).alias("client_id"), p.alias("default_probability"), risk_tier(p).alias("risk_score"),
    )


def write_scores(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    records.write.mode(mode).json(path)


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def column_types(df: DataFrame) -> DataFrame:
    """One row per column: name, type, position."""
    rows = [(name, kind, i) for i, (name, kind) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(rows, "column string, data_type string, position int")


def type_counts(df: DataFrame) -> DataFrame:
    return column_types(df).groupBy("data_type").agg(F.count("*").alias("n_columns"))
