from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from creditspark.operators import align, profile
from creditspark.operators.joins import lookup_join


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "a", 1.0, "x"), (2, "b", None, None), (3, "a", 3.0, "x"), (4, None, 10.0, "y"), (5, "b", 3.0, "x")]
    return spark.createDataFrame(rows, "id long, kind string, v double, s string")


def table(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def test_duplicates_treat_nulls_as_equal(spark):
    rows = [(1, None), (1, None), (1, None), (2, "a"), (2, "a"), (3, "c")]
    df = spark.createDataFrame(rows, "a int, b string")
    assert profile.duplicate_census(df).first().asDict() == {
        "total_rows": 6, "duplicate_rows": 3, "duplicate_members": 5}
    assert [tuple(r) for r in profile.duplicate_rows(df, 4).collect()] == [
        (1, None), (1, None), (1, None), (2, "a")]
    none = profile.duplicate_census(df.filter("a > 9")).first()
    assert none.total_rows == 0 and none.duplicate_rows == 0


def test_missing_report_and_tiers(spark, people):
    test = people.drop("s").withColumn("v", F.lit(None).cast("double"))
    got = table(profile.missing_report(people, test), "column")
    assert got["v"] == {"column": "v", "data_type": "double", "train_count": 1, "train_percent": 20.0,
                        "test_count": 5, "test_percent": 100.0}
    assert got["s"]["test_count"] is None and got["id"]["train_count"] == 0
    only = table(profile.missing_report(people, test, True), "column")
    assert set(only) == {"v", "s", "kind"}
    tiers = table(profile.missing_tiers(profile.missing_report(people, test)), "column")
    assert (tiers["v"]["category"], tiers["s"]["category"], tiers["id"]["category"]) == ("High", "Medium", "Low")


def test_missing_importances(spark, people):
    report = profile.missing_report(people, people)
    importances = spark.createDataFrame([("v", 0.7), ("id", 0.9)], "feature string, importance double")
    got = [r.asDict() for r in profile.missing_importances(report, importances).collect()]
    assert got == [{"column": "v", "train_percent": 20.0, "test_percent": 20.0, "category": "Medium",
                    "importance": 0.7}]


def test_describe_numeric_matches_pandas(spark):
    draw = np.random.default_rng(0)
    data = pd.DataFrame({"a": draw.normal(size=101), "b": draw.integers(0, 5, 101).astype(float)})
    data.loc[3, "a"] = None
    df = spark.createDataFrame(data).select(F.nanvl("a", F.lit(None).cast("double")).alias("a"), "b")
    got = table(profile.describe_numeric(df, ["a", "b"]), "column")
    want = data.describe()
    for c in "ab":
        for ours, theirs in (("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("q25", "25%"),
                             ("q50", "50%"), ("q75", "75%"), ("max", "max")):
            assert got[c][ours] == pytest.approx(want[c][theirs])


def test_describe_numeric_of_an_empty_column(spark):
    wide = spark.range(1000).select(F.col("id").cast("double").alias("a"))
    near = profile.describe_numeric(wide, ["a"], approximate=True).first()
    assert near.q50 == pytest.approx(499.5, abs=1) and near["count"] == 1000
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    got = table(profile.describe_numeric(df, ["a", "b"]), "column")
    assert got["b"]["count"] == 0 and got["b"]["q50"] is None and got["a"]["q50"] == 1.5


def test_categorical_reports(people):
    got = table(profile.describe_categorical(people, ["kind", "s"]), "column")
    assert got["kind"] == {"column": "kind", "count": 4, "n_unique": 2, "top": "a", "freq": 2}
    listing = profile.distinct_listing(people, ["kind", "s"]).collect()
    assert {r.value for r in listing if r.column == "kind"} == {"a", "b", None}
    assert {r.unique_values_count for r in listing} == {3}
    split = table(profile.cardinality_split(people, ["kind", "s"], 1), "column")
    assert split["kind"] == {"column": "kind", "n_unique": 2, "cardinality": "high"}
    assert table(profile.cardinality_split(people, ["kind"], approximate=True), "column")["kind"]["n_unique"] == 2


def test_counts_and_proportions(spark, people):
    got = [tuple(r) for r in profile.value_counts_percent(people, "s").collect()]
    assert got == [("x", 3, 75.0), ("y", 1, 25.0)]
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", None), (None, "z")], "k string, s string")
    pairs = {(r.k, r.s): r.proportion for r in profile.proportions(df, "k", "s", ["x", "y"]).collect()}
    assert pairs == {("a", "x"): 0.5, ("a", "y"): 0.5, ("b", "x"): 1.0, ("b", "y"): None}
    found = {(r.k, r.s): r.proportion for r in profile.proportions(df, "k", "s").collect()}
    assert found == {("a", "x"): 0.5, ("a", "y"): 0.5, ("b", "x"): 1.0}
    cells = table(profile.crosstab(people, "kind", "s", ["x", "y"]), "kind")
    assert cells["a"] == {"kind": "a", "x": 2, "y": 0}


def test_class_weights_average_to_one(spark):
    df = spark.createDataFrame([(0,)] * 9 + [(1,)] * 3, "y int")
    got = table(profile.class_weights(df, "y"), "y")
    assert got[0]["weight"] == pytest.approx(12 / 18) and got[1]["weight"] == pytest.approx(2.0)
    assert got[0]["weight_ratio"] == 3.0
    assert sum(r["n"] * r["weight"] for r in got.values()) == pytest.approx(12)


def test_skewness_is_bias_corrected(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (2.0, 5.0, 1.0), (10.0, 5.0, 3.0)], "a double, b double, c double")
    got = table(profile.skewness_report(df, ["a", "b", "c"]), "column")
    assert got["a"]["skewness"] == pytest.approx(1.6523, abs=1e-4) and got["a"]["skewed"] == 1
    assert got["b"]["skewness"] == 0.0 and got["b"]["skewed"] == 0
    assert got["c"]["skewness"] is None and got["c"]["skewed"] == 0
    assert profile.skewed_columns(df, ["c", "b", "a"]) == ["a"]


def test_fills(people):
    values = {**profile.column_medians(people, ["v"]), **profile.column_modes(people, ["kind", "s"])}
    assert values == {"v": 3.0, "kind": "a", "s": "x"}
    assert profile.column_means(people, ["v"])["v"] == pytest.approx(4.25)
    got = table(profile.fill(people, values), "id")
    assert got[2]["v"] == 3.0 and got[2]["s"] == "x" and got[4]["kind"] == "a" and got[1]["v"] == 1.0


def test_ranked_and_fraction(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", -5.0), ("c", None), ("d", 1.0)], "f string, s double")
    assert [r.f for r in profile.ranked(df, "s", "f").collect()] == ["a", "d", "b", "c"]
    assert [r.f for r in profile.ranked(df, "s", "f", 2, absolute=True).collect()] == ["b", "a"]
    assert [r.f for r in profile.top_fraction(df, "s", "f", 0.9).collect()] == ["a", "d", "b"]


def test_variants_to_remove(spark):
    names = ["A_AVG", "A_MODE", "A_MEDI", "B_AVG", "B_MODE", "C_AVG"]
    variants = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "feature string, position int")
    importances = spark.createDataFrame([("A_MODE", 0.5), ("A_MEDI", 0.2)], "feature string, importance double")
    got = {r.feature for r in profile.variants_to_remove(variants, importances).collect()}
    # ties and unknown importances keep the first listed; a single variant stays
    assert got == {"A_AVG", "A_MEDI", "B_MODE"}


def test_box_stats(spark):
    df = spark.createDataFrame([("g", float(x)) for x in [1, 2, 3, 4, 5, 100]] + [("g", None)], "g string, x double")
    got = profile.box_stats(df, "x", "g").first()
    assert (got.q25, got.q50, got.q75) == (2.25, 3.5, 4.75)
    assert (got.whisker_low, got.whisker_high, got.n_outliers) == (1.0, 5.0, 1)


def test_histogram_keeps_every_row(spark):
    df = spark.createDataFrame([(float(x % 17),) for x in range(200)] + [(None,)], "x double")
    got = profile.histogram(df, "x", bins=8).collect()
    assert sum(r.n for r in got) == 200 and {r.bin for r in got} == set(range(8))
    one = profile.histogram(df.filter("x = 3"), "x", bins=8).collect()
    assert len(one) == 1 and one[0].bin == 0


def test_density_integrates_to_about_one(spark):
    draw = np.random.default_rng(5)
    df = spark.createDataFrame([("g", float(v)) for v in draw.normal(size=3000)], "g string, x double")
    got = sorted((r.x, r.density) for r in profile.density(df, "x", "g", 60).collect())
    area = np.trapezoid([d for _, d in got], [x for x, _ in got])
    assert area == pytest.approx(1.0, abs=0.02)
    assert max(d for _, d in got) == pytest.approx(1 / math.sqrt(2 * math.pi), abs=0.05)


def test_schema_operators(people):
    assert align.numeric_columns(people) == ["id", "v"] and align.categorical_columns(people) == ["kind", "s"]
    assert align.columns_with_prefix(people, "k") == ["kind"] and align.without(["a", "b"], "a") == ["b"]
    left, right = align.keep_common(people, people.select("v", "id"))
    assert left.columns == ["id", "v"] == right.columns
    fixed = align.align_to(people, ["v", "new", "id"])
    assert fixed.columns == ["v", "new", "id"] and dict(fixed.dtypes)["new"] == "double"
    assert align.clean_column_names(people.withColumnRenamed("kind", "k (1)")).columns[1] == "k_1_"
    with pytest.raises(ValueError):
        align.clean_column_names(people.select(F.col("id").alias("a b"), F.col("v").alias("a_b")))


def test_lookup_join_gives_the_same_rows_on_both_sides_of_the_bound(spark, people):
    lookup = spark.createDataFrame([("a", 1), ("z", 2)], "kind string, code int")
    small = lookup_join(people, lookup, "kind")
    large = lookup_join(people, lookup, "kind", max_bytes=0)
    assert small.count() == 5 and small.exceptAll(large).isEmpty() and large.exceptAll(small).isEmpty()
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
