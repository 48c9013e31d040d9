from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditspark.operators.encode import EncodingModel, dummies, fit_levels, indicator_columns
from creditspark.operators.scale import ScaleModel
from creditspark.plans.modelling import cross_fitted, with_indicators


@pytest.fixture(scope="module")
def train(spark):
    rows = [(i, i % 2, "ab"[i % 2] if i % 5 else None, f"c{i % 12}", float(i)) for i in range(60)]
    return spark.createDataFrame(rows, "id long, y long, low string, high string, x double")


def test_encoding_columns_and_order(train):
    model = EncodingModel.fit(train, "y", keep=["id", "y"])
    out = model.transform(train)
    assert model.high == ["high"] and model.levels == {"low": ["a", "b"]}
    assert out.columns == ["id", "y", "x", "low_a", "low_b", "high"]
    first = {r.id: r for r in out.collect()}
    assert (first[0].low_a, first[0].low_b) == (0, 0)  # NULL
    assert (first[1].low_a, first[1].low_b) == (0, 1)
    # five rows of c0, all of class 0, prior one half, m = 1
    assert first[0].high == pytest.approx((0 + 0.5) / (5 + 1))


def test_unseen_and_null_categories_get_the_prior(spark, train, tmp_path):
    model = EncodingModel.fit(train, "y", keep=["id", "y"])
    model.save(spark, str(tmp_path / "enc"))
    loaded = EncodingModel.load(spark, str(tmp_path / "enc"))
    new = spark.createDataFrame([(1, "zzz", "never", 1.0), (2, "a", None, 2.0)],
                                "id long, low string, high string, x double")
    for m in (model, loaded):
        got = {r.id: r for r in m.transform(new).collect()}
        assert (got[1].low_a, got[1].low_b, got[1].high) == (0, 0, 0.5) and got[2].high == 0.5


def test_dummies_drop_the_first_level(spark):
    df = spark.createDataFrame([(1, "b", 2.0), (2, "a", 3.0), (3, None, 4.0), (4, "c d", 1.0)],
                               "id long, k string, v double")
    out = dummies(df, fit_levels(df, ["k"]), keep=["id"])
    assert out.columns == ["id", "v", "k_b", "k_c_d"]
    assert {r.id: (r.k_b, r.k_c_d) for r in out.collect()} == {1: (1, 0), 2: (0, 0), 3: (0, 0), 4: (0, 1)}
    ordered = dummies(df, fit_levels(df, ["k"], {"k": ["c d", "b", "a"]}), keep=["id"])
    assert ordered.columns == ["id", "v", "k_b", "k_a"]


def test_clashing_indicator_names_stay_distinct(spark):
    df = spark.createDataFrame([("a b",), ("a_b",)], "k string")
    assert df.select(*indicator_columns(fit_levels(df, ["k"]))).columns == ["k_a_b", "k_a_b_2"]
    odd = spark.createDataFrame([("X Y", 1.0), ("X-Y", 2.0), ("X_Y_2", 3.0)], "k string, k_X_Y double")
    names = dummies(odd, fit_levels(odd, ["k"]), drop_first=False).columns
    assert len({n.lower() for n in names}) == len(names) == 4


def test_columns_of_many_levels(spark):
    many = spark.range(10_500).select("id", F.concat(F.lit("v"), F.col("id")).alias("k"), (F.col("id") % 2).alias("y"))
    assert len(fit_levels(many, ["k"])["k"]) == 10_500
    rows, columns, high = with_indicators(many, "id", "y", drop_first=True)
    assert rows.columns == ["id", "y", "k"] and columns == [] and high == ["k"]
    encoded = cross_fitted(rows, high, "id", "y")
    assert encoded.columns == ["id", "y", "k"] and encoded.count() == 10_500
    # a value of one row tells nothing of its label: what is left is the mean of the other folds
    assert encoded.filter("k is null or abs(k - 0.5) > 0.02").count() == 0


def test_scaling_uses_population_deviation_and_moves_skewed_columns(spark, tmp_path):
    draw = np.random.default_rng(1)
    skewed, even = np.exp(draw.normal(size=200) * 2), draw.uniform(size=200)
    rows = [(i, float(e), float(s), 7.0) for i, (s, e) in enumerate(zip(skewed, even))]
    df = spark.createDataFrame(rows, "id long, even double, skewed double, flat double")
    model = ScaleModel.fit(df, keep=["id"])
    model.save(spark, str(tmp_path / "scale"))
    out = ScaleModel.load(spark, str(tmp_path / "scale")).transform(df)
    assert out.columns == ["id", "skewed_box_cox", "even", "flat"]
    got = out.toPandas().sort_values("id")
    moved = ((1 + skewed) ** 0.15 - 1) / 0.15
    assert np.allclose(got["skewed_box_cox"], (moved - moved.mean()) / moved.std())
    assert np.allclose(got["even"], (even - even.mean()) / even.std())
    assert (got["flat"] == 0).all()


def test_scaling_skips_nulls_in_fit_and_keeps_them(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "id long, x double")
    got = {r.id: r.x for r in ScaleModel.fit(df, keep=["id"]).transform(df).collect()}
    assert got == {1: -1.0, 2: None, 3: 1.0}


def test_levels_too_many_for_columns_are_refused(spark):
    df = spark.createDataFrame([(f"{i}" * 200,) for i in range(3000)], "t string")
    with pytest.raises(ValueError, match="EncodingModel"):
        fit_levels(df, ["t"])
