from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditspark.functions import columns as C
from creditspark.functions import numeric


def values(df, *exprs):
    return [tuple(r) for r in df.select(*exprs).collect()]


def test_nan_becomes_null_and_is_skipped(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "b")], "x double, s string")
    assert values(C.nan_to_null(df).agg(F.avg("x"), F.count("x"), F.max("x")), "*") == [(1.0, 1, 1.0)]


def test_ratio_is_null_on_zero_or_null(spark):
    df = spark.createDataFrame([(1, 2), (1, 0), (None, 2), (1, None)], "a int, b int")
    assert values(df, C.ratio("a", "b")) == [(0.5,), (None,), (None,), (None,)]


def test_share_counts_nulls_as_not_met(spark):
    df = spark.createDataFrame([(0,), (0,), (None,), (3,)], "x int")
    assert values(df.agg(C.share(F.col("x") == 0)), "*") == [(0.5,)]


def test_row_sum_of_all_nulls_is_zero(spark):
    df = spark.createDataFrame([(None, None), (1.0, None), (1.0, 2.0)], "a double, b double")
    assert values(df, C.row_sum(["a", "b"])) == [(0.0,), (1.0,), (3.0,)]
    assert values(df.limit(1), C.row_sum([])) == [(0.0,)]


def test_sentinel_and_flags(spark):
    df = spark.createDataFrame([(365243, "Y"), (-10, "N"), (None, "X"), (36500, None)], "d long, f string")
    got = values(df, C.null_above("d", C.EMPLOYMENT_SENTINEL_ABOVE), C.yes_no("f"))
    assert got == [(None, 1), (-10, 0), (None, None), (36500, None)]


def test_employment_bands_are_right_closed(spark):
    days = [365243, 1, 0, -364, -365, -1094, -1095, -1824, -1825, -9999, None]
    df = spark.createDataFrame([(d,) for d in days], "d long")
    assert [v for v, in values(df, C.employment_band("d"))] == [
        None, None, "<1y", "<1y", "1-3y", "1-3y", "3-5y", "3-5y", ">5y", ">5y", None]


def test_age_bands_keep_exact_ages_in_the_lower_band(spark):
    ages = [0, 25, 25.01, 35, 45, 55, 56]
    df = spark.createDataFrame([(int(-a * 365),) for a in ages] + [(None,)], "d long")
    assert [v for v, in values(df, C.age_band("d"))] == [
        None, "<25", "25-35", "25-35", "35-45", "45-55", "55+", None]


def test_risk_tiers_are_strict_and_null_safe(spark):
    df = spark.createDataFrame([(p,) for p in (0.0, 0.3, 0.31, 0.7, 0.71, None)], "p double")
    assert [v for v, in values(df, C.risk_tier("p"))] == ["low", "low", "moderate", "moderate", "high", None]


def test_missing_tier_tests_high_first(spark):
    df = spark.createDataFrame([(60.0, 5.0), (10.0, 10.1), (10.0, 10.0)], "a double, b double")
    assert [v for v, in values(df, C.missing_tier("a", "b"))] == ["High", "Medium", "Low"]


def test_effect_tiers(spark):
    df = spark.createDataFrame([(e,) for e in (-0.1, 0.2, -0.5, 0.8, None)], "e double")
    got = values(df, C.rank_effect_tier("e"), C.median_effect_tier("e"), C.association_tier("e"))
    assert got == [("negligible", "small", "small"), ("small", "medium", "small"), ("medium", "large", "large"),
                   ("large", "large", "large"), (None, None, None)]


@pytest.mark.parametrize("lam", [0.15, 0.0, 1.0])
def test_box_cox_round_trip(spark, lam):
    xs = [-3.0, 0.0, 0.5, 7.0, 1e6, None]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    moved = df.select("x", C.box_cox("x", lam).alias("m")).select("x", "m", C.box_cox_inverse("m", lam).alias("b"))
    for x, m, b in values(moved, "*"):
        if x is None:
            assert m is None and b is None
        else:
            assert b == pytest.approx(x, rel=1e-9)
            if x <= 0:
                assert m == x


def test_box_cox_value(spark):
    df = spark.createDataFrame([(3.0,)], "x double")
    assert values(df, C.box_cox("x"))[0][0] == pytest.approx((4 ** 0.15 - 1) / 0.15)


def test_text_helpers(spark):
    assert C.clean_name("AGE_GROUP_<25") == "AGE_GROUP__25"
    assert C.clean_name("a (b) / c") == "a_b_c"
    df = spark.createDataFrame([("Größe: 5, ok", "X_MEDI", 3.0), (None, "X_MEDIUM", 2.5)], "s string, v string, n double")
    got = values(df, C.clean_value("s"), C.variant_base("v"), C.number_text("n"))
    assert got == [("Größe_5_ok", "X", "3"), (None, "X_MEDIUM", "2.50")]
    assert values(df.limit(1), C.number_text(F.lit(None)))[0][0] is None


def test_weighted_mean(spark):
    df = spark.createDataFrame([(0.2, 0.8)], "a double, b double")
    assert values(df, C.weighted_mean([3, 1], ["a", "b"]))[0][0] == pytest.approx(0.35)


def test_chi2_tail_and_t_quantile_against_tables():
    for x, dof in ((3.841459, 1), (5.991465, 2), (7.814728, 3), (18.307038, 10), (124.342113, 100)):
        assert numeric.chi2_tail(x, dof) == pytest.approx(0.05, abs=1e-7)
    for dof, t in ((1, 12.7062047), (4, 2.7764451), (14, 2.1447867)):
        assert numeric.t_quantile(0.975, dof) == pytest.approx(t, rel=1e-7)
    assert numeric.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-7)


def test_phik_limits_and_monotony():
    assert numeric.phik_from_chi2(50, 1000, 10, 10) == 0.0
    assert numeric.phik_from_chi2(9000, 1000, 10, 10) == 1.0
    assert math.isnan(numeric.phik_from_chi2(5, 100, 1, 4))
    found = [numeric.phik_from_chi2(c, 1000, 4, 4) for c in (20, 100, 500, 1500, 2900)]
    assert found == sorted(found) and found[0] > 0


def dependence(rho, r, k):
    """Chi-squared per record of the binned normal, integrated over x of the conditional distribution of y."""
    nodes, weights = np.polynomial.legendre.leggauss(200)
    x, y = np.linspace(-5, 5, r + 1), np.linspace(-5, 5, k + 1)
    joint = np.zeros((r, k))
    for i in range(r):
        half = (x[i + 1] - x[i]) / 2
        at = x[i] + half * (1 + nodes)
        below = numeric._normal_cdf(((y[:, None] - rho * at) / math.sqrt(1 - rho * rho)).ravel()).reshape(k + 1, -1)
        joint[i] = (np.diff(below, axis=0) * np.exp(-at * at / 2) * weights).sum(axis=1) * half
    joint /= joint.sum()
    flat = np.outer(*(np.diff(numeric._normal_cdf(edges)) / np.diff(numeric._normal_cdf(edges)).sum() for edges in (x, y)))
    return float(((joint - flat) ** 2 / flat).sum())


@pytest.mark.parametrize("r, k", [(2, 2), (2, 9), (5, 3), (10, 10), (12, 40)])
def test_phik_recovers_the_correlation_of_a_binned_normal(r, k):
    n, strongest = 1e7, numeric.dependence_table(min(r, k), max(r, k))[2]
    pedestal, ceiling = (r - 1) * (k - 1), n * (min(r, k) - 1)
    for rho in (0.02, 0.3, 0.6, 0.9):
        chi2 = pedestal + (ceiling - pedestal) / strongest * dependence(rho, r, k)
        assert numeric.phik_from_chi2(chi2, n, r, k) == pytest.approx(rho, abs=1e-6)
        assert numeric.phik_from_chi2(chi2, n, k, r) == numeric.phik_from_chi2(chi2, n, r, k)


def test_phik_of_two_by_two_tables_in_closed_form():
    # the closed form is that of the whole plane; a share of 1.1e-6 of it lies beyond 5 standard deviations
    for chi2 in (1.5, 30, 400, 990, 999.999):
        assert numeric.phik_from_chi2(chi2, 1000, 2, 2) == pytest.approx(
            math.sin(math.pi / 2 * math.sqrt((chi2 - 1) / 999)), abs=3e-6)


def test_phik_blocks_of_a_wide_grid(monkeypatch):
    whole = numeric.dependence_table.__wrapped__(7, 30)
    monkeypatch.setattr(numeric, "BLOCK_CELLS", 16)
    cut = numeric.dependence_table.__wrapped__(7, 30)
    assert all(a == pytest.approx(b, rel=1e-9, abs=1e-9) for a, b in zip(whole, cut))
