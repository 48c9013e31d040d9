from __future__ import annotations

import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from creditspark.operators import stats as S


def table(df, key="column"):
    return {r[key]: r.asDict() for r in df.collect()}


def brute_u(zeros, ones):
    return sum((a > b) + 0.5 * (a == b) for a in zeros for b in ones)


@pytest.fixture(scope="module")
def two_groups(spark):
    draw = random.Random(4)
    rows = [(int(i % 3 == 0), float(draw.randint(0, 30) + 4 * (i % 3 == 0)),
             None if i % 11 == 0 else draw.random()) for i in range(240)]
    return rows, spark.createDataFrame(rows, "y int, x double, z double")


def test_mann_whitney(two_groups):
    rows, df = two_groups
    got = table(S.numeric_tests(df, ["x", "z"], "y"))
    for name, i in (("x", 1), ("z", 2)):
        zeros = [r[i] for r in rows if r[0] == 0 and r[i] is not None]
        ones = [r[i] for r in rows if r[0] == 1 and r[i] is not None]
        n0, n1 = len(zeros), len(ones)
        u = brute_u(zeros, ones)
        ties = sum(t ** 3 - t for t in Counter(zeros + ones).values())
        n = n0 + n1
        sigma = math.sqrt(n0 * n1 / 12 * (n + 1 - ties / (n * (n - 1))))
        z = (max(u, n0 * n1 - u) - n0 * n1 / 2 - 0.5) / sigma
        r = got[name]
        assert r["statistic"] == u and (r["group0_size"], r["group1_size"]) == (n0, n1)
        assert r["p_value"] == pytest.approx(min(1.0, math.erfc(z / math.sqrt(2))))
        assert r["effect_size"] == pytest.approx(2 * u / (n0 * n1) - 1)
        assert r["group0_median"] == np.median(zeros) and r["group1_median"] == np.median(ones)
        assert r["error"] is None


def test_effect_and_auc_agree(two_groups):
    _, df = two_groups
    from creditspark.operators.ranks import roc_auc

    effect = S.numeric_tests(df, ["x"], "y").first().effect_size
    assert roc_auc(df, "x", "y").first().auc == pytest.approx((1 - effect) / 2)


def test_moods_median(two_groups):
    rows, df = two_groups
    got = table(S.numeric_tests(df, ["x"], "y", "moods_median"))["x"]
    zeros, ones = [r[1] for r in rows if r[0] == 0], [r[1] for r in rows if r[0] == 1]
    middle = np.median(zeros + ones)
    cells = np.array([[sum(v > middle for v in zeros), sum(v > middle for v in ones)],
                      [sum(v <= middle for v in zeros), sum(v <= middle for v in ones)]], dtype=float)
    e = cells.sum(1, keepdims=True) * cells.sum(0, keepdims=True) / cells.sum()
    gap = np.abs(cells - e)
    chi2 = float((((gap - np.minimum(0.5, gap)) ** 2) / e).sum())
    assert got["statistic"] == pytest.approx(chi2)
    assert got["p_value"] == pytest.approx(math.erfc(math.sqrt(chi2 / 2)))
    d = (np.mean(zeros) - np.mean(ones)) / math.sqrt((np.var(zeros, ddof=1) + np.var(ones, ddof=1)) / 2)
    assert got["effect_size"] == pytest.approx(d)


def test_median_imputation_and_small_groups(spark, two_groups):
    rows, df = two_groups
    got = table(S.numeric_tests(df, ["z"], "y", missing="median_impute"))["z"]
    middle = float(np.median([r[2] for r in rows if r[2] is not None]))
    filled = [(y, middle if z is None else z) for y, _, z in rows]
    assert got["statistic"] == brute_u([z for y, z in filled if y == 0], [z for y, z in filled if y == 1])
    small = S.numeric_tests(df.limit(20), ["x"], "y")
    row = small.first()
    assert row.statistic is None and row.error.startswith("Insufficient data. Group sizes: ")
    shown = S.interpret_numeric(small).first()
    assert shown.p_value is None and shown.significance is None and shown.effect_magnitude is None
    with pytest.raises(ValueError):
        S.numeric_tests(df, ["x"], "y", "other")
    with pytest.raises(ValueError):
        S.numeric_tests(df, ["x"], "y", missing="other")


def test_interpretation(two_groups):
    _, df = two_groups
    shown = S.interpret_numeric(S.numeric_tests(df, ["x"], "y")).first()
    assert shown.significance == "Statistically significant" and shown.effect_magnitude in ("small", "medium")
    assert shown.statistic == round(shown.statistic, 2)


def brute_chi2(cells: np.ndarray) -> float:
    e = cells.sum(1, keepdims=True) * cells.sum(0, keepdims=True) / cells.sum()
    gap = np.abs(cells - e)
    if cells.shape == (2, 2):
        gap = gap - np.minimum(0.5, gap)
    return float((gap ** 2 / e).sum())


def test_chi_squared_with_yates_only_on_two_by_two(spark):
    draw = random.Random(8)
    rows = [(draw.choice("ab"), draw.choice("pqrs"), "only", int(draw.random() < 0.3)) for _ in range(120)]
    rows += [(None, "p", "only", 1), ("a", None, "only", None)]
    df = spark.createDataFrame(rows, "two string, four string, one string, y int")
    got = table(S.chi_squared_tests(df, ["two", "four", "one"], "y"))
    data = pd.DataFrame(rows, columns=["two", "four", "one", "y"])
    for c in ("two", "four"):
        cells = pd.crosstab(data[c], data["y"]).to_numpy().astype(float)
        chi2 = brute_chi2(cells)
        assert got[c]["chi2_statistic"] == pytest.approx(chi2)
        assert got[c]["degrees_of_freedom"] == cells.shape[0] - 1
        assert got[c]["effect_size"] == pytest.approx(math.sqrt(chi2 / cells.sum()))
        assert 0 <= got[c]["p_value"] <= 1
    assert got["one"]["chi2_statistic"] == 0 and got["one"]["p_value"] == 1 and got["one"]["effect_size"] is None


def test_known_two_by_two(spark):
    # a table whose uncorrected and corrected statistics differ visibly, with one empty cell
    rows = [("a", 0)] * 6 + [("b", 0)] * 3 + [("b", 1)] * 4
    got = S.chi_squared_tests(spark.createDataFrame(rows, "c string, y int"), ["c"], "y").first()
    assert got.chi2_statistic == pytest.approx(brute_chi2(np.array([[6.0, 0.0], [3.0, 4.0]])))


def test_most_frequent_fill(spark):
    rows = [("a", 0)] * 5 + [("b", 1)] * 5 + [(None, 1)] * 3
    df = spark.createDataFrame(rows, "c string, y int")
    cells = {(r.value, r.y): r.n for r in S.category_cells(df, ["c"], "y", "most_frequent").collect()}
    assert cells == {("a", 0): 5, ("a", 1): 3, ("b", 1): 5}
    shown = S.interpret_categorical(S.chi_squared_tests(df, ["c"], "y")).first()
    assert shown.significance == "Statistically significant" and shown.effect_magnitude == "large"


def test_pair_cells_count_every_pair(spark):
    draw = random.Random(2)
    rows = [(draw.choice(["p", "q", None]), draw.choice("xyz"), float(draw.randint(0, 99))) for _ in range(500)]
    df = spark.createDataFrame(rows, "a string, b string, n double").repartition(3)
    got = {(r.f1, r.b1, r.f2, r.b2): r.n for r in S.pair_cells(df, ["b", "a", "n"], ["n"], 10).collect()}
    low, high = min(r[2] for r in rows), max(r[2] for r in rows)
    binned = [(a, b, str(min(int((n - low) / (high - low) * 10), 9))) for a, b, n in rows]
    want = Counter()
    for i, j in combinations(range(3), 2):
        for r in binned:
            if r[i] is not None and r[j] is not None:
                want["abn"[i], r[i], "abn"[j], r[j]] += 1
    assert got == dict(want)


def test_pair_counter_keeps_nothing_between_blocks():
    batch = pa.RecordBatch.from_pydict({"a": pa.array([7, -8, 7, None], pa.int64()), "b": pa.array([1, 1, 2, 2], pa.int64())})
    for held, emitted in ((1, 9), (1000, 3)):
        out = pd.concat(b.to_pandas() for b in S._pair_counter(2, held)(iter([batch, batch, batch])))
        assert len(out) == emitted
        assert out.groupby(["a", "b"])["n"].sum().to_dict() == {(7, 1): 3, (-8, 1): 3, (7, 2): 3}


def test_pairs_with_a_text_of_its_own_in_every_row(spark):
    rows = [(f"text {i} " * 20, "p" if i % 3 else "q", i % 2) for i in range(3000)]
    df = spark.createDataFrame(rows, "a string, b string, c int").repartition(3)
    cells = S.pair_cells(df, ["a", "b", "c"])
    assert {(r.f1, r.f2): (r.k, r.n) for r in cells.groupBy("f1", "f2").agg(
        F.count("*").alias("k"), F.sum("n").alias("n")).collect()} == {
        ("a", "b"): (3000, 3000), ("a", "c"): (3000, 3000), ("b", "c"): (4, 3000)}
    assert {r.b1 for r in cells.filter("f1 = 'a' and f2 = 'b'").collect()} == {r[0] for r in rows}


def test_chi2_of_a_hot_binary_target_and_many_values(spark):
    rows = [(str(i % 700), int(i % 11 == 0)) for i in range(5000)]
    df = spark.createDataFrame(rows, "v string, y int")
    got = S.chi_squared_tests(df, ["v"], "y").first()
    counts = np.zeros((700, 2))
    for v, y in rows:
        counts[int(v), y] += 1
    flat = counts.sum(1, keepdims=True) * counts.sum(0) / 5000
    assert got.chi2_statistic == pytest.approx(((counts - flat) ** 2 / flat).sum()) and got.degrees_of_freedom == 699


def test_phik_of_copies_noise_and_constants(spark):
    draw = random.Random(6)
    rows = [(float(i % 97), float((i % 97) * 3), draw.random(), "k") for i in range(2000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d string")
    got = {(r.feature1, r.feature2): r.coefficient
           for r in S.phik_pairs(df, ["a", "b", "c", "d"], ["a", "b", "c"]).collect()}
    assert got["a", "b"] == pytest.approx(1.0, abs=1e-3) and got["a", "c"] < 0.2
    assert got["a", "d"] is None
    pairs = spark.createDataFrame([("a", "t", 0.9), ("b", "t", -0.95), ("a", "b", 0.5), ("c", "t", None)],
                                  "feature1 string, feature2 string, coefficient double")
    assert [r.feature for r in S.top_with_target(pairs, "t", 2).collect()] == ["a", "b"]
    assert [r.feature1 for r in S.top_interactions(pairs, 2).collect()] == ["b", "a"]
    importances = spark.createDataFrame([("a", 0.4)], "feature string, importance double")
    strong = S.collinear_pairs(pairs, importances).collect()
    assert [(r.feature1, r.importance1, r.importance2) for r in strong] == [("a", 0.4, 0.0)]


def test_curves_and_confusion(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "p double, y int")
    roc = {r.threshold: (r.fpr, r.tpr) for r in S.roc_points(df, "p", "y").collect()}
    assert roc == {None: (0, 0), 0.9: (0, 0.5), 0.8: (0.5, 1), 0.1: (1, 1)}
    pr = {r.threshold: (r.precision, r.recall) for r in S.pr_points(df, "p", "y").collect()}
    assert pr == {None: (1, 0), 0.9: (1, 0.5), 0.8: (pytest.approx(2 / 3), 1), 0.1: (0.5, 1)}
    cells = S.confusion(df.withColumn("d", (F.col("p") > 0.85).cast("int")), "y", "d")
    assert {(r.label, r.predicted): (r.n, r.share) for r in cells.collect()} == {
        (0, 0): (2, 0.5), (0, 1): (0, 0.0), (1, 0): (1, 0.25), (1, 1): (1, 0.25)}


def test_cv_stability(spark):
    scores = [0.70, 0.72, 0.68, 0.71, 0.69]
    row = S.cv_stability(spark.createDataFrame([(s,) for s in scores], "auc double")).first()
    half = 2.7764451 * np.std(scores, ddof=1) / math.sqrt(5)
    assert row.mean_score == pytest.approx(0.70) and row.std_score == pytest.approx(np.std(scores))
    assert row.ci_lower == pytest.approx(0.70 - half) and row.ci_upper == pytest.approx(0.70 + half)
    assert row.stability == "very stable"
    one = S.cv_stability(spark.createDataFrame([(0.7,)], "auc double")).first()
    assert one.ci_lower is None
