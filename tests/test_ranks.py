from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditspark.operators import ranks as R


def brute_auc(rows):
    ones = [s for s, y in rows if y == 1]
    zeros = [s for s, y in rows if y == 0]
    return sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))


@pytest.fixture(scope="module")
def scored():
    draw = random.Random(3)
    return [(g, round(draw.random(), 2), int(draw.random() < 0.3)) for g in "ab" for _ in range(300)]


def test_running_totals_against_brute_force(spark):
    draw = random.Random(1)
    rows = sorted({(draw.choice("xyz"), draw.randint(0, 60)): draw.randint(1, 5) for _ in range(400)}.items())
    data = [(k, v, n) for (k, v), n in rows]
    df = spark.createDataFrame(data, "k string, v int, n int")
    got = {(r.k, r.v): (r.before_n, r.all_n) for r in R.running_totals(df, ["v"], ["n"], ["k"]).collect()}
    for k, v, _ in data:
        before = sum(n for kk, vv, n in data if kk == k and vv < v)
        assert got[k, v] == (before, sum(n for kk, _, n in data if kk == k))
    whole = {r.v: r.before_m for r in R.running_totals(
        df.groupBy("v").agg(F.sum("n").alias("m")), ["v"], ["m"]).collect()}
    assert whole[max(whole)] == sum(n for _, v, n in data if v < max(whole))


def test_roc_auc_is_exact_with_ties(spark, scored):
    df = spark.createDataFrame(scored, "g string, s double, y int")
    got = {r.g: r.auc for r in R.roc_auc(df, "s", "y", ["g"]).collect()}
    for g in "ab":
        assert got[g] == pytest.approx(brute_auc([(s, y) for gg, s, y in scored if gg == g]), abs=1e-12)


def test_roc_auc_without_a_class_or_with_nulls(spark):
    df = spark.createDataFrame([(0.1, 0), (None, 1), (0.5, 0), (0.3, None)], "s double, y int")
    assert R.roc_auc(df, "s", "y").first().auc is None


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_exact_quantiles_match_linear_interpolation(spark, n):
    draw = random.Random(n)
    data = [float(draw.randint(0, 40)) for _ in range(n)]
    df = spark.createDataFrame([("c", x) for x in data] + [("c", None)], "k string, x double")
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    row = R.exact_quantiles(df, "x", probs, ["k"]).first()
    assert row.n == n
    for name, p in probs.items():
        assert row[name] == pytest.approx(np.quantile(data, p))


def test_folds_are_balanced_and_repeatable(spark):
    rows = [(i, int(i % 7 == 0)) for i in range(211)]
    df = spark.createDataFrame(rows, "id int, y int")
    first = R.stratified_folds(df, "id", "y", 5, 2).cache()
    for r in (0, 1):
        sizes = first.groupBy("y", f"fold_{r}").count().collect()
        for y in (0, 1):
            counts = [s["count"] for s in sizes if s.y == y]
            assert len(counts) == 5 and max(counts) - min(counts) <= 1
    again = R.stratified_folds(df.repartition(3), "id", "y", 5, 2)
    assert first.exceptAll(again).isEmpty() and first.count() == 211
    assert not first.filter("fold_0 <> fold_1").isEmpty()


def test_folds_follow_the_hash_order(spark):
    import hashlib

    rows = [(i, 0) for i in range(50)]
    got = R.stratified_folds(spark.createDataFrame(rows, "id int, y int"), "id", "y", 5, 1, 98).collect()
    order = sorted(range(50), key=lambda i: (hashlib.md5(f"{i}-98".encode()).hexdigest(), i))
    assert {r.id: r.fold_0 for r in got} == {i: n % 5 for n, i in enumerate(order)}


def halves(rows):
    """Brute-force later-minus-earlier mean per key."""
    out = {}
    for key in {r[0] for r in rows if r[0] is not None}:
        mine = sorted((r[1:] for r in rows if r[0] == key),
                      key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0))
        cut = len(mine) // 2
        mean = lambda part: np.mean(part) if part else None
        a = mean([r[2] for r in mine[:cut] if r[2] is not None])
        b = mean([r[2] for r in mine[cut:] if r[2] is not None])
        out[key] = 0.0 if len(mine) < 2 else None if a is None or b is None else b - a
    return out


@pytest.mark.parametrize("slices", ["1", "4", "40"])
def test_ordered_halves_in_few_and_many_slices(spark, slices):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    draw = random.Random(9)
    rows = [(1, draw.randint(-20, 0), draw.randint(1, 3), draw.choice([None, 1.0, 2.0, 9.0])) for _ in range(151)]
    rows += [(1, -5, 2, 4.0)] * 60  # equal rows
    rows += [(k, -i, k, float(i)) for k in (2, 3, 4) for i in range(k - 1)]
    rows += [(5, -1, 1, None), (5, 0, 1, None), (None, 0, 1, 1.0)]
    df = spark.createDataFrame(rows, "id int, month int, prev int, x double")
    spark.conf.set("spark.sql.shuffle.partitions", slices)
    got = {r.id: r.trend for r in R.ordered_halves(df, "id", ["month", "prev"], "x").collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = halves(rows)
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == (None if want[key] is None else pytest.approx(want[key]))


def test_two_and_three_rows_split_one_one_and_one_two(spark):
    df = spark.createDataFrame([(1, 1, 10.0), (1, 2, 4.0), (2, 1, 10.0), (2, 2, 4.0), (2, 3, 8.0)],
                               "id int, m int, x double")
    got = {r.id: r.trend for r in R.ordered_halves(df, "id", ["m"], "x").collect()}
    assert got == {1: -6.0, 2: -4.0}


def test_holdout_share(spark):
    df = spark.range(5000).select(R.holdout_flag("id").alias("f"))
    assert df.agg(F.avg("f")).first()[0] == pytest.approx(0.8, abs=0.03)


def test_running_totals_shuffle_once_and_keep_long_texts_out_of_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    draw = random.Random(5)
    long = "same beginning of every text, " * 30
    rows = [(draw.choice(["hot", "hot", "hot", "b", None]), draw.choice([None, 1, 2]), long + str(draw.randint(0, 99)), i, 1) for i in range(400)]
    rows += [("hot", 3, "x" * 1_000_000, 1000 + i, 1) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, turn int, text string, row int, n int").repartition(4)
    placed = R.running_totals(df, ["turn", "text", "row"], ["n"], ["k"])
    # windows read the stored slices as they lie
    assert "hashpartitioning(_slice" not in placed._jdf.queryExecution().executedPlan().toString()
    got = {r.row: (r.before_n, r.all_n) for r in placed.collect()}
    for k in ("hot", "b", None):
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        assert [got[r[3]] for r in mine] == [(i, len(mine)) for i in range(len(mine))]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("slices_")]
    columns = R._range_columns(df, ["turn", "text", "row"])
    assert max(len(str(v)) for r in df.select(*columns).collect() for v in r) <= R.RANGE_LETTERS
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
