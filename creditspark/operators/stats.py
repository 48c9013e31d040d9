"""Significance tests, association measures and score diagnostics, many columns per job."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations, count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditspark.functions import columns as C
from creditspark.functions import numeric
from creditspark.operators.align import to_long
from creditspark.operators.joins import lookup_join, measured_bytes
from creditspark.operators.profile import most_frequent
from creditspark.operators.ranks import exact_quantiles, ranked_counts
from creditspark.session import materialize

PHIK_BINS = 10
MIN_GROUP = 30


@F.pandas_udf(T.DoubleType())
def _upper_two_sided(z: pd.Series) -> pd.Series:
    # small: one row per test
    return z.map(lambda v: None if pd.isna(v) else 1.0 if v <= 0 else numeric.normal_two_sided(v))


@F.pandas_udf(T.DoubleType())
def _chi2_tail(x: pd.Series, dof: pd.Series) -> pd.Series:
    # small: one row per test
    return pd.Series([None if pd.isna(a) or pd.isna(d) else numeric.chi2_tail(a, int(d))
                      for a, d in zip(x, dof)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _phik(chi2: pd.Series, n: pd.Series, r: pd.Series, k: pd.Series) -> pd.Series:
    # small: one row per feature pair
    found = [numeric.phik_from_chi2(*row[:2], int(row[2]), int(row[3])) for row in zip(chi2, n, r, k)]
    return pd.Series(found, dtype="float64")


@F.pandas_udf(T.DoubleType())
def _t_975(dof: pd.Series) -> pd.Series:
    # small: one row per model
    return dof.map(lambda d: None if pd.isna(d) or d < 1 else numeric.t_quantile(0.975, int(d)))


# ---- numeric predictor against a binary target ---------------------------------------------

def _predictor_rows(df: DataFrame, predictors: Sequence[str], target: str, missing: str) -> DataFrame:
    rows = to_long(df, predictors, [target])
    if missing == "drop":
        return rows.filter(F.col("value").isNotNull())
    if missing == "median_impute":
        medians = exact_quantiles(rows, "value", {"median": 0.5}, ["column"]).select("column", "median")
        return lookup_join(rows, medians, "column").select(
            target, "column", F.coalesce("value", "median").alias("value"))
    raise ValueError("missing must be 'drop' or 'median_impute'")


def _median_of(n: str, before: str, total: str) -> Column:
    """Median of a class from running counts of distinct values."""
    def value_at(position: Column) -> Column:
        here = (F.col(before) <= position) & (position < F.col(before) + F.col(n))
        return F.max(F.when(here, F.col("value")))

    middle = (F.col(total) - 1) / F.lit(2.0)
    return (value_at(F.floor(middle)) + value_at(F.ceil(middle))) / 2


def numeric_tests(df: DataFrame, predictors: Sequence[str], target: str, test: str = "mann_whitney",
                  missing: str = "drop", min_group: int = MIN_GROUP) -> DataFrame:
    """Mann-Whitney U (``mann_whitney``) or Mood's median test (``moods_median``), one row per predictor.

    Predictors with a class below ``min_group`` rows get an ``error`` text and NULL results.
    """
    ranked = ranked_counts(_predictor_rows(df, predictors, target, missing), "value", target, ["column"])
    if test == "mann_whitney":
        found = _mann_whitney(ranked)
    elif test == "moods_median":
        found = _moods_median(ranked)
    else:
        raise ValueError("test must be 'mann_whitney' or 'moods_median'")

    enough = (F.col("n0") >= min_group) & (F.col("n1") >= min_group)
    results = ["p_value", "statistic", "effect_size", "group0_median", "group1_median"]
    return found.select(
        "column", "test_name",
        *[F.when(enough, F.col(c)).alias(c) for c in results],
        F.col("n0").alias("group0_size"), F.col("n1").alias("group1_size"),
        F.when(~enough, F.concat(F.lit("Insufficient data. Group sizes: "), F.concat_ws(", ", "n0", "n1")))
        .alias("error"),
    )


def _mann_whitney(ranked: DataFrame) -> DataFrame:
    t = (F.col("n0") + F.col("n1")).cast("double")
    sums = ranked.groupBy("column").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"),
        F.sum(F.col("n0") * (F.col("before_n1") + F.col("n1") / 2.0)).alias("u"),
        F.sum(t * t * t - t).alias("ties"),
        _median_of("n0", "before_n0", "all_n0").alias("group0_median"),
        _median_of("n1", "before_n1", "all_n1").alias("group1_median"),
    )
    pairs = F.col("n0").cast("double") * F.col("n1")
    n = (F.col("n0") + F.col("n1")).cast("double")
    variance = pairs / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1)))
    z = F.try_divide(F.greatest(F.col("u"), pairs - F.col("u")) - pairs / 2 - 0.5, F.sqrt(variance))
    return sums.select(
        "column", F.lit("Mann-Whitney U test").alias("test_name"), "n0", "n1",
        F.col("u").alias("statistic"), _upper_two_sided(z).alias("p_value"),
        (2 * F.try_divide(F.col("u"), pairs) - 1).alias("effect_size"),
        "group0_median", "group1_median",
    )


def _moods_median(ranked: DataFrame) -> DataFrame:
    both = ranked.withColumns({
        "n": F.col("n0") + F.col("n1"),
        "before_n": F.col("before_n0") + F.col("before_n1"),
        "all_n": F.col("all_n0") + F.col("all_n1"),
    })
    centre = both.groupBy("column").agg(
        _median_of("n", "before_n", "all_n").alias("middle"),
        _median_of("n0", "before_n0", "all_n0").alias("group0_median"),
        _median_of("n1", "before_n1", "all_n1").alias("group1_median"),
        *[F.try_divide(F.sum(F.col("value") * F.col(n)), F.sum(n).cast("double")).alias(f"mean{n[1]}")
          for n in ("n0", "n1")],
    )
    above = F.col("value") > F.col("middle")
    parts = lookup_join(both, centre, "column").groupBy("column").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"),
        F.sum(F.when(above, F.col("n0")).otherwise(0)).alias("a0"),
        F.sum(F.when(above, F.col("n1")).otherwise(0)).alias("a1"),
        *[F.sum(F.col(n) * F.pow(F.col("value") - F.col(f"mean{n[1]}"), F.lit(2))).alias(f"ss{n[1]}")
          for n in ("n0", "n1")],
        *[F.max(c).alias(c) for c in ("group0_median", "group1_median", "mean0", "mean1")],
    )
    n = (F.col("n0") + F.col("n1")).cast("double")
    a = (F.col("a0") + F.col("a1")).cast("double")
    # in a 2x2 table all cells are equally far from their expectation
    gap = F.abs(F.col("a0") - F.try_divide(F.col("n0") * a, n))
    gap = gap - F.least(F.lit(0.5), gap)
    inverse = n * (F.try_divide(F.lit(1.0), F.col("n0")) + F.try_divide(F.lit(1.0), F.col("n1"))) \
        * (F.try_divide(F.lit(1.0), a) + F.try_divide(F.lit(1.0), n - a))
    chi2 = gap * gap * inverse
    spread = F.sqrt((F.try_divide(F.col("ss0"), F.col("n0") - 1.0)
                     + F.try_divide(F.col("ss1"), F.col("n1") - 1.0)) / 2)
    return parts.select(
        "column", F.lit("Mood's median test").alias("test_name"), "n0", "n1",
        chi2.alias("statistic"), _chi2_tail(chi2, F.lit(1)).alias("p_value"),
        F.try_divide(F.col("mean0") - F.col("mean1"), spread).alias("effect_size"),
        "group0_median", "group1_median",
    )


def interpret_numeric(results: DataFrame) -> DataFrame:
    """Rounded values with significance and effect labels; error rows keep NULLs."""
    by_rank = F.col("test_name") == "Mann-Whitney U test"
    effect = F.when(by_rank, C.rank_effect_tier("effect_size")).otherwise(C.median_effect_tier("effect_size"))
    return results.select(
        "column", "test_name",
        F.bround("p_value", 6).alias("p_value"), F.bround("statistic", 2).alias("statistic"),
        F.bround("effect_size", 4).alias("effect_size"), "group0_median", "group1_median",
        C.significance("p_value").alias("significance"), effect.alias("effect_magnitude"),
    )


# ---- contingency tables --------------------------------------------------------------------

def chi2_from_cells(cells: DataFrame, keys: Sequence[str], a: str, b: str, yates: bool) -> DataFrame:
    """Chi-squared of each contingency table given as one row per non-empty cell (count ``n``).

    Margins are aggregated and joined, so a table of any width is never gathered in one place. Margins of few values, as
    those of a binary target are, reach all cells by a measured broadcast; wide ones by a shuffle on (table, value).
    """
    keys = list(keys)
    cells = materialize(cells)
    rows = cells.groupBy(*keys, a).agg(F.sum("n").cast("double").alias("_ra"))
    cols = cells.groupBy(*keys, b).agg(F.sum("n").cast("double").alias("_cb"))
    inverse = F.sum(F.lit(1.0) / F.col("_ra"))
    per_row = rows.groupBy(*keys).agg(
        F.count("*").alias("r"), inverse.alias("_inv_a"), F.sum("_ra").alias("total"))
    per_col = cols.groupBy(*keys).agg(
        F.count("*").alias("k"), F.sum(F.lit(1.0) / F.col("_cb")).alias("_inv_b"))
    sizes = materialize(per_row.join(per_col, keys))

    e = F.col("_ra") * F.col("_cb") / F.col("total")
    placed = lookup_join(lookup_join(cells, rows, [*keys, a], "inner"), cols, [*keys, b], "inner")
    sums = (
        lookup_join(placed, sizes.select(*keys, "total"), keys, "inner", size=measured_bytes(sizes))
        .groupBy(*keys)
        .agg(F.sum(F.col("n") * F.col("n") / e).alias("_s"), F.max(F.abs(F.col("n") - e)).alias("_gap"))
    )
    plain = F.greatest(F.col("_s") - F.col("total"), F.lit(0.0))
    if yates:
        shrunk = F.col("_gap") - F.least(F.lit(0.5), F.col("_gap"))
        corrected = shrunk * shrunk * F.col("total") * F.col("_inv_a") * F.col("_inv_b")
        plain = F.when((F.col("r") == 2) & (F.col("k") == 2), corrected).otherwise(plain)
    return sums.join(sizes, keys).select(
        *keys, plain.alias("chi2"), ((F.col("r") - 1) * (F.col("k") - 1)).alias("dof"),
        F.col("total").alias("n"), "r", "k")


def category_cells(df: DataFrame, predictors: Sequence[str], target: str, missing: str = "drop") -> DataFrame:
    """Counts per (column, value, target)."""
    if missing not in ("drop", "most_frequent"):
        raise ValueError("missing must be 'drop' or 'most_frequent'")
    counts = (to_long(df, predictors, [target], "string")
              .groupBy("column", "value", target).agg(F.count("*").alias("n")))
    if missing == "most_frequent":
        modes = most_frequent(df, predictors).select("column", "mode")
        counts = lookup_join(counts, modes, "column").withColumn("value", F.coalesce("value", "mode"))
        counts = counts.groupBy("column", "value", target).agg(F.sum("n").alias("n"))
    return counts.filter(F.col("value").isNotNull() & F.col(target).isNotNull())


def chi_squared_tests(df: DataFrame, predictors: Sequence[str], target: str,
                      missing: str = "drop") -> DataFrame:
    """Chi-squared test of independence and Cramer's V, one row per predictor."""
    found = chi2_from_cells(category_cells(df, predictors, target, missing), ["column"], "value", target, True)
    shortest = F.least(F.col("r"), F.col("k")) - 1
    # a table with a single row or column has no freedom: the test gives chi2 0 and p 1
    p = F.when(F.col("dof") == 0, F.lit(1.0)).otherwise(_chi2_tail("chi2", "dof"))
    return found.select(
        "column", F.lit("Chi-squared test").alias("test_name"), p.alias("p_value"),
        F.col("chi2").alias("chi2_statistic"), F.col("dof").alias("degrees_of_freedom"),
        F.sqrt(F.try_divide(F.col("chi2"), F.col("n") * shortest)).alias("effect_size"),
    )


def interpret_categorical(results: DataFrame) -> DataFrame:
    return results.select(
        "column", "test_name",
        F.bround("p_value", 6).alias("p_value"),
        F.bround("chi2_statistic", 2).alias("chi2_statistic"), "degrees_of_freedom",
        F.bround("effect_size", 4).alias("effect_size"),
        C.significance("p_value").alias("significance"),
        C.association_tier("effect_size").alias("effect_magnitude"),
    )


# ---- phi_k ---------------------------------------------------------------------------------

def interval_bins(df: DataFrame, columns: Sequence[str], bins: int = PHIK_BINS) -> dict[str, Column]:
    """Equal-width bin number per interval column, from one pass for the limits."""
    if not columns:
        return {}
    ends = df.agg(*[f(F.col(c).cast("double")).alias(f"{c}__{n}")
                    for c in columns for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()
    out = {}
    for c in columns:
        low, high = ends[f"{c}__lo"], ends[f"{c}__hi"]
        x = F.col(c).cast("double")
        if low is None or low == high:
            number = F.lit(0)
        else:
            at = F.floor((x - F.lit(low)) / F.lit(high - low) * bins)
            number = F.least(at, F.lit(bins - 1))
        out[c] = F.when(x.isNotNull(), number.cast("string"))
    return out


def _coded(df: DataFrame, columns: Sequence[str], interval: Sequence[str], bins: int) -> tuple[DataFrame, DataFrame]:
    """The columns as 64-bit codes of their levels, and the table of levels (column, code, value).

    Codes are hashes, so no task holds a list of levels. The hash is seeded anew until no two levels of a column share a code.
    """
    numbered = interval_bins(df, list(interval), bins)
    texts = df.select(*[(numbered[c] if c in numbered else F.col(c).cast("string")).alias(c) for c in sorted(columns)])
    known = to_long(texts, sorted(columns), kind="string").filter(F.col("value").isNotNull())
    levels = materialize(known.distinct())
    for seed in count():
        def code(c: str) -> Column:
            return F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(seed), F.col(c)))

        table = levels.select("column", code("value").alias("code"), "value")
        if table.groupBy("column", "code").count().filter("count > 1").isEmpty():
            return texts.select(*[code(c).alias(c) for c in texts.columns]), table


def _pair_codes(coded: DataFrame) -> DataFrame:
    """Counts of every unordered column pair over codes: i, j (places of the columns), a, b, n."""
    counts = coded.mapInArrow(_pair_counter(len(coded.columns)), "i int, j int, a long, b long, n long")
    return counts.groupBy("i", "j", "a", "b").agg(F.sum("n").alias("n"))


def pair_cells(df: DataFrame, columns: Sequence[str], interval: Sequence[str] = (),
               bins: int = PHIK_BINS) -> DataFrame:
    """Contingency counts of every unordered column pair: f1, b1, f2, b2, n.

    Each task counts its own rows for all pairs and emits counts, so rows are never multiplied by pairs.
    """
    coded, levels = _coded(df, columns, interval, bins)
    cells, size = _pair_codes(coded), measured_bytes(levels)
    names = F.array(*[F.lit(c) for c in coded.columns])
    for side, at, code in (("1", "i", "a"), ("2", "j", "b")):
        named = levels.select(F.col("column").alias(f"f{side}"), F.col("code").alias(code), F.col("value").alias(f"b{side}"))
        cells = lookup_join(cells.withColumn(f"f{side}", names[F.col(at)]), named, [f"f{side}", code], "inner", size=size)
    return cells.select("f1", "b1", "f2", "b2", "n")


def _pair_counter(columns: int, held: int = 4_000_000):
    """Task function: counts of all pairs of code columns in blocks of rows of at most ``held`` codes.

    A block keeps nothing for the next one; Spark adds up the counts, and can spill them.
    """
    pairs = list(combinations(range(columns), 2))

    def numbered(block: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per column the distinct codes, and for every row the number of its code (-1 for NULL)."""
        out = []
        for column in block.columns:
            found = column.combine_chunks().dictionary_encode()
            out.append((found.dictionary.to_numpy(zero_copy_only=False),
                        found.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)))
        return out

    def counted(block: pa.Table) -> Iterator[pa.RecordBatch]:
        columns, rows, waiting = numbered(block), [], 0
        for i, j in pairs:
            (left, u), (right, v) = columns[i], columns[j]
            both = (u >= 0) & (v >= 0)
            cell = u[both] * len(right) + v[both]
            if len(left) * len(right) <= 4 * len(cell):
                n = np.bincount(cell)
                cell = np.flatnonzero(n)
                n = n[cell]
            else:
                cell, n = np.unique(cell, return_counts=True)
            if len(cell):
                rows.append((np.full(len(cell), i, np.int32), np.full(len(cell), j, np.int32), left[cell // len(right)],
                             right[cell % len(right)], n.astype(np.int64)))
                waiting += len(cell)
            if waiting > 1 << 17:
                yield emit(rows)
                rows, waiting = [], 0
        if rows:
            yield emit(rows)

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], ["i", "j", "a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows = [], 0
        for batch in batches:
            block.append(batch)
            rows += batch.num_rows
            if rows * columns >= held:
                yield from counted(pa.Table.from_batches(block))
                block, rows = [], 0
        if rows:
            yield from counted(pa.Table.from_batches(block))

    return run


def phik_pairs(df: DataFrame, columns: Sequence[str], interval: Sequence[str] = (),
               bins: int = PHIK_BINS) -> DataFrame:
    """phi_k of every unordered column pair: feature1 < feature2, coefficient."""
    coded, _ = _coded(df, columns, interval, bins)
    names = F.array(*[F.lit(c) for c in coded.columns])
    found = chi2_from_cells(_pair_codes(coded), ["i", "j"], "a", "b", False)
    return found.select(names[F.col("i")].alias("feature1"), names[F.col("j")].alias("feature2"),
                        _phik("chi2", "n", "r", "k").alias("coefficient"))


def top_with_target(pairs: DataFrame, target: str, n: int = 10) -> DataFrame:
    """Features most associated with the target."""
    other = F.when(F.col("feature1") == target, F.col("feature2")).otherwise(F.col("feature1"))
    return (pairs.filter((F.col("feature1") == target) | (F.col("feature2") == target))
            .select(other.alias("feature"), "coefficient")
            .orderBy(F.desc_nulls_last("coefficient"), "feature").limit(n))


def top_interactions(pairs: DataFrame, n: int = 10) -> DataFrame:
    """Pairs with the largest absolute coefficient."""
    return pairs.orderBy(F.desc_nulls_last(F.abs("coefficient")), "feature1", "feature2").limit(n)


def collinear_pairs(pairs: DataFrame, importances: DataFrame, above: float = 0.8) -> DataFrame:
    """Strongly related pairs with the importance of both sides (0 when unknown)."""
    strong = pairs.filter(F.col("coefficient") > above)
    for side in ("1", "2"):
        score = importances.select(F.col("feature").alias(f"feature{side}"),
                                   F.col("importance").alias(f"_i{side}"))
        strong = strong.join(score, f"feature{side}", "left")
    return strong.select(
        "feature1", "feature2", "coefficient",
        F.coalesce("_i1", F.lit(0.0)).alias("importance1"),
        F.coalesce("_i2", F.lit(0.0)).alias("importance2"),
    )


def _pair_moments(columns: Sequence[str]):
    """Task function: for every column pair, rows, means, and sums of products about the means of the task."""
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.triu_indices(len(columns), 1)
        shift, sums = None, None
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            known = ~np.isnan(x)
            if shift is None:  # about the mean, so that squares stay small
                shift = np.where(known, x, 0).sum(0) / np.maximum(known.sum(0), 1)
            x, mask = np.where(known, x - shift, 0), known.astype(float)
            parts = np.stack([mask.T @ mask, x.T @ mask, (x * x).T @ mask, x.T @ x])
            sums = parts if sums is None else sums + parts
        if sums is None:
            return
        n, of, squares, products = sums
        rows = np.maximum(n, 1)
        made = [n, of + n * shift[:, None], of.T + n * shift[None, :], squares - of ** 2 / rows,
                squares.T - of.T ** 2 / rows, products - of * of.T / rows]
        kept = n[first, second] > 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(first[kept]), pa.array(second[kept]), *[pa.array(m[first, second][kept]) for m in made]],
            ["i", "j", "n", "sx", "sy", "xx", "yy", "xy"])

    return moments


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every unordered column pair over the rows where both are known.

    Rows are multiplied inside each task as matrices, so work per row is one small matrix product however many
    columns there are; only sums per pair are shuffled. NaN counts as unknown.
    """
    names = sorted(columns)
    spark = df.sparkSession
    found = df.select(*[F.col(c).cast("double").alias(c) for c in names]).mapInArrow(
        _pair_moments(names), "i long, j long, n double, sx double, sy double, xx double, yy double, xy double")
    # what the tasks' means add to the sums about the overall mean
    between = {c: F.sum(F.col(a) * F.col(b) / F.col("n")) - F.sum(a) * F.sum(b) / F.sum("n")
               for c, a, b in (("xx", "sx", "sx"), ("yy", "sy", "sy"), ("xy", "sx", "sy"))}
    summed = found.groupBy("i", "j").agg(*[(F.sum(c) + between[c]).alias(c) for c in between])
    pairs = spark.createDataFrame([(i, j, names[i], names[j]) for i, j in combinations(range(len(names)), 2)],
                                  "i long, j long, feature1 string, feature2 string")
    scale = F.sqrt(F.col("xx")) * F.sqrt(F.col("yy"))
    return pairs.join(summed, ["i", "j"], "left").select(
        "feature1", "feature2", F.when(scale > 0, F.col("xy") / scale).alias("coefficient"))


# ---- score diagnostics ---------------------------------------------------------------------

def roc_points(df: DataFrame, score: str, label: str) -> DataFrame:
    """True and false positive rates at every distinct score, highest first, plus the (0, 0) start."""
    placed = ranked_counts(df, score, label)
    tp = F.col("all_n1") - F.col("before_n1")
    fp = F.col("all_n0") - F.col("before_n0")
    points = placed.select(F.col("value").cast("double").alias("threshold"),
                           F.try_divide(fp.cast("double"), F.col("all_n0").cast("double")).alias("fpr"),
                           F.try_divide(tp.cast("double"), F.col("all_n1").cast("double")).alias("tpr"))
    start = df.sparkSession.createDataFrame([(None, 0.0, 0.0)], points.schema)
    return points.unionByName(start)


def pr_points(df: DataFrame, score: str, label: str) -> DataFrame:
    """Precision and recall at every distinct score, plus the (recall 0, precision 1) end."""
    placed = ranked_counts(df, score, label)
    tp = (F.col("all_n1") - F.col("before_n1")).cast("double")
    flagged = tp + F.col("all_n0") - F.col("before_n0")
    points = placed.select(F.col("value").cast("double").alias("threshold"),
                           F.try_divide(tp, flagged).alias("precision"),
                           F.try_divide(tp, F.col("all_n1").cast("double")).alias("recall"))
    end = df.sparkSession.createDataFrame([(None, 1.0, 0.0)], points.schema)
    return points.unionByName(end)


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """The four cells with counts and shares of all rows; absent cells are 0."""
    cells = [(y, p) for y in (0, 1) for p in (0, 1)]
    one = df.filter(F.col(label).isin(0, 1) & F.col(predicted).isin(0, 1)).agg(
        *[F.count(F.when((F.col(label) == y) & (F.col(predicted) == p), 1)).alias(f"c{y}{p}")
          for y, p in cells], F.count("*").alias("total"))
    records = [F.struct(F.lit(y).alias("label"), F.lit(p).alias("predicted"), F.col(f"c{y}{p}").alias("n"),
                        F.try_divide(F.col(f"c{y}{p}").cast("double"), F.col("total").cast("double"))
                        .alias("share")) for y, p in cells]
    return one.select(F.explode(F.array(*records)).alias("r")).select("r.*")


def cv_stability(scores: DataFrame, score: str = "auc", keys: Sequence[str] = ()) -> DataFrame:
    """Mean, spread, 95 % t interval and stability tier of fold scores."""
    s = scores.groupBy(*keys).agg(
        F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("std_score"),
        F.stddev_samp(score).alias("_sd"), F.count(score).alias("n_folds"))
    half = _t_975(F.col("n_folds") - 1) * F.col("_sd") / F.sqrt(F.col("n_folds").cast("double"))
    cv = F.try_divide(F.col("std_score"), F.col("mean_score"))
    return s.select(
        *keys, "n_folds", "mean_score", "std_score",
        (F.col("mean_score") - half).alias("ci_lower"), (F.col("mean_score") + half).alias("ci_upper"),
        cv.alias("cv"), C.stability_tier(cv).alias("stability"))
