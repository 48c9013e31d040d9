"""Data-quality and distribution reports over many columns, each in a fixed number of jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditspark.functions.columns import missing_tier, variant_base
from creditspark.operators.align import NUMERIC, to_long
from creditspark.operators.joins import lookup_join
from creditspark.operators.ranks import exact_quantiles
from creditspark.session import materialize

SKEW_THRESHOLD = 0.5
CARDINALITY_THRESHOLD = 10


def summarize(df: DataFrame, columns: Sequence[str], stats: dict) -> DataFrame:
    """One row per column with the given ``{name: value -> aggregate}`` statistics of its values as double.

    Columns are stacked first, so the aggregate has as many functions as there are statistics however wide
    the frame is, and every column is covered by the same pass.
    """
    value = F.col("value")
    return to_long(df, columns).groupBy("column").agg(*[f(value).alias(name) for name, f in stats.items()])


def null_flags(df: DataFrame, columns: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    """One row per (row, column) with 1 in ``value`` where the column is NULL."""
    flags = df.select(*ids, *[F.col(c).isNull().cast("int").alias(c) for c in columns])
    return flags.unpivot(list(ids), list(columns), "column", "value")


# ---- duplicates ----------------------------------------------------------------------------

def _copies(df: DataFrame) -> DataFrame:
    return df.groupBy(*df.columns).agg(F.count("*").alias("copies"))


def duplicate_census(df: DataFrame) -> DataFrame:
    """Total rows, rows beyond the first of each group of equal rows, and members of such groups."""
    n = F.col("copies")
    return _copies(df).agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(n - 1), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).alias("duplicate_members"))


def duplicate_rows(df: DataFrame, n: int = 10) -> DataFrame:
    """First ``n`` members of duplicate groups, ordered by all columns."""
    groups = _copies(df).filter(F.col("copies") > 1).orderBy(*df.columns).limit(n)
    members = F.explode(F.sequence(F.lit(1), F.least(F.col("copies"), F.lit(n)).cast("int")))
    return groups.select(*df.columns, members.alias("_member")).orderBy(*df.columns).limit(n).select(*df.columns)


# ---- missing values ------------------------------------------------------------------------

def _null_counts(df: DataFrame, side: str) -> DataFrame:
    counts = null_flags(df, df.columns).groupBy("column").agg(
        F.sum("value").alias("missing"), F.count("*").alias("rows"))
    percent = F.bround(F.try_divide(F.col("missing").cast("double"), F.col("rows").cast("double")) * 100, 1)
    return counts.select("column", F.col("missing").alias(f"{side}_count"), percent.alias(f"{side}_percent"))


def missing_report(train: DataFrame, test: DataFrame, missing_only: bool = False) -> DataFrame:
    """Missing counts and percents of both frames per column, most missing first.

    A column absent from one frame has NULL cells there.
    """
    types = F.create_map(*[F.lit(text) for pair in train.dtypes for text in pair])
    both = _null_counts(train, "train").join(_null_counts(test, "test"), "column", "full_outer")
    if missing_only:
        both = both.filter((F.col("train_count") > 0) | (F.col("test_count") > 0))
    return both.select("column", F.try_element_at(types, F.col("column")).alias("data_type"),
                       "train_count", "train_percent", "test_count", "test_percent") \
        .orderBy(F.desc_nulls_last("train_percent"), "column")


def missing_tiers(report: DataFrame) -> DataFrame:
    """The report with its High / Medium / Low tier."""
    parts = [F.coalesce(F.col(c), F.lit(0.0)) for c in ("train_percent", "test_percent")]
    return report.withColumn("category", missing_tier(*parts))


def missing_importances(report: DataFrame, importances: DataFrame, text_types: Sequence[str] = ("string",)) -> DataFrame:
    """Numeric columns with missing values, their tier and importance, most important first."""
    gaps = missing_tiers(report.filter(
        ~F.col("data_type").isin(*text_types) & ((F.col("train_count") > 0) | (F.col("test_count") > 0))))
    known = importances.select(F.col("feature").alias("column"), "importance")
    return (gaps.join(known, "column", "left")
            .select("column", "train_percent", "test_percent", "category", "importance")
            .orderBy(F.desc_nulls_last("importance"), "column"))


def missing_tier_census(report: DataFrame) -> DataFrame:
    return missing_tiers(report).groupBy("category").agg(F.count("*").alias("n_columns"))


# ---- descriptions --------------------------------------------------------------------------

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def describe_numeric(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Count, mean, sample deviation, min, quartiles and max per column.

    Quartiles are exact; ``approximate`` takes them from sketches in the same pass as the moments.
    """
    stats = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    if approximate:
        sketches = {q: lambda x, p=p: F.percentile_approx(x, p, 10_000) for q, p in QUARTILES.items()}
        return summarize(df, columns, stats | sketches).select(
            "column", "count", "mean", "std", "min", *QUARTILES, "max")
    moments = summarize(df, columns, stats)
    quartiles = exact_quantiles(to_long(df, columns), "value", QUARTILES, ["column"]).drop("n")
    return moments.join(quartiles, "column", "left").select(
        "column", "count", "mean", "std", "min", *QUARTILES, "max")


def value_counts_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per (column, value) as text, NULL included."""
    return to_long(df, columns, kind="string").groupBy("column", "value").agg(F.count("*").alias("n"))


def most_frequent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mode of each column as text and its frequency; the smallest of tied values wins."""
    first = F.min(F.struct((-F.col("n")).alias("minus_n"), F.col("value").alias("value")))
    return (value_counts_long(df, columns).filter(F.col("value").isNotNull())
            .groupBy("column").agg(first.alias("m"))
            .select("column", F.col("m.value").alias("mode"), (-F.col("m.minus_n")).alias("mode_count")))


def describe_categorical(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, distinct values, mode and its frequency per column."""
    known = value_counts_long(df, columns).filter(F.col("value").isNotNull())
    first = F.min(F.struct((-F.col("n")).alias("minus_n"), F.col("value").alias("value")))
    return known.groupBy("column").agg(
        F.sum("n").alias("count"), F.count("*").alias("n_unique"), first.alias("m")
    ).select("column", "count", "n_unique", F.col("m.value").alias("top"), (-F.col("m.minus_n")).alias("freq"))


def distinct_listing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every value of every column, one row each, with the column's number of values (NULL is one)."""
    counts = materialize(value_counts_long(df, columns))
    sizes = counts.groupBy("column").agg(F.count("*").alias("unique_values_count"))
    return lookup_join(counts.select("column", "value"), sizes, "column").select(
        "column", "unique_values_count", "value")


def cardinality_split(df: DataFrame, columns: Sequence[str],
                      threshold: float = CARDINALITY_THRESHOLD, approximate: bool = False) -> DataFrame:
    """Distinct non-NULL values per column and whether that is ``high`` (above the threshold) or ``low``."""
    if approximate:
        sizes = to_long(df, columns, kind="string").groupBy("column").agg(
            F.approx_count_distinct("value").alias("n_unique"))
    else:
        known = value_counts_long(df, columns)
        sizes = known.groupBy("column").agg(F.count("value").alias("n_unique"))
    return sizes.select("column", "n_unique",
                        F.when(F.col("n_unique") > threshold, "high").otherwise("low").alias("cardinality"))


# ---- counts and proportions ----------------------------------------------------------------

def value_counts_percent(df: DataFrame, column: str) -> DataFrame:
    """Counts of non-NULL values and their percent of the non-NULL total, most frequent first."""
    counts = materialize(
        df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("value_count")))
    total = counts.agg(F.sum("value_count").alias("n")).first()["n"]
    percent = F.bround(F.col("value_count") / F.lit(float(total or 1)) * 100, 2)
    return counts.select(column, "value_count", percent.alias("percent_of_total")) \
        .orderBy(F.desc("value_count"), column)


def proportions(df: DataFrame, predictor: str, target: str, classes: Sequence | None = None) -> DataFrame:
    """Share of each target class within each predictor value.

    With ``classes`` every value has a row for each of them, absent pairs with a NULL share; without, a row for each
    pair that occurs.
    """
    cells = (df.filter(F.col(predictor).isNotNull() & F.col(target).isNotNull())
             .groupBy(predictor, target).agg(F.count("*").alias("n")))
    if classes is None:
        cells = materialize(cells)
        whole = cells.groupBy(predictor).agg(F.sum("n").alias("_all"))
        return cells.join(whole, predictor).select(
            predictor, target, (F.col("n") / F.col("_all").cast("double")).alias("proportion"))
    counts = cells.groupBy(predictor).agg(
        F.sum("n").alias("_all"),
        *[F.sum(F.when(F.col(target) == F.lit(v), F.col("n"))).alias(f"_c{i}") for i, v in enumerate(classes)])
    pairs = F.array(*[F.struct(F.lit(v).alias(target), F.col(f"_c{i}").alias("n")) for i, v in enumerate(classes)])
    return counts.select(predictor, "_all", F.explode(pairs).alias("p")).select(
        predictor, F.col(f"p.{target}").alias(target),
        (F.col("p.n") / F.col("_all").cast("double")).alias("proportion"))


def crosstab(df: DataFrame, predictor: str, target: str, classes: Sequence) -> DataFrame:
    """Contingency table with one column per target class."""
    known = df.filter(F.col(predictor).isNotNull() & F.col(target).isNotNull())
    return known.groupBy(predictor).pivot(target, list(classes)).agg(F.count(F.lit(1))).fillna(0)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight per class, and the ratio of the largest to the smallest class."""
    counts = materialize(df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")))
    totals = counts.agg(F.sum("n").alias("all_n"), F.count("*").alias("k"),
                        F.max("n").alias("most"), F.min("n").alias("least")).first()
    whole, k = float(totals["all_n"] or 0), float(totals["k"] or 1)
    ratio = float(totals["most"] or 0) / float(totals["least"] or 1)
    return counts.select(label, "n", (F.lit(whole / k) / F.col("n")).alias("weight"),
                         F.lit(ratio).alias("weight_ratio"))


# ---- skewness ------------------------------------------------------------------------------

def corrected_skewness(c: Column | str) -> Column:
    """Bias-corrected sample skewness; NULL below three rows, 0 for a constant column."""
    c = F.col(c) if isinstance(c, str) else c
    n = F.count(c).cast("double")
    value = F.skewness(c) * F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    value = F.coalesce(F.nanvl(value, F.lit(None).cast("double")), F.lit(0.0))
    return F.when(F.count(c) >= 3, value)


def skewness_report(df: DataFrame, columns: Sequence[str], threshold: float = SKEW_THRESHOLD) -> DataFrame:
    found = summarize(df, columns, {"skewness": corrected_skewness})
    skewed = F.coalesce(F.abs("skewness") > threshold, F.lit(False)).cast("int")
    return found.select("column", "skewness", skewed.alias("skewed"))


def skewed_columns(df: DataFrame, columns: Sequence[str], threshold: float = SKEW_THRESHOLD) -> list[str]:
    """Names (in the given order) of columns whose absolute skewness is above the threshold."""
    flags = {r["column"] for r in skewness_report(df, columns, threshold).filter("skewed = 1").collect()}
    return [c for c in columns if c in flags]


# ---- fills ---------------------------------------------------------------------------------

def column_means(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    one = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns]).first()
    return one.asDict()


def column_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    found = exact_quantiles(to_long(df, columns), "value", {"median": 0.5}, ["column"])
    medians = {r["column"]: r["median"] for r in found.collect()}
    return {c: medians.get(c) for c in columns}


def column_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    modes = {r["column"]: r["mode"] for r in most_frequent(df, columns).collect()}
    return {c: modes.get(c) for c in columns}


def fill(df: DataFrame, values: dict) -> DataFrame:
    """Replace NULLs by the given constants, which may be of the column's type or text castable to it."""
    kinds = dict(df.dtypes)
    widen = {f.name for f in df.schema.fields
             if isinstance(f.dataType, NUMERIC) or f.dataType.typeName() == "integer"}
    out = []
    for c in df.columns:
        if values.get(c) is None:
            out.append(F.col(c))
            continue
        real = c in widen and isinstance(values[c], float)
        kind = "double" if real else kinds[c]
        out.append(F.coalesce(F.col(c).cast(kind), F.lit(values[c]).cast(kind)).alias(c))
    return df.select(*out)


# ---- top lists and variants ----------------------------------------------------------------

def ranked(df: DataFrame, score: str, name: str, n: int | None = None, absolute: bool = False) -> DataFrame:
    """Rows by descending score with the name as tie-break, optionally the first ``n``."""
    key = F.abs(score) if absolute else F.col(score)
    out = df.orderBy(F.desc_nulls_last(key), name)
    return out if n is None else out.limit(n)


def top_fraction(df: DataFrame, score: str, name: str, fraction: float = 0.90) -> DataFrame:
    """The first ``int(rows * fraction)`` rows by descending score."""
    stored = materialize(df)
    return ranked(stored, score, name, int(stored.count() * fraction))


def variants_to_remove(variants: DataFrame, importances: DataFrame) -> DataFrame:
    """All but the most important variant of each measure.

    ``variants`` has ``feature`` and ``position``; a feature without importance counts 0 and the earliest
    listed wins a tie. Measures with one variant are untouched.
    """
    scored = variants.join(importances.select("feature", "importance"), "feature", "left").select(
        "feature", "position", variant_base("feature").alias("base"),
        F.coalesce("importance", F.lit(0.0)).alias("importance"))
    best = Window.partitionBy("base").orderBy(F.desc("importance"), "position")
    return (scored.withColumn("_rn", F.row_number().over(best)).filter(F.col("_rn") > 1)
            .select("feature", "base", "importance"))


# ---- chart data ----------------------------------------------------------------------------

def box_stats(df: DataFrame, value: str, group: str) -> DataFrame:
    """Quartiles, whiskers (extreme values within 1.5 interquartile ranges) and outlier count per group."""
    known = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).select(group, value)
    quartiles = exact_quantiles(known, value, QUARTILES, [group])
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    inside = (F.col(value) >= F.col("q25") - reach) & (F.col(value) <= F.col("q75") + reach)
    return lookup_join(known, quartiles, group).groupBy(group).agg(
        *[F.max(q).alias(q) for q in QUARTILES],
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.count(F.when(~inside, 1)).alias("n_outliers"))


def _limits(df: DataFrame, value: Column) -> tuple[float | None, float | None]:
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    return ends["lo"], ends["hi"]


def histogram(df: DataFrame, value: Column | str, group: str | None = None, bins: int = 30) -> DataFrame:
    """Counts per equal-width bin (the last one closed), optionally per group."""
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    low, high = _limits(df, x)
    width = (high - low) / bins if low is not None and high > low else 1.0
    start = low if low is not None else 0.0
    number = F.least(F.floor((x - F.lit(start)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    keys = [group] if group else []
    return (df.filter(x.isNotNull()).groupBy(number.alias("bin"), *keys).agg(F.count("*").alias("n"))
            .select("bin", *keys, (F.lit(start) + F.col("bin") * F.lit(width)).alias("bin_start"), "n"))


def density(df: DataFrame, value: str, group: str, points: int = 50) -> DataFrame:
    """Gaussian kernel density per group, with Scott's bandwidth, on a grid over the group's own range.

    The grid reaches three bandwidths beyond the smallest and largest value. Every row counts in every point of its
    group, summed before the shuffle. A group of one value, or one row, has no bandwidth and a NULL density.
    """
    known = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull())
    x = F.col(value).cast("double")
    spread = F.stddev_samp(x) * F.pow(F.count("*").cast("double"), F.lit(-0.2))
    facts = known.groupBy(group).agg(
        F.count("*").alias("_n"), F.min(x).alias("_lo"), F.max(x).alias("_hi"), spread.alias("_h"))
    start = F.col("_lo") - 3 * F.coalesce("_h", F.lit(0.0))
    facts = facts.select(group, "_n", F.when(F.col("_h") > 0, F.col("_h")).alias("_h"), start.alias("_from"),
                         ((F.col("_hi") + 3 * F.coalesce("_h", F.lit(0.0)) - start) / (points - 1)).alias("_step"))
    at = [F.col("_from") + i * F.col("_step") for i in range(points)]
    sums = lookup_join(known.select(group, x.alias("_x")), facts, group).groupBy(group).agg(
        *[F.first(c).alias(c) for c in ("_n", "_h", "_from", "_step")],
        F.array(*[F.sum(F.exp(-0.5 * F.pow((a - F.col("_x")) / F.col("_h"), F.lit(2.0)))) for a in at]).alias("_sums"))
    spots = sums.select("*", F.posexplode("_sums").alias("point", "_sum"))
    scale = F.col("_n") * F.col("_h") * F.lit((2 * 3.141592653589793) ** 0.5)
    return spots.select(group, "point", (F.col("_from") + F.col("point") * F.col("_step")).alias("x"),
                        (F.col("_sum") / scale).alias("density"))
