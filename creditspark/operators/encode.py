"""Categorical encoding with fitted levels: one-hot, dummies and m-estimate target means."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditspark.functions.columns import clean_name
from creditspark.operators.align import categorical_columns, numeric_columns, to_long
from creditspark.operators.joins import byte_estimate, lookup_join, measured_bytes
from creditspark.operators.profile import CARDINALITY_THRESHOLD
from creditspark.session import materialize
from creditspark.sources import files

LEVEL_BYTES = 1 << 20


def _unique_names(names: Sequence[str], taken: Sequence[str] = ()) -> list[str]:
    """The names, each with the first number from 2 on that makes it new, if it is not."""
    used = {n.lower() for n in taken}
    out = []
    for name in names:
        tried, number = name, 1
        while tried.lower() in used:
            number += 1
            tried = f"{name}_{number}"
        used.add(tried.lower())
        out.append(tried)
    return out


def fit_levels(df: DataFrame, columns: Sequence[str],
               order: Mapping[str, Sequence[str]] | None = None) -> dict[str, list[str]]:
    """Known values per column as text, sorted unless an order is given.

    Every value is to become a column, so this is for columns of few values; ``EncodingModel`` takes any. Values of
    more than ``LEVEL_BYTES`` are refused.
    """
    order = dict(order or {})
    open_columns = [c for c in columns if c not in order]
    found: dict[str, list[str]] = {c: [] for c in open_columns}
    if open_columns:
        values = materialize(to_long(df, open_columns, kind="string").filter(F.col("value").isNotNull()).distinct())
        size = measured_bytes(values)
        if size > LEVEL_BYTES:
            raise ValueError(f"{size} bytes of values are too many for a column each: use EncodingModel")
        for row in values.collect():
            found[row["column"]].append(row["value"])
    return {c: list(order[c]) if c in order else sorted(found[c]) for c in columns}


def indicator_columns(levels: Mapping[str, Sequence[str]], drop_first: bool = False,
                      taken: Sequence[str] = ()) -> list[Column]:
    """0/1 columns named ``<column>_<value>``, unlike each other and ``taken``; NULL and unknown values give 0."""
    pairs = [(c, v) for c, values in levels.items() for v in (values[1:] if drop_first else values)]
    names = _unique_names([clean_name(f"{c}_{v}") for c, v in pairs], taken)
    return [
        F.when(F.col(c).cast("string") == F.lit(v), 1).otherwise(0).cast("long").alias(name)
        for (c, v), name in zip(pairs, names)
    ]


def dummies(df: DataFrame, levels: Mapping[str, Sequence[str]], keep: Sequence[str] = (),
            drop_first: bool = True) -> DataFrame:
    """Numeric columns, then dummies of the fitted levels, with cleaned names."""
    given = [c for c in numeric_columns(df) if c not in keep]
    names = _unique_names([clean_name(c) for c in given], keep)
    numbers = [F.col(c).alias(name) for c, name in zip(given, names)]
    return df.select(*keep, *numbers, *indicator_columns(levels, drop_first, [*keep, *names]))


def category_sums(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Labelled rows and label sum per (column, value)."""
    return to_long(df, columns, [label], "string").groupBy("column", "value").agg(
        F.count(label).alias("n"), F.sum(F.col(label).cast("double")).alias("label_sum"))


def m_estimates(sums: DataFrame, prior: float, m: float = 1.0) -> DataFrame:
    """Smoothed label mean per known (column, value)."""
    smooth = (F.col("label_sum") + F.lit(m * prior)) / (F.col("n") + F.lit(m))
    return sums.filter(F.col("value").isNotNull()).select("column", "value", smooth.alias("encoding"))


@dataclass
class EncodingModel:
    """Levels of low-cardinality columns and label means of high-cardinality ones."""

    levels: dict[str, list[str]]
    high: list[str]
    table: DataFrame
    prior: float
    keep: list[str] = field(default_factory=list)
    sizes: dict[str, int] = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, label: str, keep: Sequence[str] = (),
            threshold: float = CARDINALITY_THRESHOLD, m: float = 1.0) -> EncodingModel:
        """``keep`` columns (key, label) pass through unencoded. One pass over the rows."""
        columns = [c for c in categorical_columns(df) if c not in {*keep, label}]
        if not columns:
            prior = df.agg(F.avg(F.col(label).cast("double")).alias("p")).first()["p"]
            empty = df.sparkSession.createDataFrame([], "column string, value string, encoding double")
            return cls({}, [], empty, prior, list(keep))
        sums = materialize(category_sums(df, columns, label))
        per_column = sums.groupBy("column").agg(
            F.count("value").alias("k"), F.sum("n").alias("n"), F.sum("label_sum").alias("y"),
            byte_estimate(sums).alias("bytes")).collect()
        known_values = {r["column"]: r["k"] for r in per_column}
        # every column covers all rows, so any of them gives the overall mean
        prior = per_column[0]["y"] / per_column[0]["n"]
        high = [c for c in columns if known_values[c] > threshold]
        levels: dict[str, list[str]] = {c: [] for c in columns if c not in high}
        known = sums.filter(F.col("value").isNotNull() & F.col("column").isin(list(levels)))
        # at most `threshold` values per low column
        for row in known.select("column", "value").collect():
            levels[row["column"]].append(row["value"])
        levels = {c: sorted(v) for c, v in levels.items()}
        table = m_estimates(sums.filter(F.col("column").isin(high)), prior, m)
        sizes = {r["column"]: r["bytes"] for r in per_column if r["column"] in high}
        return cls(levels, high, materialize(table), prior, list(keep), sizes)

    def transform(self, df: DataFrame, drop_first: bool = False) -> DataFrame:
        """Kept columns, numeric columns, one-hot columns, encoded columns; unknown values get the prior."""
        kept = [c for c in self.keep if c in df.columns]
        numbers = [c for c in numeric_columns(df) if c not in kept]
        out = df
        for c in self.high:
            means = self.table.filter(F.col("column") == c).select(
                F.col("value").alias(f"_key_{c}"), F.col("encoding").alias(f"_enc_{c}"))
            out = out.withColumn(f"_key_{c}", F.col(c).cast("string"))
            out = lookup_join(out, means, f"_key_{c}", size=self.sizes[c])
        return out.select(
            *kept, *numbers, *indicator_columns(self.levels, drop_first, [*kept, *numbers, *self.high]),
            *[F.coalesce(F.col(f"_enc_{c}"), F.lit(self.prior)).alias(c) for c in self.high])

    def save(self, spark: SparkSession, path: str) -> None:
        files.write_table(self.table, f"{path}/means")
        files.write_params(spark, {"levels": self.levels, "high": self.high, "prior": self.prior,
                                   "keep": self.keep, "sizes": self.sizes}, f"{path}/params")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> EncodingModel:
        p = files.read_params(spark, f"{path}/params")
        return cls(p["levels"], p["high"], files.read_table(spark, f"{path}/means"), p["prior"], p["keep"],
                   p["sizes"])
