"""Ordered operators without single-task windows.

Running totals over a whole table, or over a key that may hold a third of it, are taken in slices: rows are
range-partitioned by (keys, order) and written once, bucketed by their slice, so that windows inside a slice need no
further shuffle. Only a key that crosses the end of a slice needs anything from outside; there are fewer of those than
slices, and their offsets are broadcast. Inputs are first collapsed to distinct (keys, order) tuples, so equal rows never
pile up in a slice.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditspark.session import shared_dir

SLICE_ROWS = 100_000
RANGE_LETTERS = 32


def _range_columns(df: DataFrame, order: Sequence[str]) -> list[Column]:
    """Columns that order rows as ``order`` does, but for texts beyond ``RANGE_LETTERS``: those that agree so far are ties."""
    kinds, out, tied = dict(df.dtypes), [], F.lit(False)
    for c in order:
        text = kinds[c] in ("string", "binary")
        out.append(F.when(~tied, F.substring(c, 1, RANGE_LETTERS) if text else F.col(c)))
        if text:
            tied = tied | F.coalesce(F.length(c) > RANGE_LETTERS, F.lit(False))
            out.append(tied)
    return out


def in_slices(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` in slices of (keys, order), stored in files bucketed by ``_slice``.

    Ranges are cut by the first letters of texts, so that no long text is sampled to the driver.
    """
    ranged = df.repartitionByRange(*keys, *_range_columns(df, order)).withColumn("_slice", F.spark_partition_id())
    spark, name = df.sparkSession, f"slices_{uuid.uuid4().hex}"
    # twice as many buckets as slices: fewer buckets then hold several slices
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged.write.bucketBy(buckets, "_slice").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    stored = spark.table(name)
    # the frame keeps its files and buckets; only the name goes
    spark.sql(f"DROP TABLE {name}")
    return stored


def running_totals(df: DataFrame, order: Sequence[str], totals: Sequence[str],
                   keys: Sequence[str] = (), wanted: Callable[..., Column] | None = None) -> DataFrame:
    """Add ``before_<t>`` (sum over earlier rows of the key) and ``all_<t>`` (sum over the key) per total.

    ``df`` must hold one row per (keys, order). ``wanted`` (given the sum before a slice, the sum in it and the
    sum over the key, for the first total) keeps only the slices a selection needs; the others are never sorted.
    """
    keys, order = list(keys), list(order)
    slices = in_slices(df, keys, order)
    edges = _edges(slices, keys, totals)

    crossing = F.broadcast(edges)
    same = [slices[k].eqNullSafe(edges[f"_at_{k}"]) for k in keys]
    placed = slices.join(crossing, [slices["_slice"] == edges["_at_slice"], *same], "left")
    by_key = Window.partitionBy("_slice", *keys)
    if wanted is not None:
        # without an offset a key lies in one slice, which is then wanted whole
        first = totals[0]
        placed = placed.filter(F.col(f"_off_{first}").isNull() | wanted(
            F.col(f"_off_{first}"), F.col(f"_in_{first}"), F.col(f"_all_{first}")))
    inside = by_key.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = {}
    for t in totals:
        off = F.coalesce(F.col(f"_off_{t}"), F.lit(0))
        found[f"before_{t}"] = F.coalesce(F.sum(t).over(inside), F.lit(0)) + off
        found[f"all_{t}"] = F.coalesce(F.col(f"_all_{t}"), F.sum(t).over(by_key))
    return placed.select(*df.columns, *[c.alias(name) for name, c in found.items()])


def _edges(slices: DataFrame, keys: Sequence[str], totals: Sequence[str]) -> DataFrame:
    """For every key in more than one slice: the sums before, in and over all its slices; fewer keys than slices."""
    crossing = slices
    if keys:
        key = F.struct(*keys)
        ends = slices.groupBy("_slice").agg(F.min(key).alias("first"), F.max(key).alias("last"))
        met = ends.select(F.explode(F.array_distinct(F.array("first", "last"))).alias("key"))
        several = met.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
        listed = several.select(*[F.col("key")[k].alias(f"_met_{k}") for k in keys])
        crossing = slices.join(F.broadcast(listed), [slices[k].eqNullSafe(listed[f"_met_{k}"]) for k in keys], "left_semi")
    per_slice = crossing.groupBy("_slice", *keys).agg(*[F.sum(t).alias(f"_in_{t}") for t in totals])
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    earlier = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return per_slice.select(
        F.col("_slice").alias("_at_slice"), *[F.col(k).alias(f"_at_{k}") for k in keys],
        *[F.coalesce(F.sum(f"_in_{t}").over(earlier), F.lit(0)).alias(f"_off_{t}") for t in totals],
        *[F.sum(f"_in_{t}").over(whole).alias(f"_all_{t}") for t in totals],
        *[F.col(f"_in_{t}") for t in totals])


def auc_from_counts(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve from class counts per distinct ``value``, ties counted half."""
    placed = running_totals(counts, ["value"], ["n0", "n1"], keys)
    wins = F.sum(F.col("n1") * (F.col("before_n0") + F.col("n0") / 2.0))
    pairs = F.sum("n0").cast("double") * F.sum("n1")
    return placed.groupBy(*keys).agg(
        F.try_divide(wins, pairs).alias("auc"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def class_counts(df: DataFrame, value: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of class 0 and 1 per distinct non-NULL value; other labels are left out."""
    return (
        df.filter(F.col(value).isNotNull() & F.col(label).isin(0, 1))
        .groupBy(*keys, F.col(value).alias("value"))
        .agg(F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("n0"),
             F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("n1"))
    )


def ranked_counts(df: DataFrame, value: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per distinct value: rows of class 0 and 1 (``n0``, ``n1``), those below it, and class totals."""
    return running_totals(class_counts(df, value, label, keys), ["value"], ["n0", "n1"], keys)


def roc_auc(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve of the rows, per key; NULL when a class is absent."""
    return auc_from_counts(class_counts(df, score, label, keys), keys)


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float],
                    keys: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles, exact at any size: one output column per named probability."""
    counts = (df.filter(F.col(value).isNotNull())
              .groupBy(*keys, F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n")))

    def holds_a_position(before: Column, inside: Column, whole: Column) -> Column:
        found = F.lit(False)
        for p in probs.values():
            at = F.lit(float(p)) * (whole - 1)
            found = found | ((before <= F.ceil(at)) & (F.floor(at) < before + inside))
        return found

    placed = running_totals(counts, ["value"], ["n"], keys, holds_a_position)

    def value_at(position):
        here = (F.col("before_n") <= position) & (position < F.col("before_n") + F.col("n"))
        return F.max(F.when(here, F.col("value")))

    aggs = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("all_n") - 1)
        aggs += [value_at(F.floor(at)).alias(f"_lo_{name}"), value_at(F.ceil(at)).alias(f"_hi_{name}"),
                 F.max(at - F.floor(at)).alias(f"_w_{name}")]
    found = placed.groupBy(*keys).agg(*aggs, F.max("all_n").alias("n"))
    return found.select(*keys, "n", *[
        (F.col(f"_lo_{q}") + (F.col(f"_hi_{q}") - F.col(f"_lo_{q}")) * F.col(f"_w_{q}")).alias(q)
        for q in probs
    ])


def hash_order_numbers(df: DataFrame, strata: Sequence[str], key: str, seed: Column,
                       name: str = "_number") -> DataFrame:
    """Number the rows of each stratum from 0 in the order of ``md5(key-seed)``.

    The leading hash digits cut every stratum into even slices of about ``SLICE_ROWS`` rows at most, so one large
    stratum is no bottleneck. The numbering does not depend on the number of slices.
    """
    digits = max(1, math.ceil(math.log(max(1, df.count() / SLICE_ROWS), 16)) + 1)
    hashed = df.withColumn("_hash", F.md5(F.concat_ws("-", F.col(key).cast("string"), seed.cast("string"))))
    hashed = hashed.withColumn("_slice", F.substring("_hash", 1, digits))
    per_slice = hashed.groupBy(*strata, "_slice").agg(F.count("*").alias("_n"))
    earlier = (Window.partitionBy(*strata).orderBy("_slice")
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_slice.select(
        *strata, "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*strata, "_slice").orderBy("_hash", key)
    return (hashed.join(offsets, [*strata, "_slice"])
            .withColumn(name, F.row_number().over(inside) - 1 + F.col("_off"))
            .drop("_hash", "_slice", "_off"))


def stratified_folds(df: DataFrame, key: str, label: str, folds: int = 5, repeats: int = 1,
                     seed: int = 98) -> DataFrame:
    """Add ``fold_<r>`` per repeat; fold sizes of each class differ by at most one.

    Only key and label are numbered, for all repeats in one pass; the other columns are joined back once, by
    the unique key.
    """
    known = df.select(key, label).filter(F.col(label).isNotNull() & F.col(key).isNotNull())
    spread = known.withColumn("_repeat", F.explode(F.array(*[F.lit(r) for r in range(repeats)])))
    numbered = hash_order_numbers(spread, [label, "_repeat"], key, F.lit(seed) + F.col("_repeat"))
    fold = F.pmod("_number", F.lit(folds)).cast("int")
    out = numbered.groupBy(key, label).agg(
        *[F.max(F.when(F.col("_repeat") == r, fold)).alias(f"fold_{r}") for r in range(repeats)])
    rest = [c for c in df.columns if c != label]
    return out if rest == [key] else out.join(df.select(*rest), key)


def holdout_flag(key: str, seed: int = 98, train_percent: int = 80) -> Column:
    """1 for the training part of a stable hash split, 0 for the validation part."""
    digits = F.substring(F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed)))), 1, 8)
    return (F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(100)) < train_percent).cast("int")


def ordered_halves(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """Mean of ``value`` in the later half minus the earlier half of each key's ordered rows.

    Fewer than two rows give 0; with an odd count the extra row is in the later half; NULL values are
    skipped and a half of only NULLs gives NULL. Rows without a key are ignored. Equal rows count together, and a
    key of any size lies over as many slices as it fills.
    """
    order = [c for c in order if c != value]
    rows = df.filter(F.col(key).isNotNull())
    counts = rows.groupBy(key, *order, value).agg(F.count("*").alias("n"))
    placed = running_totals(counts, [*order, value], ["n"], [key])
    cut = F.floor(F.col("all_n") / 2)
    in_early = F.greatest(F.least(cut - F.col("before_n"), F.col("n")), F.lit(0))
    known = F.col(value).isNotNull()

    def half(weight: Column) -> Column:
        return F.try_divide(F.sum(F.when(known, F.col(value) * weight)),
                            F.sum(F.when(known, weight).otherwise(0)).cast("double"))

    halves = placed.groupBy(key).agg(
        F.max("all_n").alias("_n"), half(in_early).alias("_early"), half(F.col("n") - in_early).alias("_late"))
    trend = F.when(F.col("_n") < 2, F.lit(0.0)).otherwise(F.col("_late") - F.col("_early"))
    return halves.select(key, trend.alias("trend"))
