"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate: its target share of all bytes, divided by its share of them today. Every
document draws its number of copies by inverting the Poisson distribution of that mean at a uniform number made from a
hash of seed and id. Documents are then exploded by their counts, and the copies are dealt out and sorted by another
hash, which shuffles them over the whole table.

The distribution function is built once per source and joined to the documents, so a document only compares one number
with a short list. Means above ``SPLIT`` are drawn as a sum of equal smaller means, which is the same distribution.

A null source is a source of its own, and so is the empty one. A null text counts one byte, like an empty one. Rows
with equal ids draw equal counts; a null id draws like the id "null". Sources without a target get ``other``; a weight
of 0 leaves a source out. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditspark.llm.rows import free_name, shield
from creditspark.operators.joins import lookup_join

SPLIT = 32.0
GRID = float(1 << 52)


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) on a grid of 2^-52, from the MD5 of ``seed`` and the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *parts)), 1, 13), 16, 10).cast("double") / GRID


def _id_text(key: str) -> Column:
    return F.coalesce(F.col(key).cast("string"), F.lit("null"))


def source_rates(docs: DataFrame, weights: dict[str, float], other: float = 1.0, epochs: float = 1.0,
                 source: str = "source", text: str = "text") -> DataFrame:
    """Per source: documents, bytes, target share and mean repetition ``rate`` for ``epochs`` times the present bytes."""
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 1
    sizes = docs.groupBy(F.col(source).alias("_source")).agg(F.count("*").alias("documents"), F.sum(size).alias("bytes"))
    weight = F.lit(float(other))
    for name, value in weights.items():
        weight = F.when(F.col("_source") == name, F.lit(float(value))).otherwise(weight)
    total = sizes.withColumn("weight", weight)
    whole = total.agg(F.sum("bytes").alias("bytes"), F.sum("weight").alias("weight")).first()
    share = F.col("weight") / F.lit(whole["weight"])
    return total.select("_source", "documents", "bytes", share.alias("share"),
                        (share * F.lit(float(epochs) * (whole["bytes"] or 0)) / F.col("bytes")).alias("rate"))


def _distribution(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... as far as the grid of draws can tell it from 1."""
    steps = F.sequence(F.lit(1), F.ceil(mean + 10 * F.sqrt(mean) + 25).cast("int"))
    first = F.exp(-mean)
    start = F.struct(first.alias("term"), F.array(first).alias("sums"))

    def add(state: Column, k: Column) -> Column:
        term = state["term"] * mean / k
        return F.struct(term.alias("term"), F.concat(
            state["sums"], F.array(F.element_at(state["sums"], -1) + term)).alias("sums"))

    return F.aggregate(steps, start, add, lambda state: state["sums"])


def copy_counts(docs: DataFrame, rates: DataFrame, seed: str = "mix", key: str = "doc_id", source: str = "source") -> DataFrame:
    """``docs`` with ``_copies``, the number of times each is repeated."""
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / SPLIT)).cast("int")
    table = (rates.filter("rate > 0").withColumn("_draws", draws)
             .withColumn("_sums", _distribution(F.col("rate") / F.col("_draws")))
             .select(F.coalesce(F.concat(F.lit("="), "_source"), F.lit("null")).alias("_from"), "_draws", "_sums"))
    marked = docs.withColumn("_from", F.coalesce(F.concat(F.lit("="), source), F.lit("null")))
    # one row per source, broadcast only if measured to be small
    joined = lookup_join(marked, table, "_from", "inner")
    drawn = F.aggregate(
        F.sequence(F.lit(1), F.col("_draws")), F.lit(0),
        lambda n, i: n + F.size(F.filter("_sums", lambda p: p <= uniform(seed, _id_text(key), i.cast("string")))))
    return joined.withColumn("_copies", drawn).drop("_from", "_draws", "_sums")


def mix(docs: DataFrame, weights: dict[str, float], other: float = 1.0, epochs: float = 1.0, seed: str = "mix",
        key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The columns of ``docs`` and ``copy`` (from 0), one row per copy, in shuffled order within and across partitions.

    If ``docs`` has a column ``copy`` of its own, the new one is called ``copy_2``.
    """
    inner, name = shield(docs)
    rates = source_rates(inner, weights, other, epochs, name[source], name[text])
    counted = copy_counts(inner, rates, seed, name[key], name[source])
    copies = counted.filter("_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    order = F.xxhash64(F.lit(seed), F.col(name[key]), F.col("copy"), F.monotonically_increasing_id())
    placed = copies.withColumn("_order", order)
    shuffled = placed.repartition("_order").sortWithinPartitions("_order")
    return shuffled.select(*name.values(), "copy").toDF(*docs.columns, free_name("copy", docs.columns))
