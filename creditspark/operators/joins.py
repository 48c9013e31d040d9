"""Joins with a checked size: broadcast only what was measured to be small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditspark.session import materialize

BROADCAST_BYTES = 64 * 1024 * 1024


def byte_estimate(df: DataFrame) -> Column:
    """Aggregate estimating the in-memory size of rows: 16 bytes per cell plus the length of texts."""
    text = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    letters = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in text]
    return sum(letters, F.count(F.lit(1)) * 16 * len(df.columns))


def measured_bytes(df: DataFrame) -> int:
    """Size of a frame by :func:`byte_estimate`."""
    return df.agg(byte_estimate(df).alias("b")).first()["b"]


def lookup_join(df: DataFrame, table: DataFrame, on: str | list[str], how: str = "left",
                max_bytes: int = BROADCAST_BYTES, size: int | None = None) -> DataFrame:
    """Join raw rows to a lookup whose keys are unique.

    The lookup is computed once and measured. Small, it is broadcast and ``df`` keeps its partitioning
    whatever its key skew; beyond the bound the join shuffles, and adaptive skew handling splits hot keys
    of ``df``. ``size`` is given for a stored lookup that was measured before.
    """
    if size is None:
        table = materialize(table)
        size = measured_bytes(table)
    return df.join(F.broadcast(table) if size <= max_bytes else table, on, how)


def attach_one_per_key(df: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Left join of a frame holding one row per key, so the row count of ``df`` is unchanged."""
    return df.join(features, key, "left")


def keep_listed(df: DataFrame, listed: DataFrame, on: str) -> DataFrame:
    return df.join(listed, on, "left_semi")
