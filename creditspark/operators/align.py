"""Schema operators: choose, drop, align and stack columns without moving rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditspark.functions.columns import clean_name

NUMERIC = (T.LongType, T.DoubleType)


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns of exactly long or double type."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def categorical_columns(df: DataFrame) -> list[str]:
    """Every column that is not long or double."""
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, NUMERIC)]


def columns_with_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def without(columns: Iterable[str], *values: str) -> list[str]:
    dropped = set(values)
    return [c for c in columns if c not in dropped]


def prune(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Drop the listed columns that exist."""
    return df.drop(*columns)


def keep_common(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both frames reduced to their common columns, in left order."""
    shared = [c for c in left.columns if c in set(right.columns)]
    return left.select(*shared), right.select(*shared)


def align_to(df: DataFrame, columns: Sequence[str] | T.StructType) -> DataFrame:
    """Exactly ``columns`` in that order: extras dropped, missing ones NULL doubles (or their declared type)."""
    if isinstance(columns, T.StructType):
        wanted = [(f.name, f.dataType) for f in columns.fields]
    else:
        wanted = [(c, T.DoubleType()) for c in columns]
    present = set(df.columns)
    return df.select(*[
        F.col(name) if name in present else F.lit(None).cast(kind).alias(name) for name, kind in wanted
    ])


def clean_column_names(df: DataFrame) -> DataFrame:
    names = [clean_name(c) for c in df.columns]
    if len(set(names)) != len(names):
        raise ValueError("cleaned column names collide")
    return df.toDF(*names)


def append_rows(*frames: DataFrame) -> DataFrame:
    """Stack result frames by column name; absent columns are NULL."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def to_long(df: DataFrame, columns: Sequence[str], ids: Sequence[str] = (), kind: str = "double",
            name: str = "column", value: str = "value") -> DataFrame:
    """One row per (row, column). Columns are cast to one type first."""
    typed = df.select(*ids, *[F.col(c).cast(kind).alias(c) for c in columns])
    return typed.unpivot(list(ids), list(columns), name, value)
