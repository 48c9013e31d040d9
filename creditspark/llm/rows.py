"""Row identity and the taking out of rows, for stages that keep whole documents."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditspark.operators.joins import lookup_join, measured_bytes
from creditspark.session import materialize, shared_dir


def free_name(name: str, taken: list[str]) -> str:
    """``name``, or with the first number that makes it differ from the names taken (Spark ignores letter case)."""
    used, tried, number = {c.lower() for c in taken}, name, 1
    while tried.lower() in used:
        number += 1
        tried = f"{name}_{number}"
    return tried


def shield(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns renamed, so that none clashes with those an operator adds; and the new names by the old."""
    names = {c: f"_given_{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new table in the shared folder, and read from there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def row_key(key: str = "doc_id", text: str = "text") -> Column:
    """SHA-256 over id and text: rows that share it are repeats of one row. A null id has a key of its own."""
    known = F.coalesce(F.concat(F.lit("id "), F.col(key).cast("string")), F.lit("null"))
    return F.unhex(F.sha2(F.concat_ws("\n", known, text_of(text)), 256))


def take_out(docs: DataFrame, decisions: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` that ``decisions`` (``row_key``, ``kept``, one row per row of ``docs``) keep, columns as given.

    Texts are not shuffled for it while the list of rows to drop is measured to be small. Of repeated rows as many
    stay as decisions keep of them, at most one.
    """
    per_key = decisions.groupBy("row_key").agg(F.count("*").alias("_n"), F.sum(F.col("kept").cast("long")).alias("_kept"))
    odd = materialize(per_key.filter((F.col("_kept") == 0) | (F.col("_n") > 1)))
    size = measured_bytes(odd)
    if size == 0:
        return docs
    inner, name = shield(docs)
    keyed = inner.withColumn("_key", row_key(name[key], name[text]))
    listed = odd.select(F.col("row_key").alias("_key"))
    out = lookup_join(keyed, listed, "_key", "left_anti", size=size)
    repeats = odd.filter("_kept > 0").select(F.col("row_key").alias("_key"))
    if not repeats.isEmpty():
        out = out.unionByName(lookup_join(keyed, repeats, "_key", "left_semi", size=size).dropDuplicates(["_key"]))
    return out.select(*name.values()).toDF(*docs.columns)
