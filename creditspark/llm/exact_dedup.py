"""Exact deduplication by naming blocks.

Every text is cut into blocks of ``BLOCK`` bytes. All blocks of the corpus are sorted, and equal blocks get one
integer name. Then neighbouring names of a document are paired, the pairs are sorted and named in the same way, and so
on until each document has one name. Two documents have the same number of blocks and the same name exactly when
their texts are equal: content is compared, never only a hash.

Sorting is by a hash of the block and then the block itself, so that the ranges are even. A block that fills several
ranges (copied thousands of times) is named in each of them, and the names at the edges of ranges are then
reconciled by content; no key is gathered in one task.

Null texts count as empty, and the empty text is one empty block. A null id is the smallest. Of equal texts the row
with the largest id stays; if that id occurs repeatedly, one of its rows does. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditspark.llm.rows import row_key, text_of
from creditspark.operators.joins import lookup_join
from creditspark.session import materialize

BLOCK = 8192
RANKS = 1 << 40


def name_keys(rows: DataFrame, key: list[str], unique: list[str]) -> DataFrame:
    """``rows`` without ``key`` and with ``name``: equal keys have equal names, different keys different ones.

    ``unique`` are columns that tell rows apart; a key with many rows is spread over ranges by them.
    """
    carried = [c for c in rows.columns if c not in key]
    hashed = rows.withColumn("_hash", F.xxhash64(*key))
    ranged = hashed.repartitionByRange("_hash", *unique).sortWithinPartitions("_hash", *key)
    fields = [T.StructField(rows.schema[c].name, rows.schema[c].dataType) for c in carried]
    edges = [T.StructField(f"_edge_{c}", rows.schema[c].dataType) for c in key]
    schema = T.StructType([*fields, T.StructField("_name", T.LongType()), *edges])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Number the keys of a sorted range; then its outermost keys, whose neighbours may lie in other ranges."""
        base = TaskContext.get().partitionId() * RANKS
        rank, before, first, opening, closing = -1, None, None, [], []
        types = None
        for batch in batches:
            if not batch.num_rows:
                continue
            hashed = batch.column("_hash").to_numpy()
            keys = [batch.column(c) for c in key]
            fresh = np.zeros(len(hashed), bool)
            for column in keys:
                fresh[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            fresh[1:] |= hashed[1:] != hashed[:-1]
            here = tuple(c[0].as_py() for c in keys)
            fresh[0] = here != before
            ranks = rank + np.cumsum(fresh)
            first = hashed[0] if first is None else first
            if closing and closing[0][0] != hashed[-1]:
                closing = []
            starts = np.flatnonzero(fresh)
            for at in starts[hashed[starts] == first]:
                opening.append((first, ranks[at], tuple(c[at].as_py() for c in keys)))
            for at in starts[hashed[starts] == hashed[-1]]:
                closing.append((hashed[-1], ranks[at], tuple(c[at].as_py() for c in keys)))
            rank, before = int(ranks[-1]), tuple(c[-1].as_py() for c in keys)
            types = [batch.column(c).type for c in carried], [c.type for c in keys]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carried), pa.array(base + ranks),
                 *(pa.nulls(len(ranks), t) for t in types[1])], schema.names)
        if types:
            outer = {r: k for _, r, k in [*opening, *closing]}
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(len(outer), t) for t in types[0]), pa.array([base + int(r) for r in outer], pa.int64()),
                 *(pa.array([k[i] for k in outer.values()], t) for i, t in enumerate(types[1]))], schema.names)

    found = materialize(ranged.mapInArrow(named, schema))
    edge = [F.col(f"_edge_{c}") for c in key]
    # a few rows per range: the same key in several ranges takes the name of the first of them
    outer = found.filter(edge[0].isNotNull())
    same = outer.groupBy(*edge).agg(F.min("_name").alias("name"), F.collect_set("_name").alias("_names")).filter("size(_names) > 1")
    same = same.select("name", F.explode("_names").alias("_name"))
    rows = lookup_join(found.filter(edge[0].isNull()).select(*carried, "_name"), same, "_name")
    return rows.select(*carried, F.coalesce("name", "_name").alias("name"))


def identities(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per document: its id, ``row_key``, ``text_sha256``, and (``blocks``, ``name``), equal for equal texts."""
    whole = docs.select(
        F.col(key).alias("id"), F.monotonically_increasing_id().alias("row"),
        text_of(text).cast("binary").alias("bytes"), row_key(key, text).alias("row_key"),
        F.unhex(F.sha2(text_of(text), 256)).alias("sha"))
    blocks = F.greatest(F.lit(1), F.ceil(F.octet_length("bytes") / block)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.substring(F.col("bytes"), i * block + 1, F.lit(block)))
    cut_up = whole.select("id", "row", "row_key", "sha", blocks.alias("blocks"), F.posexplode(cut).alias("at", "block"))
    head = F.col("at") == 0
    level = cut_up.select(
        "row", "at", "blocks", *[F.when(head, F.col(c)).alias(c) for c in ("id", "row_key", "sha")], "block")
    named = materialize(name_keys(level, ["block"], ["row", "at"]))
    heads = named.filter("at = 0")
    done = heads.filter("blocks = 1").drop("at")
    left = named.agg(F.max("blocks")).first()[0] or 1
    names = named.filter("blocks > 1").select("row", "at", "blocks", F.col("blocks").alias("left_over"), "name")
    while left > 1:
        odd = F.col("at") % 2 == 1
        pairs = names.groupBy("row", F.floor(F.col("at") / 2).cast("int").alias("at"), "blocks",
                              F.ceil(F.col("left_over") / 2).cast("int").alias("left_over")).agg(
            F.max(F.when(~odd, F.col("name"))).alias("first"),
            F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(-1)).alias("second"))
        paired = materialize(name_keys(pairs, ["first", "second"], ["row", "at"]))
        alone = paired.filter("left_over = 1").select("row", "name")
        done = done.unionByName(heads.drop("at", "name").join(alone, "row"))
        names, left = paired.filter("left_over > 1"), (left + 1) // 2
    return done


def group_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256 (hex) and ``row_key``."""
    named = materialize(identities(docs, key, text, block))
    groups = materialize(named.groupBy("blocks", "name").agg(
        F.max(F.struct("id", "row")).alias("keeper"), F.count("*").alias("group_size")))
    # groups are stored first, so that adaptive execution can split a group that holds much of the table
    return named.join(groups, ["blocks", "name"]).select(
        F.col("id").alias(key), F.col("keeper.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("keeper.row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "row_key")
