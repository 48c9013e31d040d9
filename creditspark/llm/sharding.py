"""Sharding by a hierarchical weighted hash tree.

Shards hang in racks and racks in regions. A row descends from the root: at each node every child draws
``-ln(u) / weight``, with ``u`` uniform from a hash of row id and child, and the smallest draw wins. Children win in
proportion to their weights, and a draw depends on the child alone, so changing a weight moves rows only into or out of
the subtree that holds it. A new shard is hung below the root as a region of its own: all other weights stand, and rows
move only into it. (Hung below an old rack it would raise that rack's weight, and its old shards would gain rows too.)

Rows are numbered in their shards by id, over ranges of ids, so that no shard is gathered in one task.

A null id is hashed as "null", and repeated ids share a shard; a null text has size 1 and the checksum of the empty
text. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditspark.llm.mixing import uniform
from creditspark.operators.ranks import running_totals


@dataclass(frozen=True)
class Shard:
    number: int
    region: str
    rack: str
    weight: float = 1.0


def regular_tree(shards: int, base: int = 16, racks: int = 2, per_rack: int = 4) -> list[Shard]:
    """The first ``base`` shards in racks of ``per_rack`` and regions of ``racks``; each further one is a region of its own."""
    tree = []
    for n in range(shards):
        rack = n // per_rack
        region, rack = (f"region-{rack // racks}", f"rack-{rack}") if n < base else (f"added-{n}", f"rack-of-{n}")
        tree.append(Shard(n, region, rack))
    return tree


def _children(tree: list[Shard]) -> dict[str, dict[str, float]]:
    """Weights of the children of every inner node; a node's weight is the sum of those below it."""
    nodes: dict[str, dict[str, float]] = {}
    for s in tree:
        rack, leaf = f"{s.region}/{s.rack}", f"{s.region}/{s.rack}/{s.number}"
        for node, child in (("", s.region), (s.region, rack), (rack, leaf)):
            below = nodes.setdefault(node, {})
            below[child] = below.get(child, 0.0) + s.weight
    return nodes


def _descend(nodes: dict[str, dict[str, float]], node: Column, key: Column, seed: str) -> Column:
    """The child that ``node`` (a path) draws for ``key``."""
    table = F.create_map(*[part for name, below in nodes.items() for part in (
        F.lit(name), F.array(*[F.struct(F.lit(c).alias("name"), F.lit(w).alias("weight")) for c, w in below.items() if w > 0]))])
    draws = F.transform(F.element_at(table, node), lambda child: F.struct(
        (-F.ln(uniform(seed, key, child["name"]) + 2.0 ** -54) / child["weight"]).alias("draw"), child["name"].alias("name")))
    return F.array_min(draws)["name"]


def place(docs: DataFrame, tree: list[Shard], key: Column, name: str, seed: str = "shard") -> DataFrame:
    """``docs`` with ``name``, the path region/rack/shard of each row."""
    nodes = _children(tree)
    by_level = [{n: c for n, c in nodes.items() if (n.count("/") + 1 if n else 0) == level} for level in range(3)]
    path = F.lit("")
    for level in by_level:
        docs = docs.withColumn(name, _descend(level, path, key, seed))
        path = F.col(name)
    return docs


def shard_documents(docs: DataFrame, tree: list[Shard], grown: list[Shard], key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard (the shard under the grown tree), region and rack."""
    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(
        F.col(key).alias("id"), F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("hashed"),
        (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("crc"),
        F.monotonically_increasing_id().alias("row"), F.lit(1).alias("one"))
    placed = place(place(slim, tree, F.col("hashed"), "path"), grown, F.col("hashed"), "grown")
    last = placed.withColumn("shard", F.element_at(F.split("path", "/"), -1).cast("int"))
    numbered = running_totals(last, ["id", "row"], ["one"], ["shard"])
    return numbered.select(
        F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard",
        F.col("before_one").cast("long").alias("slot"), F.element_at(F.split("grown", "/"), -1).cast("int").alias("grown_shard"),
        F.element_at(F.split("path", "/"), 1).alias("region"), F.element_at(F.split("path", "/"), 2).alias("rack"))
