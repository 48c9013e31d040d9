"""SimHash near-duplicates: fingerprints of word shingles, joined by a pair traversal of their binary trie.

The distinct fingerprints are the leaves of a binary trie. The join starts with the pair (root, root) and walks down
both nodes of a pair together: every pair of children whose differing bits, added up along the way, stay within the
budget is followed, all others are cut off. Spark walks the upper levels as a table of node pairs, until the nodes of
a pair hold few enough fingerprints for one task; each task then walks its pairs to the leaves with numpy. A task
reports its links as a spanning forest, and components are found from these forests.

A fingerprint has at most 43,744 others within three bits, so that dense groups stay bounded per fingerprint.

Null texts count as empty; a text without words has fingerprint zero and is linked like any other. Equal fingerprints
are one leaf, so copies are never paired. A null id is never the smallest of its component unless all are null.
Repeated rows share id, fingerprint and component and are all returned; an empty table gives no rows; further columns,
whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditspark.llm import texts
from creditspark.llm.components import components
from creditspark.llm.rows import row_key
from creditspark.session import materialize

BITS = 64
STEP = 3
FIRST = 6
TASK_LEAVES = 20_000
LEAF_PAIRS = 16
PAIRS_AT_ONCE = 1 << 19
WHITE = re.compile(rb"[\x20\x09-\x0D]")


def _stretches(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, lower-cased, in lists of about ``PIECE`` bytes cut at white space."""
    at = 0
    while at < len(text):
        to = at + texts.PIECE
        if to < len(text):
            gap = WHITE.search(text, to)
            to = gap.start() if gap else len(text)
        yield text[at:to].lower().split()
        at = to


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of one UTF-8 text: the bits set in over half of the XXH64 hashes of its word shingles."""
    digest = xxhash.xxh64_intdigest
    ones, count, held = np.zeros(BITS, np.int64), 0, []

    def fold(words: list[bytes], span: int) -> int:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        begin = np.append(0, ends[:-1] + 1)[:len(words) - span + 1].tolist()
        hashed = np.array([digest(joined[i:j], 42) for i, j in zip(begin, ends[span - 1:].tolist())], np.uint64)
        ones[:] += np.unpackbits(hashed.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        return len(hashed)

    for words in _stretches(text):
        words = held + words
        if len(words) >= shingle:
            count += fold(words, shingle)
            held = words[len(words) - shingle + 1:]
        else:
            held = words
    if not count and held:
        count = fold(held, len(held))
    return int(np.packbits(ones * 2 > count).view(">u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``row_key`` and ``fp`` (the 64 bits as a signed long) of every document."""
    schema = T.StructType([T.StructField("id", docs.schema[key].dataType), T.StructField("row_key", T.BinaryType()),
                           T.StructField("fp", T.LongType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = texts.utf8(batch.column(2))
            found = np.array([fingerprint(data[i:j].tobytes(), shingle) for i, j in zip(ends[:-1], ends[1:])], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], schema.names)

    return docs.select(F.col(key), row_key(key, text), F.col(text)).mapInArrow(read, schema)


def _prefix(depth: int, column: str = "fp"):
    return F.shiftrightunsigned(column, BITS - depth) if depth else F.lit(0).cast("long")


def node_pairs(leaves: DataFrame, budget: int, limit: int) -> dict[int, DataFrame]:
    """By depth, the pairs of trie nodes (``a`` <= ``b``, ``diff``) that one task each can finish.

    Pairs are followed downwards while they hold more than ``limit`` fingerprints. Every pair of leaves within the
    budget lies below exactly one of the pairs.
    """
    spark = leaves.sparkSession
    done: dict[int, DataFrame] = {}
    going = spark.createDataFrame([(0, 0, 0)], "a long, b long, diff int")
    depth, deeper = 0, FIRST
    while depth < BITS - 1:
        step, depth = min(deeper, BITS - 1 - depth), min(depth + deeper, BITS - 1)
        deeper = STEP
        nodes = materialize(leaves.groupBy(_prefix(depth).alias("node")).agg(F.count("*").alias("n")))

        def child(name: str) -> DataFrame:
            return nodes.select(F.shiftrightunsigned("node", step).alias(name), F.col("node").alias(f"{name}_child"),
                                F.col("n").alias(f"{name}_n"))

        differing = F.col("diff") + F.bit_count(F.col("a_child").bitwiseXOR(F.col("b_child")).bitwiseAND((1 << step) - 1))
        pairs = (going.join(child("a"), "a").join(child("b"), "b")
                 .filter((F.col("a") != F.col("b")) | (F.col("a_child") <= F.col("b_child")))
                 .select(F.col("a_child").alias("a"), F.col("b_child").alias("b"), differing.cast("int").alias("diff"),
                         (F.col("a_n") + F.col("b_n")).alias("n")).filter(F.col("diff") <= budget))
        pairs = materialize(pairs)
        done[depth] = pairs.filter(F.col("n") <= limit) if depth < BITS - 1 else pairs
        going = pairs.filter(F.col("n") > limit).drop("n")
        if going.isEmpty():
            break
    return done


def _unite(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Join the sets of ``u`` and ``v``; ``label`` holds the smallest member of every leaf's set."""
    while True:
        one, two = label[u], label[v]
        apart = one != two
        if not apart.any():
            return
        u, v = u[apart], v[apart]
        np.minimum.at(label, np.maximum(one, two)[apart], np.minimum(one, two)[apart])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def walk(a: np.ndarray, b: np.ndarray, same: bool, depth: int, diff: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest over the leaves of two nodes that differ in at most ``budget`` bits.

    ``a`` and ``b`` are sorted, distinct, and share their first ``depth`` bits each; ``same`` says it is one node.
    """
    leaves = a if same else np.concatenate([a, b])
    label, shift = np.arange(len(leaves)), 0 if same else len(a)
    one = np.array([0])
    stack = [(depth, one, one + len(a), one, one + len(b), one + diff)]
    while stack:
        depth, alo, ahi, blo, bhi, d = stack.pop()
        if len(alo) > PAIRS_AT_ONCE:
            half = len(alo) // 2
            stack += [(depth, *(x[:half] for x in (alo, ahi, blo, bhi, d))),
                      (depth, *(x[half:] for x in (alo, ahi, blo, bhi, d)))]
            continue
        small = ((ahi - alo) * (bhi - blo) <= LEAF_PAIRS) | (depth >= BITS)
        if small.any():
            wide = (bhi - blo)[small]
            sizes = (ahi - alo)[small] * wide
            pair = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            u = alo[small][pair] + place // wide[pair]
            v = blo[small][pair] + place % wide[pair]
            near = np.bitwise_count(a[u] ^ b[v]) <= budget
            if same:
                near &= u < v
            if near.any():
                _unite(label, u[near], v[near] + shift)
        alo, ahi, blo, bhi, d = (x[~small] for x in (alo, ahi, blo, bhi, d))
        if not len(alo):
            continue
        bit = np.uint64(1) << np.uint64(BITS - 1 - depth)
        high = ~(bit | (bit - np.uint64(1)))
        amid = np.searchsorted(a, (a[alo] & high) | bit)
        bmid = np.searchsorted(b, (b[blo] & high) | bit)
        mirrored = (alo == blo) & same
        kids = [(alo, amid, blo, bmid, d, True), (amid, ahi, bmid, bhi, d, True),
                (alo, amid, bmid, bhi, d + 1, True), (amid, ahi, blo, bmid, d + 1, ~mirrored)]
        kept = [(l < m) & (n < o) & (e <= budget) & ok for l, m, n, o, e, ok in kids]
        stack.append((depth + 1, *(np.concatenate([k[i][keep] for k, keep in zip(kids, kept)]) for i in range(5))))
    tied = np.flatnonzero(label != np.arange(len(leaves)))
    return leaves[tied], leaves[label[tied]]


def link(leaves: DataFrame, budget: int = 3, limit: int = TASK_LEAVES) -> DataFrame:
    """Links ``a``, ``b`` that tie together all fingerprints ``fp`` (distinct) within ``budget`` bits of each other."""
    found = None
    for depth, pairs in node_pairs(leaves, budget, limit).items():
        # only nodes of finished pairs are gathered: they have at most ``limit`` fingerprints, unless one bit is left
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        packed = (leaves.withColumn("node", _prefix(depth)).join(wanted, "node", "left_semi")
                  .groupBy("node").agg(F.collect_list("fp").alias("fps")))
        unit = [F.lit(depth).alias("depth"), "a", "b", "diff"]
        left = pairs.join(packed, F.col("a") == F.col("node")).select(*unit, F.lit(0).alias("side"), "fps")
        right = (pairs.filter("a <> b").join(packed, F.col("b") == F.col("node"))
                 .select(*unit, F.lit(1).alias("side"), "fps"))
        both = left.unionByName(right)
        found = both if found is None else found.unionByName(both)

    def links(unit: pd.DataFrame) -> pd.DataFrame:
        sides = [np.sort(np.asarray(x, np.int64).view(np.uint64)) for x in unit.sort_values("side")["fps"]]
        head = unit.iloc[0]
        u, v = walk(sides[0], sides[-1], len(sides) == 1, int(head["depth"]), int(head["diff"]), budget)
        return pd.DataFrame({"a": u.view(np.int64), "b": v.view(np.int64)})

    return found.groupBy("depth", "a", "b").applyInPandas(links, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, budget: int = 3, key: str = "doc_id", text: str = "text",
                    limit: int = TASK_LEAVES) -> DataFrame:
    """One row per document: id, fingerprint (hex), component_id (smallest id reachable), kept and ``row_key``.

    Of each component one row is kept: one with the smallest id, and of several such rows that with the smallest key.
    """
    found = materialize(fingerprints(docs, shingle, key, text))
    leaves = materialize(found.groupBy("fp").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row_key")).alias("first")))
    tied = components(link(leaves.select("fp"), budget, limit))
    grouped = leaves.join(tied, leaves["fp"] == tied["node"], "left").select(
        "fp", F.coalesce("component", "fp").alias("component"), "first")
    smallest = grouped.groupBy("component").agg(F.min("first").alias("first"))
    answer = grouped.select("fp", "component").join(smallest, "component").select("fp", "first")
    return found.join(answer, "fp").select(
        F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first.id").alias("component_id"), (F.col("row_key") == F.col("first.row_key")).alias("kept"), "row_key")
