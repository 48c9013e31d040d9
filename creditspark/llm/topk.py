"""Exact top-k inner products by three phases with a uniform threshold.

Vectors are cut into ``SEGMENTS`` stretches of components, and a vector's score is the sum of its segments' scores.
Rows and queries lie in blocks of bounded size, and a task takes one block of each.

1. *Gather.* For every query and segment a task lists its ``k`` best partial scores and completes those few. The k-th
   best complete score found anywhere is a cutoff that no true answer lies below.
2. *Collect.* The cutoff of each query is sent to all tasks with the query. A row can only reach the cutoff if one of
   its segments reaches the cutoff divided by the number of segments; only such rows are collected.
3. *Resolve.* The remaining segments of those are added, and rows that reach the cutoff are ranked.

Of a task's rows at most ``k`` per query leave it, the best with the smallest ids, so that thousands of equal vectors
cost no more than any others.

Vectors that are null or hold null or non-finite components take no part; shorter vectors count as if ended by zeros.
A row without an id is ranked after rows of equal score and is no query. Rows with equal ids are rows of their own: each
is a candidate for the other. Scores beyond 64 bits are held at the limits. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditspark.session import materialize

SEGMENTS = 4
ROWS = 8192
QUERIES = 4096
AT_ONCE = 256
NO_ID = (1 << 63) - 1
LOWEST = -(1 << 63)

PACKED = "block long, ids binary, rows binary, cutoffs binary, width int, numbers binary"


def whole_numbers(vector: str, scale: int = 1024) -> Column:
    """Components as floor(scale * x), x as double; null where a vector takes no part."""
    known = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(known, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint")))


def _pack(group: pa.Table) -> pa.Table:
    """One row holding the vectors of a block, by id."""
    group = group.sort_by([("id", "ascending"), ("row", "ascending")])
    lists = group["numbers"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    width = int(sizes.max())
    matrix = np.zeros((len(group), width), np.int64)
    matrix[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
    return pa.table({
        "block": pa.array([group["block"][0].as_py()]), "ids": [group["id"].to_numpy().astype("<i8").tobytes()],
        "rows": [group["row"].to_numpy().astype("<i8").tobytes()],
        "cutoffs": [group["cutoff"].to_numpy().astype("<i8").tobytes()],
        "width": pa.array([width], pa.int32()), "numbers": [matrix.astype("<i8").tobytes()]})


def blocks(vectors: DataFrame, count: int) -> DataFrame:
    """Vectors (id, row, numbers, cutoff) in ``count`` blocks, dealt by row."""
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(count)))
    return dealt.groupBy("block").applyInArrow(_pack, PACKED)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows, exact, held at the limits of 64 bits."""
    top = [int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))) for x in (a, b)]
    bound = top[0] * top[1] * max(1, a.shape[1])
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if bound < 1 << 63:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), LOWEST + 1, NO_ID - 1).astype(np.int64)


def _load(batch: pa.RecordBatch, at: int, side: str) -> tuple[np.ndarray, ...]:
    ids, rows, cutoffs, numbers = (np.frombuffer(batch.column(f"{side}_{n}")[at].as_py(), "<i8")
                                   for n in ("ids", "rows", "cutoffs", "numbers"))
    return ids, rows, cutoffs, numbers.reshape(len(ids), batch.column(f"{side}_width")[at].as_py())


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Queries, a few at a time, against a block: ids, rows, cutoffs and the scores of each segment."""
    for batch in batches:
        for at in range(batch.num_rows):
            ids, rows, cutoffs, numbers = _load(batch, at, "q")
            other_ids, other_rows, _, others = _load(batch, at, "r")
            width = max(numbers.shape[1], others.shape[1])
            numbers, others = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (numbers, others))
            for low in range(0, len(ids), AT_ONCE):
                part = slice(low, low + AT_ONCE)
                scores = [products(numbers[part][:, s], others[:, s]) for s in
                          (slice(width * i // SEGMENTS, width * (i + 1) // SEGMENTS) for i in range(SEGMENTS))]
                total = products(numbers[part], others)
                own = rows[part][:, None] == other_rows[None, :]
                yield ids[part], rows[part], cutoffs[part], other_ids, scores, total, own


def _gather(k: int):
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows, _, _, scores, total, own in _pairs(batches):
            listed = np.full(total.shape, LOWEST)
            for partial in scores:
                partial = np.where(own, LOWEST, partial)
                width = min(k, partial.shape[1])
                best = np.argpartition(partial, -width, axis=1)[:, -width:]
                np.put_along_axis(listed, best, np.take_along_axis(total, best, 1), 1)
            listed[own] = LOWEST
            width = min(k, listed.shape[1])
            best = np.partition(listed, -width, axis=1)[:, -width:]
            kept = best > LOWEST
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(rows, width).reshape(kept.shape)[kept]), pa.array(best[kept])], ["row", "score"])

    return gather


def _resolve(k: int):
    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows, cutoffs, other_ids, scores, total, own in _pairs(batches):
            share = -(-cutoffs // SEGMENTS)  # rounded up: a sum of whole numbers at the cutoff has a part of that size
            reached = scores[0] >= share[:, None]
            for partial in scores[1:]:
                reached |= partial >= share[:, None]
            # held scores (beyond 64 bits) are not sums of their parts, so they are always looked at
            reached |= np.abs(total) >= NO_ID - 1
            query, other = np.nonzero(reached & ~own)
            score = total[query, other]
            kept = score >= cutoffs[query]
            query, other, score = query[kept], other[kept], score[kept]
            order = np.lexsort((other, -score, query))
            query, other, score = query[order], other[order], score[order]
            first = np.searchsorted(query, query)
            kept = np.arange(len(query)) - first < k
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[query[kept]]), pa.array(ids[query[kept]]), pa.array(other_ids[other[kept]]),
                 pa.array(score[kept])], ["row", "query_id", "vec_id", "score"])

    return resolve


def _units(queries: DataFrame, rows: DataFrame, query_blocks: int, row_blocks: int) -> DataFrame:
    """Every block of queries beside every block of rows, one pair a row."""
    def side(packed: DataFrame, name: str, own: str, other: str, others: int) -> DataFrame:
        return packed.select(F.col("block").alias(own), F.explode(F.expr(f"sequence(0L, {others - 1}L)")).alias(other),
                             *[F.col(c).alias(f"{name}_{c}") for c in packed.columns if c != "block"])

    return side(queries, "q", "a", "b", row_blocks).join(side(rows, "r", "b", "a", query_blocks), ["a", "b"])


def top_k(table: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding",
          rows_at_once: int = ROWS, queries_at_once: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` best rows for each query row, itself left out."""
    numbered = table.select(
        F.coalesce(F.col(key).cast("bigint"), F.lit(NO_ID)).alias("id"), F.monotonically_increasing_id().alias("row"),
        (F.col(key).isNotNull() & is_query).alias("asks"), whole_numbers(vector).alias("numbers"))
    vectors = materialize(numbered.filter(F.col("numbers").isNotNull()).withColumn("cutoff", F.lit(LOWEST + 1)))
    asking = vectors.filter("asks")
    size = vectors.agg(F.count("*").alias("rows"), F.count(F.when(F.col("asks"), 1)).alias("queries")).first()
    row_blocks, query_blocks = max(1, -(-size["rows"] // rows_at_once)), max(1, -(-size["queries"] // queries_at_once))
    columns = ["id", "row", "numbers", "cutoff"]
    rows = materialize(blocks(vectors.select(*columns), row_blocks))

    lists = _units(blocks(asking.select(*columns), query_blocks), rows, query_blocks, row_blocks).mapInArrow(
        _gather(k), "row long, score long")
    placed = lists.withColumn("_n", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"))))
    cutoffs = placed.filter(F.col("_n") <= k).groupBy("row").agg(
        F.max(F.when(F.col("_n") == k, F.col("score"))).alias("found"))
    cut = asking.join(cutoffs, "row", "left").withColumn("cutoff", F.coalesce("found", "cutoff"))

    answers = _units(blocks(cut.select(*columns), query_blocks), rows, query_blocks, row_blocks).mapInArrow(
        _resolve(k), "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = answers.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")
