"""Hard negatives by a multiway hyperplane tree over inner products.

Rows are lifted by one component to the length of the longest, so that the order of inner products with an anchor is
the order of distances, and a window of scores is an annulus around the anchor. Every node of the tree holds
``FANOUT`` split points and a row belongs to the nearest, so that subtrees are cut apart by the hyperplanes between
points. For every pair of a split point and a sibling subtree the node stores the least and largest distance between
them. A subtree is passed by when, for some split point, that range does not meet the distances that the triangle
inequality leaves to rows inside the annulus. Leaves that are left are compared exactly, in whole numbers.

Split points come from a sample of ``SAMPLE`` rows, the ones first by a hash of their place; all rows are indexed and
the ranges cover all of them. The tree has at most ``FANOUT ** DEPTH`` leaves whatever the size of the table, so it may
go to every task. A leaf is stored in slabs of about ``ROWS`` rows, dealt by a hash; a leaf that holds a third of the
table (one vector many times) is many slabs. Anchors go in blocks to the slabs they need, first to those of their own
leaf; the best scores found there narrow the annuli with which the other leaves are tried.

Rows with a null label, a null vector, or a null or non-finite component take no part; shorter vectors count as if
ended by zeros. A row without an id is no anchor and ranked after rows of equal score. Rows with equal ids are rows of
their own. Scores beyond 64 bits are held at the limits. Columns other than the three named are not read, so
their names cannot clash. An empty table, or one without anchors, gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditspark.llm.topk import LOWEST, NO_ID, products, whole_numbers
from creditspark.session import materialize

FANOUT = 8
DEPTH = 4
LEAF = 2048
SAMPLE = 2048
ROWS = 8192
ANCHORS = 1024
AT_ONCE = 256
CELLS = 1 << 22
SLACK = 1e-6

ROW = "id long, row long, label long, asks boolean, numbers array<long>"
PLACED = f"{ROW}, leaf int, node int, child int, low array<double>, high array<double>"
SLAB = "leaf int, slab int, ids binary, rows binary, labels binary, width int, kind string, numbers binary"
BLOCK = "leaf int, block int, rows binary, labels binary, width int, kind string, numbers binary, lows binary, highs binary"
FOUND = "row long, high long, vec_id long, score long"


# ---- the tree ------------------------------------------------------------------------------

def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between all rows of two matrices."""
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0))


def lift(numbers: np.ndarray, longest: float) -> np.ndarray:
    """Rows as doubles with a last component that makes them all as long as the longest."""
    wide = numbers.astype(np.float64)
    rest = np.sqrt(np.maximum(longest * longest - (wide * wide).sum(1), 0))
    return np.hstack([wide, rest[:, None]])


class Tree:
    """Split points of every node, children (another node, or ``~leaf``), and distance ranges once all rows are known."""

    def __init__(self, sample: np.ndarray, depth: int, longest: float):
        self.longest, self.points, self.children, self.leaves = longest, [], [], 0
        sample = np.unique(sample, axis=0)
        if len(sample):
            self._grow(lift(sample, longest), depth)
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []

    def _grow(self, rows: np.ndarray, depth: int) -> int:
        """Index of a new node over ``rows``, or ``~leaf``."""
        if depth == 0 or (len(rows) < 2 and self.points):
            self.leaves += 1
            return ~(self.leaves - 1)
        node = len(self.points)
        chosen = [0]
        nearest = distances(rows, rows[:1])[:, 0]
        while len(chosen) < min(FANOUT, len(rows)):
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, distances(rows, rows[chosen[-1:]])[:, 0])
        self.points.append(rows[chosen])
        self.children.append([])
        owner = distances(rows, rows[chosen]).argmin(1)
        self.children[node] = [self._grow(rows[owner == j], depth - 1) for j in range(len(chosen))]
        return node

    def place(self, rows: np.ndarray, ranges: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
        """The leaf of every lifted row; ``ranges`` (node, child) -> least and largest distances are widened by them."""
        leaf = np.zeros(len(rows), np.int32)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, some = todo.pop()
            d = distances(rows[some], self.points[node])
            owner = d.argmin(1)
            for j, child in enumerate(self.children[node]):
                held = owner == j
                if not held.any():
                    continue
                here = np.stack([d[held].min(0), -d[held].max(0)])
                ranges[node, j] = np.minimum(ranges.get((node, j), here), here)
                if child < 0:
                    leaf[some[held]] = ~child
                else:
                    todo.append((child, some[held]))
        return leaf

    def set_ranges(self, found: Sequence[tuple[int, int, list[float], list[float]]]) -> None:
        """Ranges over all rows; subtrees without rows can never be met."""
        self.low = [np.full((len(p), len(p)), np.inf) for p in self.points]
        self.high = [np.full((len(p), len(p)), -np.inf) for p in self.points]
        for node, child, low, high in found:
            self.low[node][child], self.high[node][child] = low, high

    def meets(self, anchors: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
        """For anchors (unlifted) with windows of scores: which leaves may hold a row with a score in one of them."""
        wide = np.hstack([anchors.astype(np.float64), np.zeros((len(anchors), 1))])
        own = (wide * wide).sum(1)[:, None]
        slack = SLACK * (self.longest + np.sqrt(own))
        square = own + self.longest ** 2
        near = np.sqrt(np.maximum(square - 2 * highs.astype(np.float64), 0)) - slack
        far = np.sqrt(np.maximum(square - 2 * lows.astype(np.float64), 0)) + slack
        out = np.zeros((len(anchors), self.leaves), bool)
        todo = [(0, np.arange(len(anchors)))]
        while todo:
            node, some = todo.pop()
            d = distances(wide[some], self.points[node])[:, None, :]
            least = np.maximum(d - far[some][:, :, None], near[some][:, :, None] - d)
            most = d + far[some][:, :, None]
            for j, child in enumerate(self.children[node]):
                open_windows = ((self.low[node][j] <= most) & (self.high[node][j] >= least)).all(2).any(1)
                if child < 0:
                    out[some, ~child] = open_windows
                elif open_windows.any():
                    todo.append((child, some[open_windows]))
        return out


# ---- rows in tasks -------------------------------------------------------------------------

def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Whole-number vectors as a matrix, ended by zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def _parts(count: int, width: int) -> Iterator[slice]:
    step = max(1, CELLS // (width + 1))
    return (slice(at, at + step) for at in range(0, count, step))


def _place(tree: Tree, width: int):
    names = [c.split()[0] for c in ROW.split(", ")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges: dict[tuple[int, int], np.ndarray] = {}
        doubles = pa.list_(pa.float64())
        for batch in batches:
            for part in _parts(batch.num_rows, width):
                some = batch.slice(part.start, part.stop - part.start)
                leaf = tree.place(lift(_matrix(some.column("numbers"), width), tree.longest), ranges)
                nulls = [pa.nulls(len(leaf), t) for t in (pa.int32(), pa.int32(), doubles, doubles)]
                yield pa.RecordBatch.from_arrays(
                    [*(some.column(c) for c in names), pa.array(leaf), *nulls], [*names, "leaf", "node", "child", "low", "high"])
        if ranges:
            n, types = len(ranges), (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(n, t) for t in types), pa.array([k[0] for k in ranges], pa.int32()),
                 pa.array([k[1] for k in ranges], pa.int32()), pa.array([list(r[0]) for r in ranges.values()], doubles),
                 pa.array([list(-r[1]) for r in ranges.values()], doubles)], [*names, "leaf", "node", "child", "low", "high"])

    return place


def _bytes(matrix: np.ndarray) -> tuple[str, bytes]:
    """The matrix in the narrowest whole numbers that hold it."""
    top = max(int(matrix.max(initial=0)), -int(matrix.min(initial=0)))
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
    return kind, matrix.astype(kind).tobytes()


def _longs(column: pa.ChunkedArray) -> bytes:
    return column.to_numpy().astype("<i8").tobytes()


def _widest(lists: pa.ChunkedArray) -> int:
    return max(1, pc.max(pc.list_value_length(lists)).as_py())


def _pack_slab(group: pa.Table) -> pa.Table:
    group = group.sort_by([("id", "ascending"), ("row", "ascending")])
    width = _widest(group["numbers"])
    kind, numbers = _bytes(_matrix(group["numbers"], width))
    return pa.table({
        "leaf": group["leaf"][:1], "slab": group["slab"][:1], "ids": [_longs(group["id"])], "rows": [_longs(group["row"])],
        "labels": [_longs(group["label"])], "width": pa.array([width], pa.int32()), "kind": [kind], "numbers": [numbers]})


def _pack_block(group: pa.Table) -> pa.Table:
    width, windows = _widest(group["numbers"]), _widest(group["lows"])
    kind, numbers = _bytes(_matrix(group["numbers"], width))
    # a window from above to below its end holds nothing
    lows, highs = (np.full((len(group), windows), fill) for fill in (NO_ID, LOWEST))
    for window, name in ((lows, "lows"), (highs, "highs")):
        for at, values in enumerate(group[name].to_pylist()):
            window[at, :len(values)] = values
    return pa.table({
        "leaf": group["leaf"][:1], "block": group["block"][:1], "rows": [_longs(group["row"])], "labels": [_longs(group["label"])],
        "width": pa.array([width], pa.int32()), "kind": [kind], "numbers": [numbers],
        "lows": [lows.astype("<i8").tobytes()], "highs": [highs.astype("<i8").tobytes()]})


def _load(batch: pa.RecordBatch, at: int, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, labels and vectors of a slab or block."""
    get = lambda c: batch.column(f"{side}_{c}")[at].as_py()
    rows, labels = np.frombuffer(get("rows"), "<i8"), np.frombuffer(get("labels"), "<i8")
    return rows, labels, np.frombuffer(get("numbers"), get("kind")).reshape(len(rows), get("width")).astype(np.int64)


def best_of(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` largest allowed scores of every row, ties to earlier columns."""
    some = np.flatnonzero(allowed.any(1))
    masked = np.where(allowed[some], scores[some], LOWEST)
    if masked.shape[1] > k:
        cut = np.partition(masked, masked.shape[1] - k, axis=1)[:, -k]
        picked = (masked >= cut[:, None]) & allowed[some]
    else:
        picked = allowed[some]
    row, column = np.nonzero(picked)
    order = np.lexsort((column, -masked[row, column], row))
    row, column = row[order], column[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return some[row[first]], column[first]


def _compare(k: int, same: bool):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                rows, labels, numbers = _load(batch, at, "a")
                other_rows, other_labels, others = _load(batch, at, "s")
                ids = np.frombuffer(batch.column("s_ids")[at].as_py(), "<i8")
                lows, highs = (np.frombuffer(batch.column(f"a_{c}")[at].as_py(), "<i8").reshape(len(rows), -1) for c in ("lows", "highs"))
                width = max(numbers.shape[1], others.shape[1])
                numbers, others = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (numbers, others))
                for low in range(0, len(rows), AT_ONCE):
                    part = slice(low, low + AT_ONCE)
                    scores = products(numbers[part], others)
                    allowed = (labels[part][:, None] == other_labels) == same
                    allowed &= rows[part][:, None] != other_rows
                    for w in range(lows.shape[1]):
                        inside = allowed & (scores >= lows[part, w][:, None]) & (scores <= highs[part, w][:, None])
                        a, b = best_of(scores, inside, k)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(rows[part][a]), pa.array(highs[part, w][a]), pa.array(ids[b]), pa.array(scores[a, b])],
                            ["row", "high", "vec_id", "score"])

    return compare


def _survey(tree: Tree, width: int):
    """Anchors with the leaves, other than their own, that their windows leave."""
    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch.num_rows, width + 8 * FANOUT * FANOUT):
                some = batch.slice(part.start, part.stop - part.start)
                lists = [some.column(c).to_pylist() for c in ("lows", "highs")]
                windows = max((len(v) for v in lists[0]), default=0)
                lows, highs = (np.full((some.num_rows, windows), fill) for fill in (NO_ID, LOWEST))
                for window, values in zip((lows, highs), lists):
                    for at, v in enumerate(values):
                        window[at, :len(v)] = v
                alive = tree.meets(_matrix(some.column("numbers"), width), lows, highs)
                alive[np.arange(len(alive)), some.column("leaf").to_numpy()] = False
                leaves = [np.flatnonzero(a).tolist() for a in alive]
                yield pa.RecordBatch.from_arrays(
                    [*(some.column(c) for c in some.schema.names), pa.array(leaves, pa.list_(pa.int32()))], [*some.schema.names, "leaves"])

    return survey


# ---- the search ----------------------------------------------------------------------------

def _per(values: dict[int, int], leaves: int, leaf: str = "leaf") -> Column:
    """A number per leaf, as a column."""
    return F.element_at(F.array(*[F.lit(values.get(i, 1)) for i in range(leaves)]), F.col(leaf) + 1)


class Index:
    """All rows in slabs under a tree."""

    def __init__(self, vectors: DataFrame, rows: int, fanout_rows: int, slab_rows: int):
        """``vectors`` is stored: id, row, label, asks, numbers."""
        size = vectors.agg(
            F.count("*").alias("rows"), F.max(F.size("numbers")).alias("width"),
            F.max(F.aggregate("numbers", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("longest")).first()
        self.width = max(1, size["width"] or 0)
        depth = min(DEPTH, max(1, math.ceil(math.log(max(1, size["rows"] / fanout_rows), FANOUT))))
        sample = vectors.orderBy(F.xxhash64("row"), "row").limit(rows).select("numbers").toArrow()["numbers"]
        self.tree = Tree(_matrix(sample, self.width), depth, math.sqrt(size["longest"] or 0.0))
        self.empty = not size["rows"]
        if self.empty:
            return
        self.placed = materialize(vectors.mapInArrow(_place(self.tree, self.width), PLACED))
        # (node, child) pairs, as many as the tree has at most
        edges = self.placed.filter("row is null").select("node", "child", F.posexplode(F.arrays_zip("low", "high")).alias("at", "r"))
        widest = edges.groupBy("node", "child", "at").agg(F.min("r.low").alias("low"), F.max("r.high").alias("high"))
        found = widest.groupBy("node", "child").agg(F.sort_array(F.collect_list(F.struct("at", "low", "high"))).alias("r")).collect()
        self.tree.set_ranges([(f["node"], f["child"], [r["low"] for r in f["r"]], [r["high"] for r in f["r"]]) for f in found])
        rows_placed = self.placed.filter("row is not null").select(*[c.split()[0] for c in ROW.split(", ")], "leaf")
        counts = {r["leaf"]: r["n"] for r in rows_placed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
        self.slabs = {leaf: -(-n // slab_rows) for leaf, n in counts.items()}
        slab = F.pmod(F.xxhash64("row"), _per(self.slabs, self.tree.leaves)).cast("int")
        self.rows = materialize(rows_placed.withColumn("slab", slab).groupBy("leaf", "slab").applyInArrow(_pack_slab, SLAB))
        self.anchors = rows_placed.filter("asks").select("row", "id", "label", "numbers", "leaf")

    def elsewhere(self, anchors: DataFrame) -> DataFrame:
        """``leaves`` that the windows (``lows``, ``highs``) of anchors leave beside their own."""
        schema = T.StructType([*anchors.schema.fields, T.StructField("leaves", T.ArrayType(T.IntegerType()))])
        return anchors.mapInArrow(_survey(self.tree, self.width), schema)

    def best(self, anchors: DataFrame, k: int, same: bool, block_rows: int) -> DataFrame:
        """(row, high, vec_id, score): best rows of every anchor and window in its ``leaves``, up to ``k`` per slab."""
        sent = materialize(anchors.select("row", "label", "numbers", "lows", "highs", F.explode("leaves").alias("leaf")))
        counts = {r["leaf"]: r["n"] for r in sent.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
        blocks = {leaf: -(-n // block_rows) for leaf, n in counts.items()}
        block = F.pmod(F.xxhash64("row", F.lit(1)), _per(blocks, self.tree.leaves)).cast("int")
        packed = sent.withColumn("block", block).groupBy("leaf", "block").applyInArrow(_pack_block, BLOCK)
        spread = packed.select("leaf", F.explode(F.sequence(F.lit(0), _per(self.slabs, self.tree.leaves) - 1)).alias("slab"),
                               *[F.col(c).alias(f"a_{c}") for c in packed.columns if c not in ("leaf", "block")])
        slabs = self.rows.select("leaf", "slab", *[F.col(c).alias(f"s_{c}") for c in self.rows.columns if c not in ("leaf", "slab")])
        return spread.join(slabs, ["leaf", "slab"]).mapInArrow(_compare(k, same), FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row", "high").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search(index: Index, anchors: DataFrame, k: int, same: bool, block_rows: int) -> DataFrame:
    """(row, high, vec_id, score, rank): the first ``k`` rows of every window, own leaf first, then what is left."""
    own = materialize(_first(index.best(anchors.withColumn("leaves", F.array("leaf")), k, same, block_rows), k))
    full = own.filter(F.col("rank") == k).groupBy("row").agg(
        F.map_from_entries(F.collect_list(F.struct("high", "score"))).alias("reached"))
    narrowed = anchors.join(full, "row", "left").withColumn("lows", F.zip_with(
        "lows", "highs", lambda low, high: F.coalesce(F.try_element_at("reached", high), low))).drop("reached")
    rest = index.best(index.elsewhere(narrowed), k, same, block_rows)
    return _first(own.drop("rank").unionByName(rest), k)


def mine(table: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (4, 5),
         key: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = 256, sample: int = SAMPLE,
         leaf_rows: int = LEAF, slab_rows: int = ROWS, block_rows: int = ANCHORS) -> DataFrame:
    """Per anchor and positive, its hard negatives: anchor_id, positive_id, rank, negative_id and both scores.

    Positives are the best ``positives`` other rows of the anchor's label. Negatives are the best ``negatives`` rows of
    other labels whose score is at most the positive's and at least ``share`` (a fraction) of it.
    """
    numbered = table.select(
        F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"), F.monotonically_increasing_id().alias("row"),
        F.col(label).cast("long").alias("label"), (F.col(key).isNotNull() & is_anchor).alias("asks"),
        whole_numbers(vector, scale).alias("numbers"))
    index = Index(materialize(numbered.filter("label is not null and numbers is not null")), sample, leaf_rows, slab_rows)
    columns = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if index.empty:
        return table.sparkSession.createDataFrame([], columns)
    whole = lambda x: F.array(F.lit(x).cast("long"))
    asking = index.anchors.withColumns({"lows": whole(LOWEST + 1), "highs": whole(NO_ID - 1)})
    found = materialize(_search(index, asking, positives, True, block_rows).select(
        "row", F.col("vec_id").alias("positive"), F.col("score").alias("high"), F.col("rank").alias("place")))

    part, of = share
    low = F.expr(f"(high - pmod(high, {of})) div {of} * {part} + (pmod(high, {of}) * {part} + {of - 1}) div {of}")
    windows = found.select("row", "high", low.alias("low")).filter("low <= high").groupBy("row").agg(
        F.array_sort(F.collect_set(F.struct("low", "high"))).alias("w"))
    searching = index.anchors.join(windows, "row").withColumns({"lows": F.col("w.low"), "highs": F.col("w.high")}).drop("w")
    hard = _search(index, searching, negatives, False, block_rows).select(
        "row", "high", "rank", F.col("vec_id").alias("negative"), F.col("score").alias("negative_score"))
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return (found.join(hard, ["row", "high"]).join(index.anchors.select("row", F.col("id").alias("anchor_id")), "row")
            .select("anchor_id", known("positive").alias("positive_id"), "rank", known("negative").alias("negative_id"),
                    F.col("high").alias("positive_score"), "negative_score"))
