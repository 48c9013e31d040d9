"""Quality classifier: random-indexing word vectors, pooled per document, scored by a two-layer network.

1. Every document of the corpus is read once. A word's *index vector* is a sparse ternary vector drawn from its hash;
   its *context vector* is the sum of the index vectors found within ``WINDOW`` places. Words share ``BUCKETS``
   hash buckets, so the table has a fixed size; tasks add up their own table and Spark sums the rows of all tables.
2. Every document is pooled: means of its words' context vectors, index vectors and products of neighbouring index
   vectors (which tell repetition), and their lengths.
3. A two-layer numpy network is fitted on at most ``FIT_ROWS`` labelled documents of the training fold; one
   number, the temperature, is then fitted on a part kept back, so that scores are probabilities.

Only the text enters a score. Null and empty texts pool to zero and get the network's answer to that; repeated rows
score alike; with labels of one class, or none, every score is that class's smoothed share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditspark.llm import texts
from creditspark.llm.rows import free_name, shield

BUCKETS = 1 << 14
WIDTH = 32
WINDOW = 2
FIT_ROWS = 20_000
HIDDEN = 24
EPOCHS = 60
SEED = 7
SHRINK = 10
AT_ONCE = 1 << 15

KIND = np.full(256, 3, np.uint8)
KIND[texts.SPACE] = 0
KIND[48:58] = 2
KIND[65:91] = KIND[97:123] = 1
KIND[128:] = 1


def _words(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document in the batch, word hash) of every run of letters, digits or signs."""
    for data, starts, documents, _ in texts.pieces(*texts.utf8(column)):
        begin, end = texts.bounds(KIND[data], starts)
        yield documents[texts.owners(starts, begin)], texts.hashes(data, begin, end)


def _draw(words: np.ndarray) -> np.ndarray:
    """Which of the index vectors each word gets; other bits than those of its bucket."""
    return (words >> np.uint64(40)).astype(np.int64) & (len(INDEX) - 1)


def _index_vectors() -> np.ndarray:
    """Every sparse ternary vector with two places drawn: (place, sign) twice."""
    place, sign = np.divmod(np.arange(2 * WIDTH), 2)
    one = np.zeros((2 * WIDTH, WIDTH), np.float32)
    one[np.arange(2 * WIDTH), place] = 1 - 2 * sign
    return (one[:, None, :] + one[None, :, :]).reshape(-1, WIDTH)


INDEX = _index_vectors()


def context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per bucket a task has met: the sum of its neighbours' index vectors."""
    table = np.zeros(BUCKETS * WIDTH, np.int64)
    for batch in batches:
        # the last words of a stretch come before the next, so that a cut in a long text parts no neighbours
        last_owner, last = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for owner, words in _words(batch.column(0)):
            carried = len(last)
            owner, words = np.append(last_owner, owner), np.append(last, words)
            last_owner, last = owner[-WINDOW:], words[-WINDOW:]
            bucket = (words & np.uint64(BUCKETS - 1)).astype(np.int64) * WIDTH
            drawn = _draw(words)
            for step in range(1, min(WINDOW, len(words) - 1) + 1):
                same = owner[step:] == owner[:-step]
                same[:max(0, carried - step)] = False  # both carried: counted already
                for half in (drawn // (2 * WIDTH), drawn % (2 * WIDTH)):
                    place, sign = half >> 1, 1 - 2 * (half & 1)
                    np.add.at(table, (bucket[:-step] + place[step:])[same], sign[step:][same])
                    np.add.at(table, (bucket[step:] + place[:-step])[same], sign[:-step][same])
    table = table.reshape(BUCKETS, WIDTH)
    met = np.flatnonzero(table.any(axis=1))
    for at in range(0, len(met), 4096):
        part = met[at:at + 4096]
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * WIDTH),
                                        pa.array(table[part].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), sums], ["bucket", "sums"])


def context_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Unit context vectors of all buckets over all texts; the table is BUCKETS x WIDTH whatever the corpus."""
    parts = docs.select(text).mapInArrow(context_rows, "bucket int, sums array<bigint>")
    summed = parts.groupBy("bucket").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(WIDTH)]).alias("sums"))
    table = np.zeros((BUCKETS, WIDTH), np.float32)
    for row in summed.toLocalIterator():
        table[row["bucket"]] = row["sums"]
    length = np.linalg.norm(table, axis=1, keepdims=True)
    return table / np.maximum(length, 1)


def pool(column: pa.Array, table: np.ndarray) -> np.ndarray:
    """Features of each text of a batch; one row per text."""
    n = len(column)
    sums, counts, pairs = np.zeros((n, 3 * WIDTH)), np.zeros(n), np.zeros(n)
    ones = np.ones(AT_ONCE, np.float32)
    last_owner, last = -1, np.zeros(WIDTH, np.float32)
    for owners, all_words in _words(column):
        for low in range(0, len(all_words), AT_ONCE):
            owner, words = owners[low:low + AT_ONCE], all_words[low:low + AT_ONCE]
            follows = np.append(owner[0] == last_owner, owner[1:] == owner[:-1])
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            ends = np.append(first[1:], len(words))
            vectors = INDEX[_draw(words)]
            beside = np.empty_like(vectors)
            np.multiply(vectors[0], last, out=beside[0])
            np.multiply(vectors[1:], vectors[:-1], out=beside[1:])
            beside[~follows] = 0
            last_owner, last = owner[-1], vectors[-1].copy()
            known = table[(words & np.uint64(BUCKETS - 1)).astype(np.int64)]
            for document, at, to in zip(owner[first], first, ends):
                for k, part in enumerate((known, vectors, beside)):
                    sums[document, k * WIDTH:(k + 1) * WIDTH] += ones[:to - at] @ part[at:to]
                counts[document] += to - at
                pairs[document] += to - at - 1 + follows[at]
    means = sums / np.maximum(counts, 1)[:, None]
    means[:, 2 * WIDTH:] = sums[:, 2 * WIDTH:] / np.maximum(pairs, 1)[:, None]
    lengths = [np.linalg.norm(means[:, k * WIDTH:(k + 1) * WIDTH], axis=1) for k in range(3)]
    repeats = means[:, 2 * WIDTH:].sum(axis=1)
    return np.column_stack([means, *lengths, repeats, np.log1p(counts)])


FEATURES = 3 * WIDTH + 5


def with_pooled(docs: DataFrame, table: np.ndarray, keep: list[str], text: str, finish: Callable[[np.ndarray], pa.Array],
                name: str, kind: T.DataType) -> DataFrame:
    """``keep`` columns of every document, and ``name``: what ``finish`` makes of the features of a batch."""
    held = docs.sparkSession.sparkContext.broadcast(table)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = finish(pool(batch.column(batch.num_columns - 1 if text not in keep else keep.index(text)), held.value))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], made], [*keep, name])

    chosen = docs.select(*keep, *[text for _ in [0] if text not in keep])
    schema = T.StructType([*[chosen.schema[c] for c in keep], T.StructField(name, kind)])
    return chosen.mapInArrow(features, schema)


class Network:
    """tanh layer and logistic unit over standardised features, with a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.prior = (y.sum() + 1) / (len(y) + 2)
        self.weights = None
        if len(y) < 10 or y.min() == y.max():
            return
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = self._inputs(x)
        rng = np.random.default_rng(SEED)
        order = rng.permutation(len(y))
        kept, fit = order[:len(y) // 5], order[len(y) // 5:]
        w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
             rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
        first, second = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
        balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
        step = 0
        for _ in range(EPOCHS):
            rng.shuffle(fit)
            for at in range(0, len(fit), 256):
                rows = fit[at:at + 256]
                hidden = np.tanh(x[rows] @ w[0] + w[1])
                error = (self._logistic(hidden @ w[2] + w[3]) - y[rows]) * balance[rows] / len(rows)
                back = np.outer(error, w[2]) * (1 - hidden ** 2)
                grads = [x[rows].T @ back + 1e-4 * w[0], back.sum(0), hidden.T @ error + 1e-4 * w[2], error.sum(keepdims=True)]
                step += 1
                for p, g, m, v in zip(w, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= 0.003 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        self.weights = w
        raw = np.tanh(x[kept] @ w[0] + w[1]) @ w[2] + w[3]
        tried = np.geomspace(0.25, 8, 61)
        loss = [np.mean(balance[kept] * np.logaddexp(0, np.where(y[kept] == 1, -raw, raw) / t)) for t in tried]
        self.temperature = float(tried[int(np.argmin(loss))])

    @staticmethod
    def _logistic(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def _inputs(self, x: np.ndarray) -> np.ndarray:
        """Standardised features; the fewer words, the nearer to the average document."""
        words = np.expm1(x[:, -1:])
        return (x - self.mean) / self.scale * (words / (words + SHRINK))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        w = self.weights
        hidden = np.tanh(self._inputs(x) @ w[0] + w[1])
        return self._logistic((hidden @ w[2] + w[3]) / self.temperature)


def fit_network(docs: DataFrame, labels: DataFrame, table: np.ndarray, key: str, text: str, label: str,
                rows: int = FIT_ROWS) -> Network:
    """A network on the labelled rows; beyond ``rows`` of them, on those with the smallest key hashes."""
    usable = (labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key)
              .agg(F.max(label).cast("double").alias("_label")))
    sample = usable.orderBy(F.xxhash64(key), key).limit(rows)
    # at most ``rows`` pairs of a key and a label, so they may be broadcast
    chosen = docs.select(key, text).join(F.broadcast(sample), key)

    def as_list(x: np.ndarray) -> pa.Array:
        ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * FEATURES)
        return pa.ListArray.from_arrays(ends, pa.array(x.ravel()))

    found = (with_pooled(chosen, table, [key, "_label"], text, as_list, "_features", T.ArrayType(T.DoubleType()))
             .orderBy(F.xxhash64(key), key).limit(rows).toPandas())
    x = np.stack(found["_features"]) if len(found) else np.zeros((0, FEATURES))
    return Network(x, found["_label"].to_numpy(np.float64))


def held_out(key: str, parts: int = 3, part: int = 1) -> Column:
    """True for keys whose crc32, as text, leaves ``part`` when divided by ``parts``."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts == part, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                  label: str = "quality", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default the key) of every row, and held_out, score and predicted.

    A name that ``keep`` has already is given a number: score_2, and so on.
    """
    inner, name = shield(docs)
    key_, text_, kept = name[key], name[text], keep or [key]
    labels = labels.select(F.col(key).alias(key_), F.col(label).alias("_quality"))
    table = context_vectors(inner, text_)
    network = fit_network(inner, labels.filter(~held_out(key_)), table, key_, text_, "_quality")
    scored = with_pooled(inner, table, [name[c] for c in kept], text_, lambda x: pa.array(network.score(x)),
                         "_score", T.DoubleType())
    found = scored.withColumns({"_held_out": held_out(key_) if key in kept else F.lit(None).cast("boolean"),
                                "_predicted": (F.col("_score") >= 0.5).cast("int")})
    made = [free_name(n, kept) for n in ("held_out", "score", "predicted")]
    return found.select(*[name[c] for c in kept], "_held_out", "_score", "_predicted").toDF(*kept, *made)
