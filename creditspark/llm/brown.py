"""Language-model scores from a class-based bigram model.

The at most ``HEAVY`` most frequent words are units of their own; all other words form one unit for each *shape*
(length, closing sign, letters beyond ASCII, digits). Units are sorted into ``CLASSES`` classes in two steps:

1. *Exchange* over the ``UNITS`` most frequent words and the shapes (of all other words): each in turn moves to the class
   that raises the likelihood of the corpus's bigrams most, until a sweep moves none.
2. *Spread.* Of every other frequent word all neighbours in the corpus are counted by their classes, and the word is
   taken out of its shape's class and put where the same gain is highest. Words are independent of each other here, so
   Spark counts their contexts by a shuffle and places them in blocks.

Class transitions are then counted anew over all texts, and

    P(word | word before) = P(class | class before) * P(unit | class) * P(word | unit),

with class transitions discounted and backed off to class frequencies, and all words discounted. The mass so
gained is that of all unseen words of the shape together, and an unseen word's part of it is its spelling's: the product
of its letters' frequencies in the training texts and that of a word's end, which sums to at most 1 over all words.

Every statistic covers all training texts: word counts, contexts, bigrams of classes, words and tokens per shape. Only
tables of a fixed size reach the driver: the counts and classes of the frequent words and bigrams of the first units and
of classes. Contexts stay in Spark. Rarer words, whose number grows with the corpus, are counted and looked up by a
shuffle join on a 64-bit word hash; the frequent ones never enter that join, so it has no hot key.

Null and empty texts hold one token, the end. Without training rows every word is unseen. A null id is training data;
repeated rows count and score as rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditspark.llm import texts
from creditspark.llm.quality import held_out
from creditspark.session import materialize

HEAVY = 1 << 17
UNITS = 1000
SHAPES = 32
CLASSES = 64
SWEEPS = 20
DISCOUNT = 0.75
END = 0

SIGN = np.ones(256, bool)
SIGN[48:58] = SIGN[65:91] = SIGN[97:123] = SIGN[128:] = False
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True


def stream(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, word) of all tokens in order; each text closes with ``END``.

    A word is a 64-bit integer: its shape in the lowest bits, a hash in the others.
    """
    return ((text, word) for text, word, _ in spelled(column, np.zeros(257)))


def spelled(column: pa.Array, letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """:func:`stream` with every word's spelling: the sum of ``letters`` over its bytes, and of its end (the last entry)."""
    for data, starts, documents, going_on in texts.pieces(*texts.utf8(column)):
        data = texts.LOWER[data]
        begin, end = texts.bounds((~texts.SPACE[data]).astype(np.uint8), starts)
        size = end - begin
        far, digits = (np.append(0, np.cumsum(mark)) for mark in (data > 127, DIGIT[data]))
        shape = np.digitize(size, (4, 7, 10)) * 8
        if len(size):
            shape += SIGN[data[end - 1]] * 4 + (far[end] > far[begin]) * 2 + (digits[end] > digits[begin])
        owner = texts.owners(starts, begin) if len(size) else np.zeros(0, np.int64)
        # of empty texts starting at one place, the search names the last, which holds what follows
        closed = np.ones(len(documents), np.int64)
        closed[-1] = not going_on
        total = np.bincount(owner, minlength=len(documents)) + closed
        stop = np.cumsum(total)
        if not stop[-1]:
            continue  # nothing but white space inside a long text
        word, text = np.full(int(stop[-1]), END, np.uint64), np.repeat(documents, total)
        inner = np.ones(len(word), bool)
        inner[stop[closed == 1] - 1] = False
        hashed = (texts.hashes(data, begin, end) & ~np.uint64(SHAPES - 1)) | shape.astype(np.uint64)
        word[inner] = np.maximum(hashed, np.uint64(1))
        along = np.append(0, np.cumsum(letters[data]))
        spelling = np.zeros(len(word))
        spelling[inner] = along[end] - along[begin] + letters[256]
        yield text, word, spelling


def _totals(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, count = np.concatenate(keys), np.concatenate(counts)
    found, place = np.unique(key, return_inverse=True)
    return found, np.bincount(place, count, len(found)).astype(np.int64)


class _Tally:
    """Counts by key, compacted whenever many have come together, and given out in batches."""

    def __init__(self, limit: int = 1 << 21):
        self.keys, self.counts, self.held, self.limit = [], [], 0, limit

    def add(self, keys: np.ndarray) -> None:
        found, count = np.unique(keys, return_counts=True)
        self.keys.append(found)
        self.counts.append(count)
        self.held += len(found)
        if self.held > 2 * self.limit:
            found, count = _totals(self.keys, self.counts)
            self.keys, self.counts, self.held = [found], [count], len(found)

    def full(self) -> bool:
        return self.held > self.limit and len(self.keys) == 1

    def take(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        found, count = _totals(self.keys, self.counts)
        self.keys, self.counts, self.held = [], [], 0
        for at in range(0, len(found), 1 << 16):
            yield found[at:at + (1 << 16)], count[at:at + (1 << 16)]


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` (hash), ``shape`` and ``n`` of all tokens of the texts in ``docs`` (text, train) marked for training."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()

        def rows() -> Iterator[pa.RecordBatch]:
            for words, counts in tally.take():
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["word", "n"])

        for batch in batches:
            train = batch.column(1).to_numpy(zero_copy_only=False)
            for text, word in stream(batch.column(0)):
                tally.add(word[train[text]])
                if tally.full():
                    yield from rows()
        yield from rows()

    counted = docs.select("text", "train").mapInArrow(count, "word long, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def letter_logs(docs: DataFrame) -> np.ndarray:
    """Logarithms (base 10) of the frequencies of the 256 bytes, and of a word's end, in the training texts of ``docs``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(257, np.int64)
        for batch in batches:
            for data, starts, _, _ in texts.pieces(*texts.utf8(batch.column(0))):
                data = texts.LOWER[data]
                total[:256] += np.bincount(data, minlength=256)
                total[256] += len(texts.bounds((~texts.SPACE[data]).astype(np.uint8), starts)[0])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(257, dtype=np.int32)), pa.array(total)], ["letter", "n"])

    found = docs.filter("train").select("text").mapInArrow(count, "letter int, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect()
    n = np.ones(257)
    for r in found:
        n[r["letter"]] += r["n"]
    n[:256][texts.SPACE] = 1  # no letters
    return np.log10(n / n.sum())


class Units:
    """The frequent words, sorted, with their counts; the most frequent of them are units."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, units: int):
        # words come by falling count; the end is a unit always
        first = np.unique(np.append(words[:units - 1], np.uint64(END)))
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        self.own = np.full(len(words), -1)
        place = np.searchsorted(first, self.words)
        is_unit = first[np.minimum(place, len(first) - 1)] == self.words
        self.own[is_unit] = place[is_unit]
        self.single = len(first)
        self.total = len(first) + SHAPES
        self.end = 0  # END is the smallest

    def places(self, word: np.ndarray) -> np.ndarray:
        """Where each word stands among the frequent ones, -1 if it is none."""
        if not len(self.words):
            return np.full(len(word), -1)
        place = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        return np.where(self.words[place] == word, place, -1)

    def look_up(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The count of each word (-1 if it is not a frequent one) and its unit."""
        place = self.places(word)
        shape = self.single + (word & np.uint64(SHAPES - 1)).astype(np.int64)
        own = np.append(self.own, -1)[place]  # the last entry is that of unknown words
        unit = np.where(own >= 0, own, shape)
        return np.append(self.counts, -1)[place], np.where(word == END, self.end, unit)


def bigram_counts(docs: DataFrame, units: Units, group: np.ndarray) -> np.ndarray:
    """Counts of (group before, group) over all training texts, where ``group`` has one for each unit."""
    size, held = int(group.max()) + 1, docs.sparkSession.sparkContext.broadcast((units, group))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (units, group), matrix = held.value, np.zeros(size * size, np.int64)
        for batch in batches:
            train = batch.column(1).to_numpy(zero_copy_only=False)
            before = group[units.end]
            for text, word in stream(batch.column(0)):
                here = group[units.look_up(word)[1]]
                cell = np.append(before, here[:-1]) * size + here
                matrix += np.bincount(cell[train[text]], minlength=size * size)
                before = here[-1]
        met = np.flatnonzero(matrix)
        for at in range(0, len(met), 1 << 16):
            part = met[at:at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(matrix[part])], ["cell", "n"])

    found = (docs.select("text", "train").mapInArrow(count, "cell long, n long")
             .groupBy("cell").agg(F.sum("n").alias("n")).toPandas())
    matrix = np.zeros(size * size)
    matrix[found["cell"].to_numpy(np.int64)] = found["n"]
    return matrix.reshape(size, size)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def _gains(table: np.ndarray, after: np.ndarray, before: np.ndarray, own: float) -> np.ndarray:
    """Likelihood gained by adding a unit to each class of ``table``: its row, its column, its own cell, and the two margins."""
    rows, columns = table + after, table + before[:, None]
    plain = _xlogx(table)
    gain = (_xlogx(rows) - plain).sum(1) + (_xlogx(columns) - plain).sum(0)
    diagonal = np.diag(table)
    gain -= _xlogx(diagonal + after) + _xlogx(diagonal + before) - 2 * _xlogx(diagonal)
    gain += _xlogx(diagonal + after + before + own) - _xlogx(diagonal)
    for margin, part in ((table.sum(1) + before, after.sum() + own), (table.sum(0) + after, before.sum() + own)):
        gain -= _xlogx(margin + part) - _xlogx(margin)
    return gain


def exchange_classes(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each unit: units move, most frequent first, to the class that raises the bigram likelihood most."""
    size = len(bigrams)
    classes = min(classes, size)
    order = np.argsort(-bigrams.sum(0), kind="stable")
    of = np.empty(size, np.int64)
    of[order] = np.arange(size) % classes
    member = np.eye(classes)[of]
    table = member.T @ bigrams @ member
    for _ in range(sweeps):
        moved = 0
        for w in order:
            here, own = of[w], bigrams[w, w]
            after, before = bigrams[w] @ member, bigrams[:, w] @ member
            after[here] -= own
            before[here] -= own
            table[here] -= after
            table[:, here] -= before
            table[here, here] -= own
            gain = _gains(table, after, before, own)
            there = int(np.argmax(gain))
            if gain[there] <= gain[here] + 1e-9 * abs(gain[here]):
                there = here
            moved += there != here
            of[w] = there
            member[w] = np.eye(classes)[there]
            table[there] += after
            table[:, there] += before
            table[there, there] += own
        if not moved:
            break
    return of


def count_contexts(batches: Iterator[pa.RecordBatch], head: Units, classes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts by key, the frequent word's place times twice the number of classes plus its cell, of texts (text, train)."""
    size, tally = int(classes.max()) + 1, _Tally()

    def rows() -> Iterator[pa.RecordBatch]:
        for keys, counts in tally.take():
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])

    for batch in batches:
        train = batch.column(1).to_numpy(zero_copy_only=False)
        # what ended the stretch before; the first word of a batch follows an end
        last_place, last = -1, classes[head.end]
        for text, word in stream(batch.column(0)):
            place, unit = head.places(word), head.look_up(word)[1]
            place = np.append(last_place, np.where((place >= 0) & (unit >= head.single) & train[text], place, -1))
            here = np.append(last, classes[unit])
            follows, leads = place[1:] >= 0, place[:-1] >= 0
            tally.add(np.append(place[1:][follows] * 2 * size + here[:-1][follows],
                                place[:-1][leads] * 2 * size + size + here[1:][leads]))
            last_place, last = place[-1], here[-1]
            if tally.full():
                yield from rows()
    yield from rows()


def context_counts(docs: DataFrame, head: Units, classes: np.ndarray) -> DataFrame:
    """``place`` (among the frequent words), ``cell`` and ``n``: how often each frequent word that is no unit of ``head``
    comes after a class (cells from 0) and before one (cells from the number of classes)."""
    cells, held = 2 * (int(classes.max()) + 1), docs.sparkSession.sparkContext.broadcast((head, classes))
    counted = docs.select("text", "train").mapInArrow(lambda batches: count_contexts(batches, *held.value), "key long, n long")
    return counted.groupBy("key").agg(F.sum("n").alias("n")).select(
        F.floor(F.col("key") / cells).cast("int").alias("place"), (F.col("key") % cells).cast("int").alias("cell"), "n")


def spread_classes(docs: DataFrame, head: Units, bigrams: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The class of every frequent word and shape, in the order of units when all frequent words are units."""
    size = int(classes.max()) + 1
    member = np.eye(size)[classes]
    table = member.T @ bigrams @ member
    shape = classes[head.single + (head.words & np.uint64(SHAPES - 1)).astype(np.int64)]
    held = docs.sparkSession.sparkContext.broadcast((table, shape))

    def place(block: pa.Table) -> pa.Table:
        table, shape = held.value
        places, row = np.unique(block["place"].to_numpy(), return_inverse=True)
        contexts = np.zeros((len(places), 2 * size))
        contexts[row, block["cell"].to_numpy()] = block["n"].to_numpy()
        found = np.empty(len(places), np.int32)
        for k, (at, context) in enumerate(zip(places, contexts)):
            before, after, here = context[:size], context[size:], shape[at]
            rest = table.copy()
            rest[here] -= after
            rest[:, here] -= before
            # a word beside one of its shape's class stands in the row and in the column
            gain = _gains(np.maximum(rest, 0), after, before, 0)
            best = int(np.argmax(gain))
            found[k] = best if gain[best] > gain[here] + 1e-9 * abs(gain[here]) else here
        return pa.table({"place": pa.array(places.astype(np.int32)), "class": pa.array(found)})

    blocks = context_counts(docs, head, classes).withColumn("block", F.floor(F.col("place") / 256))
    # one row for each frequent word at most
    found = blocks.groupBy("block").applyInArrow(place, "place int, class int").toPandas()
    of = np.where(head.own >= 0, classes[np.maximum(head.own, 0)], shape)
    of[found["place"].to_numpy(np.int64)] = found["class"].to_numpy(np.int64)
    if not (head.words == END).any():
        of = np.append(classes[head.end], of)
    return np.append(of, classes[head.single:])


class Model:
    """Logarithms (base 10) of P(unit | unit before), and what words of a shape need.

    ``table`` counts pairs of classes, ``unit_n`` the tokens of each unit less what words gave to the unseen ones of
    their shape, and ``freed`` what each shape was given so.
    """

    def __init__(self, units: Units, table: np.ndarray, classes: np.ndarray, unit_n: np.ndarray,
                 shapes: dict[int, tuple[int, int]], freed: np.ndarray, tokens: int, words: int, letters: np.ndarray):
        self.units, self.classes, self.tokens, self.words, self.letters = units, classes, tokens, words, letters
        count = len(table)
        class_n, weight = table.sum(0), np.where(unit_n > 0, unit_n, 0.5)
        plain = (class_n + 0.5) / (class_n.sum() + 0.5 * count)
        left = table.sum(1, keepdims=True)
        kept = np.maximum(table - DISCOUNT, 0)
        loose = np.where(left > 0, left - kept.sum(1, keepdims=True), 1)
        self.moves = np.log10((kept + loose * plain) / np.maximum(left, 1))
        self.emits = np.log10(weight / np.bincount(classes, weight, count)[classes])
        # tokens and distinct words of each shape, frequent words left out
        n, kinds = (np.array([shapes.get(s, (0, 0))[k] for s in range(SHAPES)], float) for k in (0, 1))
        self.shape_n = np.where(n + freed > 0, n + freed, 1)
        self.unseen = np.log10(np.where(n + freed > 0, (freed + DISCOUNT * kinds) / self.shape_n, 1))

    def step(self, before: np.ndarray, unit: np.ndarray) -> np.ndarray:
        return self.moves[self.classes[before], self.classes[unit]] + self.emits[unit]


def frequent_words(counts: DataFrame, most: int) -> DataFrame:
    """The words above the lowest step of a logarithmic scale that at most ``most`` words exceed, and the end."""
    step = F.floor(F.log2("n") * 16).cast("int")
    # steps are a thousand at most, whatever the corpus
    steps = sorted((r["step"], r["words"]) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect())
    lowest, held = 1 << 20, 0
    while steps and held + steps[-1][1] <= most:
        lowest, words = steps.pop()
        held += words
    return counts.filter((step >= lowest) | (F.col("word") == END))


def fit(docs: DataFrame, counts: DataFrame, heavy: int, units: int, classes: int) -> Model:
    """A model of the training texts in ``docs`` (text, train), whose word counts are given."""
    top = frequent_words(counts, heavy).toPandas().sort_values(["n", "word"], ascending=[False, True])
    words, n = top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    head, every = Units(words, n, units), Units(words, n, len(words) + 1)
    named = docs.sparkSession.createDataFrame(pa.table({"word": np.unique(np.append(words, np.uint64(END))).view(np.int64)}))
    # at most ``heavy`` words and the end
    rest = counts.join(F.broadcast(named), "word", "left_anti")
    shapes = {r["shape"]: (r["n"], r["kinds"]) for r in rest.groupBy(
        F.col("word").bitwiseAND(SHAPES - 1).alias("shape")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()}
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    bigrams = bigram_counts(docs, head, np.arange(head.total))
    of = spread_classes(docs, head, bigrams, exchange_classes(bigrams, classes))
    unit_n = np.zeros(every.total)
    unit_n[every.own] = every.counts
    for shape, (tokens, _) in shapes.items():
        unit_n[every.single + shape] = tokens
    # every word gives a part of its count to the unseen words of its shape
    giving = every.words != END
    unit_n[every.own[giving]] -= DISCOUNT
    freed = DISCOUNT * np.bincount((every.words[giving] & np.uint64(SHAPES - 1)).astype(np.int64), minlength=SHAPES)
    unit_n[every.single:] += freed
    return Model(every, bigram_counts(docs, every, of), of, unit_n, shapes, freed, whole["n"], whole["v"], letter_logs(docs))


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", parts: int = 7, part: int = 2,
                heavy: int = HEAVY, units: int = UNITS, classes: int = CLASSES) -> DataFrame:
    """One row per document: key, held_out, n_tokens, n_known, train_tokens, base_score and score.

    ``score`` is the model's log10 probability of the text, ``base_score`` that of add-one word frequencies; the
    perplexity of a text is 10 to the power of ``-score / n_tokens``.
    """
    spark = docs.sparkSession
    inner = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), held_out(key, parts, part).alias("held"))
    learnt = inner.select("text", (~F.col("held")).alias("train"))
    counts = materialize(word_counts(learnt))
    model = fit(learnt, counts, heavy, units, classes)
    held = spark.sparkContext.broadcast(model)
    known = T.StructType([T.StructField("id", inner.schema["id"].dataType), T.StructField("held", T.BooleanType()),
                          T.StructField("tokens", T.LongType()), T.StructField("known", T.LongType()),
                          T.StructField("base", T.DoubleType()), T.StructField("score", T.DoubleType())])
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("word", T.LongType()),
                           T.StructField("times", T.LongType()), T.StructField("spelling", T.DoubleType()),
                           T.StructField("known", known)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each text, what the frequent words tell, and one row for each rarer word."""
        model = held.value
        units = model.units
        for batch in batches:
            size = batch.num_rows
            rows = batch.column(3).to_numpy()
            sums = {name: np.zeros(size) for name in ("tokens", "known", "base", "score")}
            before = units.end
            for owner, word, spelling in spelled(batch.column(1), model.letters):
                count, unit = units.look_up(word)
                came = np.append(before, unit[:-1])
                before = unit[-1]
                frequent = count >= 0
                value = model.step(came, unit)
                base = np.where(frequent, np.log10(np.maximum(count, 0) + 1.0), 0)
                for name, weight in (("tokens", None), ("known", frequent), ("base", base), ("score", value)):
                    sums[name] += np.bincount(owner, weight, size)
                rare = np.flatnonzero(~frequent & (word != END))
                if len(rare):
                    order = rare[np.lexsort((word[rare], owner[rare]))]
                    fresh = np.append(True, (owner[order][1:] != owner[order][:-1]) | (word[order][1:] != word[order][:-1]))
                    at = np.flatnonzero(fresh)
                    for low in range(0, len(at), 1 << 16):
                        here = order[at[low:low + (1 << 16)]]
                        times = np.diff(np.append(at, len(order)))[low:low + (1 << 16)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(rows[owner[here]]), pa.array(word[here].view(np.int64)), pa.array(times), pa.array(spelling[here]),
                             pa.nulls(len(here), known_type(batch))], schema.names)
            whole = pa.StructArray.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sums["tokens"].astype(np.int64)),
                 pa.array(sums["known"].astype(np.int64)), pa.array(sums["base"]), pa.array(sums["score"])],
                fields=list(known_type(batch)))
            # no word has such a number; hashed, these rows spread over the join's tasks
            mark = texts.mix(rows.astype(np.uint64)) & ~np.uint64(SHAPES - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), pa.array(mark.view(np.int64)), pa.array(np.zeros(size, np.int64)), pa.array(np.zeros(size)), whole], schema.names)

    def known_type(batch: pa.RecordBatch) -> pa.StructType:
        return pa.struct([("id", batch.schema.field(0).type), ("held", pa.bool_()), ("tokens", pa.int64()),
                          ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])

    found = inner.select("id", "text", "held", F.monotonically_increasing_id().alias("row")).mapInArrow(read, schema)
    joined = found.join(counts, "word", "left")
    shape = F.col("word").bitwiseAND(SHAPES - 1) + 1
    shape_n = F.element_at(F.array(*[F.lit(float(x)) for x in model.shape_n]), shape.cast("int"))
    unseen = F.element_at(F.array(*[F.lit(float(x)) for x in model.unseen]), shape.cast("int"))
    n, times = F.coalesce("n", F.lit(0)), F.col("times")
    in_shape = F.when(n > 0, F.log10((n - DISCOUNT) / shape_n)).otherwise(unseen + F.col("spelling"))
    sums = joined.groupBy("row").agg(
        F.max("known").alias("known"),
        F.sum(F.when(n > 0, times).otherwise(0)).alias("rare_known"),
        F.sum(times * F.log10(n + 1.0)).alias("rare_base"), F.sum(times * in_shape).alias("rare_score"))
    norm = float(np.log10(model.tokens + model.words + 1))
    return sums.select(
        F.col("known.id").alias(key), F.col("known.held").alias("held_out"), F.col("known.tokens").alias("n_tokens"),
        (F.col("known.known") + F.col("rare_known")).alias("n_known"), F.lit(int(model.tokens)).cast("long").alias("train_tokens"),
        (F.col("known.base") + F.col("rare_base") - F.col("known.tokens") * norm).alias("base_score"),
        (F.col("known.score") + F.col("rare_score")).alias("score"))
