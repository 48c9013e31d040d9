"""Packing documents into sequences of a fixed number of tokens, by local search with swaps.

Documents are tokenized, closed with an end id, and cut only if longer than a sequence (all pieces but the first are
whole sequences). Pieces are dealt by a hash into groups of bounded size, and each group is packed in one task: best
fit first, then a local search that moves a piece, exchanges one for one, two for one or one for two between underfull
sequences whenever that raises the sum of squared fills. The emptiest sequence thus gives up its pieces until it is
empty. The search ends when the sequences are as few as the tokens allow or no exchange is left that helps; every step
raises a bounded integer, so it ends. A group of about ``GROUP_BYTES`` of text leaves at most a sequence or so
partly filled, whatever the size of the table.

Packing needs lengths only. The pieces with their ids are stored once; the places found from the lengths are then joined
to them, so no group of ids is ever held in a task.

Null texts count as empty: one end id. A null id is kept as null; repeated rows are packed as rows of their own. An
empty table gives no rows.
"""

from __future__ import annotations

import ctypes
import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditspark.llm.rows import stored

LENGTH = 2048
END_ID = 0
GROUP_BYTES = 32 << 20
WORDS_KEPT = 1_000_000
LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
PLAIN = re.compile(f"[{LETTERS}]+")
TWO_BYTES = [i.to_bytes(2, "little") for i in range(1 << 16)]


class _Irregular(Exception):
    """A text whose white space does not stand alone between words."""


class WordIds(dict):
    """Ids of words, as little-endian 16-bit bytes, computed when first met.

    Keys are words that follow a space, ``\0`` and words that follow nothing, or one line end.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        # as in a plain call of the tokenizer, the strings of its special tokens become those tokens
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this tokenizer do not fit 16 bits")
        self.split, self.merge, self.parts = self.tokenizer.pre_tokenizer.pre_tokenize_str, self.tokenizer.model.tokenize, {}
        # the signs that the splitter writes for the bytes of a letter
        self.written = {ord(c): "".join(p for p, _ in self.split(c)) for c in map(chr, range(0x180)) if re.match(f"[{LETTERS}]", c)}
        # does it keep a run of plain letters whole, with the space before it (written as Ġ), and a run of signs apart?
        made = [[p for p, _ in self.split(s)] for s in (" aZZab", " aZſéÀb", " aZZab.", "éab'.%&")]
        self.runs = made == [["ĠaZZab"], ["ĠaZ" + "ſéÀ".translate(self.written) + "b"], ["ĠaZZab", "."],
                             ["é".translate(self.written) + "ab", "'.%&"]]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def part(self, part: str) -> bytes:
        """The ids of one part that the tokenizer's own splitter has made; words share such parts."""
        found = self.parts.get(part)
        if found is None:
            if len(self.parts) >= WORDS_KEPT:
                self.parts.clear()
            found = self.parts[part] = b"".join([TWO_BYTES[token.id] for token in self.merge(part)])
        return found

    def __missing__(self, word: str) -> bytes:
        bare = word[1:] if word[:1] == "\0" else word
        letters = bare.rstrip(string.punctuation)
        ascii_only = letters.isascii()
        if self.runs and letters and (letters.isalpha() if ascii_only else PLAIN.fullmatch(letters)):
            if len(letters) < len(bare):
                # words that differ by their signs share the ids of their letters, kept as a word of their own
                signs = len(bare) - len(letters)
                found = self[word[:-signs]] + self.part(word[-signs:])
            else:
                written = letters if ascii_only else letters.translate(self.written)
                found = b"".join([TWO_BYTES[token.id] for token in self.merge(written if bare is not word else "Ġ" + written)])
        else:
            if word != "\n" and (not bare or bare != bare.strip()):
                raise _Irregular
            content = bare if bare is not word or word == "\n" else " " + word
            found = b"".join([self.part(part) for part, _ in self.split(content)])
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids of a text. The tokenizer never joins a visible character to white space after it, so where
        spaces and line ends stand alone the words between them can be encoded one by one."""
        if not text:
            return b""
        if "\0" not in text and not any(s in text for s in self.special):
            try:
                return b"".join(map(self.__getitem__, ("\0" + text.replace("\n", " \n \0")).split(" ")))
            except _Irregular:
                pass
        return self.whole(text)


    def forget(self) -> None:
        """Drop all words and give their memory back: a task's worker lives on, for tasks that need it otherwise."""
        self.clear()
        self.parts.clear()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


_known: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _known:
        _known[path] = WordIds(path)
    return _known[path]


def cut(total: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``total`` tokens; only the first may be shorter."""
    count = -(-total // length)
    first = total - length * (count - 1)
    return [(0, first)] + [(first + length * k, length) for k in range(count - 1)]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.append(0, np.cumsum([len(a) for a in arrays])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, "<u4"), *arrays]).astype(np.int32)))


def token_pieces(docs: DataFrame, path: str, length: int = LENGTH, key: str = "doc_id", text: str = "text",
                 with_ids: bool = True) -> DataFrame:
    """One row per piece: id, row, piece, start, length, the ids' checksum and, if asked for, ``ids``.

    The checksum is over little-endian 32-bit ids.
    """
    schema = T.StructType([T.StructField("id", docs.schema[key].dataType)] + [
        T.StructField(n, t) for n, t in (("row", T.LongType()), ("piece", T.IntegerType()), ("start", T.LongType()),
                                         ("length", T.LongType()), ("ids_crc32", T.LongType()))]
        + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = word_ids(path), np.array([END_ID], "<u2").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                of, rows, held, sums = [], [], [], []
                for k, content in enumerate(part.column(2).to_pylist()):
                    ids = known.encode(content or "") + end
                    for number, (start, size) in enumerate(cut(len(ids) // 2, length)):
                        of.append(k)
                        rows.append((number, start, size))
                        piece = np.frombuffer(ids, "<u2", size, 2 * start).astype("<u4")
                        sums.append(zlib.crc32(piece))
                        if with_ids:
                            held.append(piece)
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(of)), part.column(1).take(pa.array(of)), pa.array(columns[0], pa.int32()),
                     pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(sums, pa.int64())]
                    + [_lists(held)] * with_ids, schema.names)
        known.forget()

    chosen = docs.select(F.col(key), F.monotonically_increasing_id().alias("_row"), F.col(text))
    return chosen.mapInArrow(pieces, schema)


def best_fit(sizes: list[int], cap: int) -> list[list[int]]:
    """Bins of item numbers: each item, largest first, goes where the least room is left."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(cap + 1)]
    rooms = 0  # bit r says that some bin has r left
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[item]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            place = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, place = cap, len(bins)
            bins.append([])
        bins[place].append(item)
        by_room[room - size].append(place)
        rooms |= 1 << (room - size)
    return bins


def _offers(members: list[int], sizes: list[int]) -> list[tuple[int, ...]]:
    """What a bin can give: a piece of each size it holds, and two pieces of each two sizes.

    Pieces of one size are alike, and different sizes that fit one bin are few: below 64 in 2048 tokens.
    """
    alike: dict[int, list[int]] = {}
    for i in members:
        alike.setdefault(sizes[i], []).append(i)
    one = [same[0] for same in alike.values()]
    return ([(i,) for i in one] + [(i, j) for n, i in enumerate(one) for j in one[n + 1:]]
            + [(same[0], same[1]) for same in alike.values() if len(same) > 1])


class _Table:
    """The offers of underfull bins as columns (bin, size, count, room, fill), kept per bin between exchanges."""

    def __init__(self, sizes: list[int], cap: int):
        self.sizes, self.cap = sizes, cap
        self.offers: dict[int, list[tuple[int, ...]]] = {}
        self.parts: dict[int, np.ndarray] = {}

    def put(self, place: int, members: list[int], fill: int) -> None:
        self.columns = None
        if not members or fill == self.cap:
            self.offers.pop(place, None)
            self.parts.pop(place, None)
            return
        self.offers[place] = offers = _offers(members, self.sizes)
        part = np.empty((5, len(offers)), np.int64)
        part[0], part[3], part[4] = place, self.cap - fill, fill
        part[1] = [sum(self.sizes[i] for i in o) for o in offers]
        part[2] = [len(o) for o in offers]
        self.parts[place] = part

    def all(self) -> np.ndarray:
        if self.columns is None:
            self.columns = np.concatenate(list(self.parts.values()), axis=1)
            ends = np.cumsum([p.shape[1] for p in self.parts.values()])
            self.starts = dict(zip(self.parts, np.append(0, ends[:-1]).tolist()))
        return self.columns

    def offer(self, at: int) -> tuple[int, ...]:
        place = int(self.columns[0, at])
        return self.offers[place][at - self.starts[place]]


def improve(bins: list[list[int]], sizes: list[int], cap: int) -> list[list[int]]:
    """Fewer bins by moves and swaps that raise the sum of squared fills."""
    fill = [sum(sizes[i] for i in b) for b in bins]
    fewest = -(-sum(fill) // cap)
    used = sum(1 for b in bins if b)
    if used <= fewest:
        return [b for b in bins if b]
    table = _Table(sizes, cap)
    for place, members in enumerate(bins):
        table.put(place, members, fill[place])
    stuck: set[int] = set()
    while used > fewest:
        donor = min((b for b in table.parts if b not in stuck), key=fill.__getitem__, default=None)
        if donor is None:
            break
        here, own = fill[donor], bins[donor]
        of, size, count, room, filled = table.all()
        others = of != donor
        best = (0, (), (), -1)
        for give in _offers(own, sizes):
            x = sum(sizes[i] for i in give)
            more = x - size
            fits = others & (more > 0) & (more <= room) & (count + len(give) <= 3)
            at = np.flatnonzero(fits)
            if len(at):
                gains = 2 * more[at] * (filled[at] + more[at] - here)
                top = int(np.argmax(gains))
                if gains[top] > best[0]:
                    best = (int(gains[top]), give, table.offer(at[top]), int(of[at[top]]))
            at = np.flatnonzero(others & (room >= x)) if len(give) == 1 else at[:0]
            if len(at):
                target = int(of[at[np.argmin(room[at])]])
                gain = 2 * x * (fill[target] + x - here)
                if gain > best[0]:
                    best = (gain, give, (), target)
        gain, give, take, target = best
        if not gain:
            stuck.add(donor)
            continue
        moved = sum(sizes[i] for i in give) - sum(sizes[i] for i in take)
        bins[donor] = [i for i in own if i not in give] + list(take)
        bins[target] = [i for i in bins[target] if i not in take] + list(give)
        fill[donor], fill[target] = here - moved, fill[target] + moved
        for place in (donor, target):
            table.put(place, bins[place], fill[place])
        used -= not bins[donor]
        stuck -= {donor, target}
    return [b for b in bins if b]


def pack_sizes(sizes: list[int], cap: int) -> list[list[int]]:
    return improve(best_fit(sizes, cap), sizes, cap)


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH, group_bytes: int = GROUP_BYTES,
                   key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ``ids``.

    A sequence is read by its pieces in the order of ``offset``.
    """
    volume = docs.agg(F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0)) + F.count("*") * 8).first()[0]
    groups = max(1, -(-volume // group_bytes))
    pieces = token_pieces(docs, path, length, key, text, with_ids)
    pieces = stored(pieces, "pieces") if with_ids else pieces
    slim = pieces.drop("ids").withColumn("_group", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)))
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("row", T.LongType()),
                           T.StructField("piece", T.IntegerType())] + [
        T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "sequence_id", "offset")])

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("row", "ascending"), ("piece", "ascending")])
        sizes = group["length"].to_pylist()
        whole = [i for i, n in enumerate(sizes) if n == length]
        part = [i for i, n in enumerate(sizes) if n < length]
        bins = [[i] for i in whole] + [[part[i] for i in b] for b in pack_sizes([sizes[i] for i in part], length)]
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for number, members in enumerate(bins):
            at = 0
            for i in members:
                sequence[i], offset[i] = number, at
                at += sizes[i]
        columns = [group["id"], group["row"], group["piece"], group["start"], group["length"], group["ids_crc32"],
                   pa.array((group["_group"][0].as_py() << 32) + sequence), pa.array(offset)]
        return pa.Table.from_arrays(columns, schema.names)

    placed = slim.groupBy("_group").applyInArrow(pack, schema)
    if not with_ids:
        return placed.drop("row")
    names = [c for c in schema.names if c != "row"]
    inner = placed.toDF("_id", *schema.names[1:])
    return inner.join(pieces.select("row", "piece", "ids"), ["row", "piece"]).select(
        F.col("_id").alias(key), *names[1:], "ids")


def read_checksums(packed: DataFrame) -> DataFrame:
    """``packed`` with ``ids_crc32`` taken anew from the packed ``ids``, which are dropped."""
    kept = [c for c in packed.columns if c not in ("ids", "ids_crc32")]
    schema = T.StructType([*[packed.schema[c] for c in kept], T.StructField("ids_crc32", T.LongType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            values, ends = lists.values.to_numpy().astype("<u4"), lists.offsets.to_numpy()
            sums = [zlib.crc32(values[a:b]) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sums, pa.int64())], schema.names)

    return packed.select(*kept, "ids").mapInArrow(read, schema)
