"""Whole-batch text helpers: Arrow texts as one byte array, words found and hashed with numpy.

Nothing here knows about Spark; the operators call these functions inside ``mapInArrow`` tasks. Work goes over
pieces of about ``PIECE`` bytes, so memory stays flat however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a batch as one byte array and the offsets between them; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0]:ends[-1]], ends - ends[0]


def pieces(data: np.ndarray, ends: np.ndarray, limit: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """Cut a batch into (bytes, starts, documents, open): stretches of about ``limit`` bytes.

    ``starts`` says where each document begins in the stretch and ``documents`` is its number in the batch. Texts
    longer than the limit are cut after white space, so words stay whole; a single longer word is not cut. ``open``
    says that the last text goes on in the next stretch.
    """
    first, count = 0, len(ends) - 1
    while first < count:
        last = int(np.searchsorted(ends, ends[first] + limit, "right")) - 1
        if last > first:
            yield data[ends[first]:ends[last]], ends[first:last] - ends[first], np.arange(first, last), False
            first = last
            continue
        at, stop = int(ends[first]), int(ends[first + 1])
        while at < stop:
            to = min(at + limit, stop)
            if to < stop:
                gaps = np.flatnonzero(SPACE[data[at:to]])
                if not len(gaps):
                    gaps, to = np.flatnonzero(SPACE[data[to:stop]]), to
                    to = to + int(gaps[0]) + 1 if len(gaps) else stop
                else:
                    to = at + int(gaps[-1]) + 1
            yield data[at:to], np.zeros(1, np.int64), np.array([first]), to < stop
            at = to
        first += 1


def bounds(kind: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every run of equal ``kind`` above 0; runs end at document starts too."""
    if not len(kind):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = np.empty(len(kind), bool)
    fresh[0] = True
    np.not_equal(kind[1:], kind[:-1], out=fresh[1:])
    fresh[starts[starts < len(kind)]] = True
    begin = np.flatnonzero(fresh)
    end = np.append(begin[1:], len(kind))
    held = kind[begin] > 0
    return begin[held], end[held]


def _power(kind: str, n: int) -> np.ndarray:
    if kind not in _powers or len(_powers[kind]) < n:
        steps = np.full(max(n, PIECE + 1), BASE if kind == "up" else INVERSE)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps)
    return _powers[kind][:n]


def hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every stretch ``data[begin:end]``: a polynomial of its bytes, mixed at the end."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", len(data)), out=total[1:])
    return mix((total[end] - total[begin]) * _power("down", len(data) + 1)[begin])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def owners(starts: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For every word, the place in ``starts`` of the document that holds it."""
    return np.searchsorted(starts, begin, "right") - 1
