"""License scan: windows of a text retrieve templates by MinHash bands, and exact shingle containment verifies them.

Words are runs of letters and digits, in lower case; shingles are five words. A text is
covered by overlapping windows of 1, 4, 16 and 64 shingles, each starting a quarter of its length after the one before
(at every shingle, for the first two). Templates are cut into windows of the largest of these lengths that they hold.
A window's signature holds the smallest of its shingles' hashes under ``HASHES`` functions, in bands of ``BAND_ROWS``;
``bands_for`` gives the number of bands with which windows of similarity ``SIMILAR`` or more meet with probability
``SURE`` or more. Every template met is verified on the words around: it matches when at least ``CONTAINED`` of its
distinct shingles stand in the stretch that it would fill, with a quarter of its length to spare at either end, and the
words that decide between near licenses stand between the first and the last of them: those marked ``«»`` in the template
must, those of ``ABSENT`` must not. Every verified place is kept until the places of a text are settled: of places that
overlap, the one with the highest containment is reported (of equal ones that of the longest template, then the tightest,
then the first), so a license that loses one place to a sibling still has its other ones.

Templates are a small fixed table; texts stay where they are and nothing is shuffled. Null, empty and short texts match
nothing; repeated rows match as rows of their own; an empty table gives no rows; further columns, whatever their names, are
not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from creditspark.llm import texts

SHINGLE = 5
SCALES = (1, 4, 16, 64)
BAND_ROWS = 2
SIMILAR = 0.6
SURE = 0.999
CONTAINED = 0.8
OVERLAP = 1 << 14
LETTER = np.zeros(256, np.uint8)
LETTER[48:58] = LETTER[65:91] = LETTER[97:123] = LETTER[128:] = 1

# Public license names, notices, short texts and openings of long ones; words in marks decide.
_AS_IS = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
          "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
          "DISCLAIMED.")
_CLAUSES = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
            "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
            "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
            "distribution. ")
_VERBATIM = ("Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not "
             "allowed.")
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the «Apache License, Version 2.0» (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        "an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for "
        "the specific language governing permissions and limitations under the License.",
        "«Apache License Version 2.0», January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, "
        "AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution "
        "as defined by Sections 1 through 9 of this document.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ],
    "GPL-3.0": [
        "This work is licensed under the «GNU General Public License, version 3».",
        "This program is free software: you can redistribute it and/or modify it under the terms of the «GNU General "
        "Public License» as published by the Free Software Foundation, either «version 3 of the License», or (at your "
        "option) any later version.",
        "«GNU GENERAL PUBLIC LICENSE Version 3», 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. "
        "<https://fsf.org/> " + _VERBATIM,
    ],
    "GPL-2.0": [
        "This work is licensed under the «GNU General Public License, version 2».",
        "This program is free software; you can redistribute it and/or modify it under the terms of the «GNU General "
        "Public License» as published by the Free Software Foundation; either «version 2 of the License», or (at your "
        "option) any later version.",
        "«GNU GENERAL PUBLIC LICENSE Version 2», June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc., " + _VERBATIM,
    ],
    "LGPL-3.0": [
        "This work is licensed under the «GNU Lesser General Public License, version 3».",
        "This program is free software: you can redistribute it and/or modify it under the terms of the «GNU Lesser General "
        "Public License» as published by the Free Software Foundation, either «version 3 of the License», or (at your "
        "option) any later version.",
        "«GNU LESSER GENERAL PUBLIC LICENSE Version 3», 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. "
        "<https://fsf.org/> " + _VERBATIM,
    ],
    "LGPL-2.1": [
        "This work is licensed under the «GNU Lesser General Public License, version 2.1».",
        "This library is free software; you can redistribute it and/or modify it under the terms of the «GNU Lesser General "
        "Public License» as published by the Free Software Foundation; either «version 2.1 of the License», or (at your "
        "option) any later version.",
        "«GNU LESSER GENERAL PUBLIC LICENSE Version 2.1», February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. "
        + _VERBATIM,
    ],
    "AGPL-3.0": [
        "This work is licensed under the «GNU Affero General Public License, version 3».",
        "This program is free software: you can redistribute it and/or modify it under the terms of the «GNU Affero General "
        "Public License» as published by the Free Software Foundation, either «version 3 of the License», or (at your "
        "option) any later version.",
        "«GNU AFFERO GENERAL PUBLIC LICENSE Version 3», 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. "
        "<https://fsf.org/> " + _VERBATIM,
    ],
    "BSD-2-Clause": [_CLAUSES + _AS_IS],
    "BSD-3-Clause": [
        _CLAUSES + "«Neither the name» of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission. " + _AS_IS,
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the «Mozilla Public License, v. 2.0». If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "«Mozilla Public License Version 2.0» 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that "
        "creates, contributes to the creation of, or owns Covered Software.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, «provided that the above copyright notice» and this permission notice appear in all copies.",
    ],
    "0BSD": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted. «THE SOFTWARE IS PROVIDED» \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a «Creative Commons Attribution 4.0» International "
                  "License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a «Creative Commons "
                     "Attribution-ShareAlike 4.0» International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a «Creative Commons "
                     "Attribution-NoDerivatives 4.0» International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a «Creative Commons "
                     "Attribution-NonCommercial 4.0» International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a «Creative Commons "
                        "Attribution-NonCommercial-ShareAlike 4.0» International License."],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a «Creative Commons "
                        "Attribution-NonCommercial-NoDerivatives 4.0» International License."],
}
# Words that a near license has and this one has not.
ABSENT = {
    "BSD-2-Clause": ["neither the name", "all advertising materials"],
    "BSD-3-Clause": ["all advertising materials"],
    "0BSD": ["provided that the above copyright notice"],
}


def bands_for(similar: float = SIMILAR, sure: float = SURE, rows: int = BAND_ROWS) -> int:
    """The fewest bands of ``rows`` hashes in which sets of similarity ``similar`` agree at least once, as surely as asked."""
    return math.ceil(math.log(1 - sure) / math.log(1 - similar ** rows))


HASHES = BAND_ROWS * bands_for()
FACTORS = texts.mix(np.arange(1, HASHES + 1, dtype=np.uint64) * texts.BASE) | np.uint64(1)


def _shingle_hashes(words: np.ndarray) -> np.ndarray:
    """A hash of every run of ``SHINGLE`` word hashes."""
    if len(words) < SHINGLE:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        out = out * texts.BASE + words[k:len(words) - SHINGLE + 1 + k]
    return texts.mix(out)


def _window_keys(shingles: np.ndarray, scale: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each band, the keys of the windows of ``scale`` shingles, one every ``hop`` shingles; the last are shorter."""
    hop = max(1, scale // 4)
    at = np.arange(0, len(shingles), hop)
    for band in range(HASHES // BAND_ROWS if scale > 1 else 1):
        key = np.full(len(at), np.uint64(band * len(SCALES) + SCALES.index(scale) + 1))
        for row in range(BAND_ROWS if scale > 1 else 1):
            hashed = (shingles * FACTORS[band * BAND_ROWS + row]) >> np.uint64(8)
            low = np.minimum.reduceat(hashed, at) if hop > 1 else hashed
            wide = low.copy()
            for k in range(1, min(scale // hop, len(low))):
                np.minimum(wide[:len(low) - k], low[k:], out=wide[:len(low) - k])
            key = (key ^ wide) * texts.BASE
        yield hop, texts.mix(key)


class Templates:
    """The templates' words and shingles, and which of their windows each band key belongs to."""

    def __init__(self, table: dict[str, list[str]], absent: dict[str, list[str]] | None = None):
        self.name, self.shingles, self.length, self.marks, self.absent = [], [], [], [], []
        self.overlap = OVERLAP
        self.windows: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for name, bodies in table.items():
            for body in bodies:
                marks = re.findall("«([^»]*)»", body)
                plain = body.replace("«", "").replace("»", "")
                words, hashed = _words(np.frombuffer(plain.encode(), np.uint8))[:2]
                own = [tuple(words[i:i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]
                if not own:
                    raise ValueError(f"a template of {name} has fewer than {SHINGLE} words")
                number, keys = len(self.name), _shingle_hashes(hashed)
                self.name.append(name)
                self.shingles.append(defaultdict(list))
                for i, shingle in enumerate(own):
                    self.shingles[number][shingle].append(i)
                self.length.append(len(own))
                self.marks.append([_phrase(m) for m in marks])
                self.absent.append([_phrase(m) for m in (absent or {}).get(name, [])])
                self.overlap = max(self.overlap, 4 * len(plain.encode()))
                scale = max(s for s in SCALES if s <= len(own))
                starts = sorted({*range(0, len(own) - scale + 1, max(1, scale // 2)), len(own) - scale})
                for start in starts:
                    for _, found in _window_keys(keys[start:start + scale], scale):
                        self.windows[int(found[0])].append((number, start))
        self.keys = np.array(sorted(self.windows), np.uint64)
        self.mark = np.zeros(1 << 18, bool)
        self.mark[self.keys & np.uint64(len(self.mark) - 1)] = True

    def met(self, keys: np.ndarray) -> np.ndarray:
        """Places in ``keys`` of keys that a template has."""
        maybe = np.flatnonzero(self.mark[keys & np.uint64(len(self.mark) - 1)])
        place = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
        return maybe[self.keys[place] == keys[maybe]]


def _phrase(text: str) -> bytes:
    """The words of ``text`` with a space around each, to be looked for among others written so."""
    return b" " + b" ".join(_words(np.frombuffer(text.encode(), np.uint8))[0]) + b" "


def _words(data: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Words of one text: their bytes, hashes, begins and ends."""
    data = texts.LOWER[data]
    begin, end = texts.bounds(LETTER[data], np.zeros(1, np.int64))
    return [data[a:b].tobytes() for a, b in zip(begin, end)], texts.hashes(data, begin, end), begin, end


def _stretches(column: pa.Array, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(bytes, starts, documents, place of the first byte in its text); cut texts overlap by ``overlap`` bytes or more."""
    tail, place = None, 0
    for data, starts, documents, going_on in texts.pieces(*texts.utf8(column)):
        if tail is None:
            yield data, starts, documents, 0
            place = 0
        else:
            yield np.concatenate([tail, data]), starts, documents, place - len(tail)
        if going_on:
            place += len(data)
            gaps = np.flatnonzero(texts.SPACE[data[-2 * overlap:-overlap]])
            whole = data if tail is None or len(data) > 2 * overlap else np.concatenate([tail, data])
            tail = data[-2 * overlap:][int(gaps[-1]) + 1:] if len(gaps) else whole
        else:
            tail, place = None, 0


def _verify(words: list[bytes], templates: Templates, template: int, expected: int) -> tuple[float, int, int] | None:
    """(containment, first word, one past the last word) of a template in a stretch of words, or None where it is not.

    ``expected`` is the place where the template would begin; of repeated shingles the one nearest its own place counts,
    so the copy of a notice that follows another keeps its own span.
    """
    own = templates.shingles[template]
    met: dict[tuple, tuple[int, int]] = {}
    for i in range(len(words) - SHINGLE + 1):
        shingle = tuple(words[i:i + SHINGLE])
        if shingle in own:
            away = min(abs(i - expected - at) for at in own[shingle])
            if shingle not in met or away < met[shingle][0]:
                met[shingle] = (away, i)
    share = len(met) / len(own)
    if share < CONTAINED:
        return None
    first, last = min(i for _, i in met.values()), max(i for _, i in met.values()) + SHINGLE
    said = b" " + b" ".join(words[first:last]) + b" "
    if any(mark not in said for mark in templates.marks[template]) or any(mark in said for mark in templates.absent[template]):
        return None
    return share, first, last


def settle(places: dict[tuple[int, int, int], float], lengths: list[int]) -> list[tuple[int, float, int, int]]:
    """(template, containment, begin, end) of places that do not overlap, the best contained first to be taken."""
    taken: list[tuple[int, int]] = []
    kept = []
    for (template, begin, end), share in sorted(
            places.items(), key=lambda p: (-p[1], -lengths[p[0][0]], p[0][2] - p[0][1], p[0][1], p[0][0])):
        at = bisect_left(taken, (begin, end))
        if (at < len(taken) and taken[at][0] < end) or (at and taken[at - 1][1] > begin):
            continue
        insort(taken, (begin, end))
        kept.append((template, share, begin, end))
    return sorted(kept, key=lambda k: k[2])


def matches(column: pa.Array, templates: Templates) -> Iterator[tuple[int, int, float, int, int]]:
    """(text number, template, containment, begin, end): verified templates, places as bytes of the UTF-8 text."""
    found: dict[int, dict[tuple[int, int, int], float]] = defaultdict(dict)
    for data, starts, documents, place in _stretches(column, templates.overlap):
        data = texts.LOWER[data]
        begin, end = texts.bounds(LETTER[data], starts)
        shingles = _shingle_hashes(texts.hashes(data, begin, end))
        if not len(shingles):
            continue
        owner = texts.owners(starts, begin)
        candidates: set[tuple[int, int]] = set()
        for scale in SCALES:
            for hop, keys in _window_keys(shingles, scale):
                for at in templates.met(keys).tolist():
                    for template, offset in templates.windows[int(keys[at])]:
                        candidates.update((template, at * hop - offset + slack) for slack in {-(hop // 2), 0, hop // 2})
        for template, first in sorted(candidates):
            length = templates.length[template]
            spare = length // 4
            middle = min(max(first + length // 2, 0), len(begin) - 1)
            lowest, highest = np.searchsorted(owner, owner[middle], "left"), np.searchsorted(owner, owner[middle], "right")
            low, high = max(first - spare, lowest), min(first + length + spare + SHINGLE - 1, highest)
            words = [data[a:b].tobytes() for a, b in zip(begin[low:high], end[low:high])]
            met = _verify(words, templates, template, first - low)
            if met is not None:
                base = place - int(starts[owner[middle]])
                span = (template, base + int(begin[low + met[1]]), base + int(end[low + met[2] - 1]))
                places = found[int(documents[owner[middle]])]
                places[span] = max(met[0], places.get(span, 0.0))
    for text, places in sorted(found.items()):
        for match in settle(places, templates.length):
            yield text, *match


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, absent: dict[str, list[str]] = ABSENT,
                  key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per place of a license in a document: id, license, containment, and its bytes [begin, end) in the text."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType)] + [T.StructField(n, t) for n, t in (
        ("license", T.StringType()), ("containment", T.DoubleType()), ("begin", T.LongType()), ("end", T.LongType()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, absent)
        for batch in batches:
            columns = list(zip(*matches(batch.column(1), known))) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array([known.name[t] for t in columns[1]], pa.string()),
                 pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())],
                schema.names)

    return docs.select(key, text).mapInArrow(scan, schema)
