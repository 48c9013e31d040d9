"""License scans: near licenses told apart, every place reported, containments as by brute force."""

from __future__ import annotations

import random
import re

import pytest

from creditspark.llm import licenses

BODIES = {name: [re.sub("[«»]", "", b) for b in bodies] for name, bodies in licenses.TEMPLATES.items()}
NOTICE = "This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU {1}General " \
         "Public License as published by the Free Software Foundation{2} either version {3} of the License, or (at your option) any later version."


def scan(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string, begin int")
    return [r.asDict() for r in licenses.scan_licenses(docs, **options).orderBy("doc_id", "begin").collect()]


def names(found):
    out = {}
    for r in found:
        out.setdefault(r["doc_id"], []).append(r["license"])
    return out


def words(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", text.encode().lower())


def brute(text, body):
    """The highest containment of ``body`` at any place of ``text``, without windows or bands."""
    said, own = words(text), words(body)
    need = {tuple(own[i:i + 5]) for i in range(len(own) - 4)}
    length = len(own) - 4
    spare = length // 4
    best = 0.0
    for first in range(-spare, len(said)):
        stretch = said[max(first - spare, 0):max(first + length + spare + 4, 0)]
        best = max(best, len(need & {tuple(stretch[i:i + 5]) for i in range(len(stretch) - 4)}) / len(need))
    return best


def test_near_licenses_are_told_apart(spark):
    bsd2, bsd3 = BODIES["BSD-2-Clause"][0], BODIES["BSD-3-Clause"][0]
    cases = [
        ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
        ("This work is licensed under the GNU General Public License, version 4.", []),
        (NOTICE.format(":", "", ",", "3"), ["GPL-3.0"]),
        (NOTICE.format(";", "", ";", "2"), ["GPL-2.0"]),
        (NOTICE.format(":", "Lesser ", ",", "3"), ["LGPL-3.0"]),
        (NOTICE.format(";", "Lesser ", ";", "2.1"), ["LGPL-2.1"]),
        (NOTICE.format(":", "Affero ", ",", "3"), ["AGPL-3.0"]),
        (bsd2, ["BSD-2-Clause"]),
        (bsd2.replace("Redistributions of", "1. Redistributions of").replace("Redistributions in", "2. Redistributions in"), ["BSD-2-Clause"]),
        (bsd3, ["BSD-3-Clause"]),
        (bsd3.replace("the copyright holder nor", "Example Corporation nor"), ["BSD-3-Clause"]),
        (bsd3.replace("Neither", "All advertising materials must say so. Neither"), []),
        (BODIES["ISC"][0], ["ISC"]), (BODIES["0BSD"][0], ["0BSD"]),
        ("Licensed under CC BY 4.0.", ["CC-BY-4.0"]), ("Licensed under CC BY-NC-SA 4.0.", ["CC-BY-NC-SA-4.0"]),
        ("Licensed under CC BY-NC 3.0.", []),
    ]
    found = names(scan(spark, [(i, text, "x", 0) for i, (text, _) in enumerate(cases)]))
    assert {i: found.get(i, []) for i in range(len(cases))} == {i: want for i, (_, want) in enumerate(cases)}


def test_every_template_finds_itself(spark):
    rows = [(i, "Before it. " + body + " After it.", name, 0)
            for i, (name, body) in enumerate((n, b) for n, bodies in BODIES.items() for b in bodies)]
    found = scan(spark, rows)
    assert names(found) == {r[0]: [r[2]] for r in rows}
    assert all(r["containment"] == 1 for r in found)


def test_every_place_is_reported(spark):
    three, two = NOTICE.format(":", "", ",", "3"), NOTICE.format(";", "", ";", "2").replace("you can", "you may")
    short = "Released under the MIT License."
    rows = [(1, f"{three} {two}", None, 1), (2, f"{three} {three} {three}", None, 2), (2, f"{three} {three} {three}", None, 2),
            (3, f"{short} {short} other words {short}", None, 3), (None, short, None, 4), (4, None, None, 5), (5, "", None, 6)]
    found = scan(spark, rows)
    assert names(found) == {1: ["GPL-3.0", "GPL-2.0"], 2: ["GPL-3.0"] * 6, 3: ["MIT"] * 3, None: ["MIT"]}
    texts = {r[0]: r[1] for r in rows}
    for r in found:
        said = texts[r["doc_id"]].encode()[r["begin"]:r["end"]].decode()
        assert said in (three.rstrip("."), two.rstrip("."), short.rstrip("."))


@pytest.mark.parametrize("shift", [-700, -300, -40, 0, 20])
def test_a_notice_across_the_cut_of_a_long_text(spark, shift):
    body = BODIES["BSD-3-Clause"][0]
    before = "filler " * ((1 << 20) // 7) + "x" * 30
    text = before[:(1 << 20) + shift] + " " + body + " filler" * 300_000
    found = scan(spark, [(1, text, None, 0)])
    assert [(r["license"], r["containment"]) for r in found] == [("BSD-3-Clause", 1.0)]
    assert text.encode()[found[0]["begin"]:found[0]["end"]].decode() == body.rstrip(".")


def test_containment_as_by_brute_force(spark):
    draw = random.Random(11)
    vocabulary = sorted({w for bodies in BODIES.values() for b in bodies for w in b.split()})
    plain = {n: b for n, b in BODIES.items() if n in ("Apache-2.0", "MIT", "MPL-2.0", "Unlicense")}
    rows = []
    for i in range(60):
        body = draw.choice(draw.choice(list(plain.values()))).split()
        for _ in range(draw.randint(0, max(1, len(body) // 12))):
            at = draw.randrange(len(body))
            body[at:at + 1] = draw.choice([[], [draw.choice(vocabulary)], [body[at], "extra"]])
        around = [draw.choice(vocabulary) for _ in range(40)]
        rows.append((i, " ".join(around[:20] + body + around[20:]), None, 0))
    templates = {f"{n} {i}": [b] for n, bodies in plain.items() for i, b in enumerate(bodies)}
    for name, (body,) in templates.items():  # one template at a time: no rivals
        got = {r["doc_id"]: r["containment"] for r in scan(spark, rows, templates={name: [body]}, absent={})}
        want = {i: share for i, text, *_ in rows if (share := brute(text, body)) >= licenses.CONTAINED}
        assert got.keys() == want.keys()
        assert all(got[i] == pytest.approx(want[i], abs=0.1) and got[i] <= want[i] for i in got)
