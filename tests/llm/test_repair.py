"""Repaired conversations against brute force: every edit string, many short conversations, segments, and odd rows."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from creditspark.llm import repair
from creditspark.llm.queries import damaged

SCHEMA = "conv_id long, turn long, role string, text string, cost long, edit string"
SPACES = " \t\n\x0b\x0c\r"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def _table(codes, state, ends):
    """Best (cost, letters, last state) by a plain table over rows and states."""
    def inserted(found):
        out = dict(found)
        for _ in range(3):
            for q, (cost, letters) in list(out.items()):
                to = "a" if q == "u" else "u"
                out[to] = min(out.get(to, (1 << 60, "")), (cost + 3, letters + "I"))
        return out

    now = {state: (0, "")}
    for initial, fault in codes:
        then = {}
        for q, (cost, letters) in inserted(now).items():
            options = [(q, cost + 4, "D")]
            if fault != "x":
                more = 3 if fault else 0
                options.append(("a" if q == "u" else "u", cost + 3 + more, "R"))
                if (q, initial) in NEXT:
                    options.append((NEXT[q, initial], cost + more, "K"))
            for to, price, letter in options:
                then[to] = min(then.get(to, (1 << 60, "")), (price, letters + letter))
        now = then
    names = ["", "s", "u", "a"]
    return min((cost + ends[names.index(q)], letters, names.index(q)) for q, (cost, letters) in inserted(now).items())


def test_search_equals_a_full_table():
    rng = np.random.default_rng(1)
    for n in [*range(7), 12, 30] * 60:
        codes = [(str(rng.choice(list("suax"))), str(rng.choice(["", "", "t", "x"]))) for _ in range(n)]
        cost, letters, last = _table(codes, "", repair.ENDS)
        assert repair.search(codes) == (cost, last, letters)
        assert len(letters.replace("I", "")) == n


def test_letters_are_the_least_of_all_cheapest():
    """All edit strings of short conversations, told apart by nothing but the rules."""
    def every(codes, left, state, cost, letters):
        if not codes and state in ("", "a"):
            yield cost, letters
        if left:
            yield from every(codes, left - 1, "a" if state == "u" else "u", cost + 3, letters + "I")
        if codes:
            (initial, fault), more = codes[0], 3 if codes[0][1] == "t" else 0
            yield from every(codes[1:], left, state, cost + 4, letters + "D")
            if fault != "x":
                yield from every(codes[1:], left, "a" if state == "u" else "u", cost + 3 + more, letters + "R")
                if (state, initial) in NEXT:
                    yield from every(codes[1:], left, NEXT[state, initial], cost + more, letters + "K")

    rng = np.random.default_rng(2)
    for _ in range(150):
        codes = [(str(rng.choice(list("suax"))), str(rng.choice(["", "t", "x"]))) for _ in range(rng.integers(0, 5))]
        cost, _, letters = repair.search(codes)
        assert (cost, letters) == min(every(codes, len(codes) + 2, "", 0, ""))


def _rows():
    rows = [(1, 0, "system", "be brief."), (1, 1, "user", "hi!"), (1, 2, "assistant", "hello."),
            (2, 0, "assistant", "first?"), (2, 5, "assistant", "second."), (2, 5, "assistant", "second."),
            (3, None, "user", "no turn."), (3, 4, "user", "cut of"), (3, None, None, None), (4, 0, "user", " \t\x0b"),
            (None, 1, "user", "lost one."), (None, 2, "assistant", "lost two."), (5, 1, "", "no role."), (5, 2, "élan", "odd."),
            (6, 0, "user", " ."), (6, 1, "assistant", "ends oddly. "), (7, 0, "user", "x" * 300_000 + "."),
            (8, -(1 << 62), "user", "far."), (8, 1 << 62, "assistant", "apart."), (9, 0, "user", "same."), (9, 1, "assistant", "ok."),
            (9, 2, "user", "same.")]
    rng = np.random.default_rng(3)
    for conv in range(20, 60):
        rows += [(conv, int(t), str(rng.choice(["user", "assistant", "system"], p=[.5, .4, .1])), str(rng.choice(["a.", "b", "", "c!"])) + f" {t % 9}.")
                 for t in range(rng.integers(1, 12))]
    rows += [(99, t, ("user", "assistant")[int(rng.integers(0, 2))], f"turn {t}" + "."[: t % 7]) for t in range(500)]
    return [(*r, 1, "e") for r in rows]


def _expected(rows):
    told = lambda x: " " if x is None else x
    by = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        role, text = told(role), told(text)
        digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
        by[conv].append((turn is not None, turn or 0, digest, role, text))
    out = {}
    for conv, said in by.items():
        said.sort()
        seen, codes, faults = set(), [], []
        for _, _, _, role, text in said:
            body = text.rstrip(SPACES)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            codes.append((role[:1], {"": "", "truncated": "t"}.get(fault, "x")))
        cost, audit, _ = _table(codes, "", repair.ENDS)
        state, at, lines = "", 0, []
        for letter in audit:
            asked = "a" if state == "u" else "u"
            full = {"u": "user", "a": "assistant"}[asked]
            if letter == "I":
                lines.append(full + ":")
                state = asked
                continue
            role, text = said[at][3:]
            if letter == "R":
                lines.append(f"{full}:{text}")
                state = asked
            if letter == "K":
                lines.append(f"{role}:{text}")
                state = role[:1]
            at += 1
        assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines))
        turns = [t for known, t, *_ in said if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a + b for (a, _), (b, _) in zip(codes, codes[1:])]
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, "\n".join(lines))
    return out


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3).cache()


@pytest.mark.parametrize("segment", [4096, 7, 1])
def test_repair_matches_brute_force(turns, segment):
    report, repaired = repair.repair(turns, segment=segment)
    expected = _expected(_rows())
    got = {r["conv_id"]: tuple(r)[1:] for r in report.collect()}
    assert {c: v[:-1] for c, v in expected.items()} == got
    sha = {r["conv_id"]: r["sha256"] for r in repair.turn_digests(repaired).collect()}
    assert sha == {c: hashlib.sha256(v[-1].encode()).hexdigest() for c, v in expected.items() if v[-1]}


def test_repaired_turns(turns):
    rows = repair.repair(turns.filter("conv_id = 2"))[1].orderBy("place", "part").collect()
    assert [(r["role"], r["text"], r["edit"]) for r in rows][:2] == [("user", "first?", "R"), ("assistant", "second.", "K")]


def test_no_turns(turns):
    report, repaired = repair.repair(turns.limit(0))
    assert report.count() == 0 and repair.turn_digests(repaired).count() == 0


def test_damage_keeps_rows_without_ids(turns):
    got = damaged(turns).collect()
    assert damaged(turns).columns == ["conv_id", "turn", "role", "text"]
    assert any(r["conv_id"] is None for r in got) and all(r["text"] is not None for r in got)
