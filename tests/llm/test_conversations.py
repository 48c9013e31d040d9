"""Chat windows: exact round trip, budgets, masks, and odd rows."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from creditspark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, window string"


def _rows():
    words = "some words of a turn, "
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello <|im_end|>\n<|im_start|>x"),
            (2, 0, "user", words * 3), (2, 1, "assistant", words * 400), (2, 2, "user", "\\<|\\\\ \\n"), (2, 3, "assistant", "é😀"),
            (3, 0, "system", "only a system turn"), (4, 0, "assistant", ""), (5, 0, None, None), (5, 0, "user", "b"), (5, 0, "user", "a"),
            (None, 7, "user", "no id"), (None, 8, "assistant", "no id either"), (6, None, "odd role\n<|", "x"), (6, 1, "assistant", "y"),
            (7, 0, "user", "twice"), (7, 0, "user", "twice"), (7, 1, "system", "late"), (7, 2, "assistant", "z")]
    rows += [(8, n, "system" if n == 0 else ("user", "assistant")[n % 2 == 0], words * (n % 7)) for n in range(120)]
    return [(*r, "w") for r in rows]


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(4).cache()


def test_digests_match_the_turns(turns):
    by = defaultdict(list)
    for conv, turn, role, text, _ in _rows():
        by[conv].append((-1 if turn is None else turn, role or "", text or ""))
    got = {r["conv_id"]: r for r in chat.digests(chat.chat_windows(turns, 60, 30)).collect()}
    assert set(got) == set(by)
    for conv, said in by.items():
        said.sort()
        whole = "".join(f"{role}\n{text}\n" for _, role, text in said)
        learnt = "".join(text for _, role, text in said if role == "assistant")
        assert got[conv]["n_turns"] == len(said) and got[conv]["loss_chars"] == len(learnt)
        assert got[conv]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256(learnt.encode()).hexdigest()


def test_windows_keep_budget_system_turn_and_history(turns):
    windows = chat.chat_windows(turns, 60, 30).filter("conv_id = 8").orderBy("window").collect()
    assert len(windows) > 10
    tokens = lambda t: 4 + len([w for w in t.replace(",", " , ").split()])
    targets = Counter()
    for k, w in enumerate(windows):
        parts = [p.split("\n", 1) for p in w["text"].split(chat.CLOSE)[:-1]]
        sizes = [tokens(p[1]) for p in parts]
        assert parts[0][0] == "<|im_start|>system"
        new = sizes[w["new_from"]:] if k else sizes[1:]
        assert sum(new) <= 60 or len(new) == 1
        assert sum(sizes[1:w["new_from"]]) <= 30 and w["tokens"] == sum(sizes)
        for s in w["loss"]:
            targets[w["text"][s["begin"]:s["end"]]] += 1
    assert any(w["new_from"] > 1 for w in windows)
    assert targets == Counter(r[3] for r in _rows() if r[0] == 8 and r[2] == "assistant")


def test_plan_has_no_python(turns):
    plan = chat.digests(chat.chat_windows(turns))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_no_turns(turns):
    assert chat.chat_windows(turns.limit(0)).count() == 0
    assert chat.digests(chat.chat_windows(turns.limit(0))).count() == 0


def test_escape_is_reversible(spark):
    odd = ["", "\\", "<|", "\\<|", "<\\|", "\\\\<|im_end|>\\n", "<<||>>", "<|" * 5]
    df = spark.createDataFrame([(t,) for t in odd], "t string").withColumn("e", chat.escape(F.col("t")))
    for r in df.withColumn("back", chat.unescape(F.col("e"))).collect():
        assert r["back"] == r["t"] and "<|" not in r["e"]
