"""Repair of conversation structure: the cheapest edits that make roles alternate as ``(s?(ua)+)?``.

A node of the edit lattice is (rows consumed, state), where the state is what the repaired conversation ends with:
nothing, a system, a user or an assistant turn. An edge keeps a row (K), gives it the role that the state asks for (R),
deletes it (D), or inserts an empty turn of the role that the state asks for (I). A bidirectional Dijkstra search runs
over the lattice: a forward heap grows from the start and a reverse heap from the ends until the sum of their tops
exceeds the best meeting, so that every crossing of equal cost is finished. Of the cheapest paths the one with the
least concatenated letters is then read off; it is found step by step, as letters decide the next node.

Conversations of any length are cut into segments of ``SEGMENT`` rows. A segment's cost from each state to each state
is one search with all four ends; the costs behind every segment follow from those of the segments after it (sixteen
numbers each), and the search of a segment starts from the state the one before it ended in and ends with the costs
behind it. So the search is the same for a conversation of three rows and of a third of the table.

Rows are taken by turn, null turns first; rows of one turn by SHA-256 of role and text, exact repeats next to each other.
A null role or text counts as one space, and rows without a conversation id form one conversation. An empty role
has no letter and never stays as it is. Columns other than the four named are not read, so their names cannot clash.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditspark.operators.ranks import running_totals
from creditspark.session import materialize

SEGMENT = 4096
NEVER = 1 << 60

# States, and the moves between them.
NONE, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
ENDS = (0, NEVER, NEVER, 0)
NEXT = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ASKED = {NONE: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
ROLES = {"u": "user", "a": "assistant"}

# Costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

#: Texts of white space alone, and texts that end with a mark before any white space.
BLANK = "^[\\x20\\x09-\\x0D]*\\z"
ENDED = "[.!?][\\x20\\x09-\\x0D]*\\z"
LEGAL = ("su", "ua", "au")


# ---- the lattice ---------------------------------------------------------------------------

@lru_cache(1 << 12)
def moves(code: tuple[str, str] | None, state: int) -> list[tuple[str, int, int, int]]:
    """(letter, rows consumed, next state, cost) of the edges that leave a node; ``code`` is the next row's, if any.

    A code is the initial of the role and the fault: "x" must go, "t" is truncated, "" is neither. Letters are in order.
    """
    out = [("I", 0, NEXT[state, ASKED[state]], INSERT)]
    if code:
        initial, fault = code
        out.insert(0, ("D", 1, state, DELETE))
        more = TRUNCATED if fault else 0
        if fault != "x" and (state, initial) in NEXT:
            out.append(("K", 1, NEXT[state, initial], more))
        if fault != "x":
            out.append(("R", 1, NEXT[state, ASKED[state]], REROLE + more))
    return out


@lru_cache(1 << 12)
def arrivals(code: tuple[str, str] | None, state: int) -> list[tuple[int, int, int]]:
    """(rows consumed, state before, cost) of the edges that enter a node; ``code`` is the row consumed last, if any."""
    return [(rows, before, cost) for before in STATES for _, rows, after, cost in moves(code, before) if after == state]


def search(codes: Sequence[tuple[str, str]], start: int = NONE, ends: Sequence[int] = ENDS) -> tuple[int, int, str]:
    """(cost, last state, letters) of the best path over ``codes`` from ``start``; ``ends`` is what each last state still costs."""
    n = len(codes)
    ahead: dict[tuple[int, int], int] = {(0, start): 0}
    behind: dict[tuple[int, int], int] = {(n, q): ends[q] for q in STATES if ends[q] < NEVER}
    forward = [(0, 0, start)]
    # an entry's second part is how deep its side has gone, negated, so that of equal costs the deeper node comes first
    reverse = [(cost, 0, q) for (_, q), cost in behind.items()]
    heapq.heapify(reverse)
    closed: tuple[set, set] = (set(), set())
    best = min((ahead[v] + behind[v] for v in ahead if v in behind), default=NEVER)
    while forward and reverse and forward[0][0] + reverse[0][0] <= best:
        if forward[0] <= reverse[0]:
            cost, above, q = heapq.heappop(forward)
            node = (-above, q)
            if node in closed[0]:
                continue
            closed[0].add(node)
            for _, rows, after, price in moves(codes[node[0]] if node[0] < n else None, q):
                _relax((node[0] + rows, after), cost + price, ahead, forward, -1, 0)
                best = min(best, ahead[node[0] + rows, after] + behind.get((node[0] + rows, after), NEVER))
        else:
            cost, left, q = heapq.heappop(reverse)
            node = (n + left, q)
            if node in closed[1]:
                continue
            closed[1].add(node)
            for rows, before, price in arrivals(codes[node[0] - 1] if node[0] else None, q):
                at = node[0] - rows
                _relax((at, before), cost + price, behind, reverse, 1, n)
                best = min(best, behind[at, before] + ahead.get((at, before), NEVER))
    if best >= NEVER:
        return NEVER, NONE, ""
    return (best, *_letters(codes, start, ends, best, ahead, behind))


def _relax(node: tuple[int, int], cost: int, known: dict, heap: list, sign: int, origin: int) -> None:
    if cost < known.get(node, NEVER):
        known[node] = cost
        heapq.heappush(heap, (cost, sign * (node[0] - origin), node[1]))


def _letters(codes, start, ends, best, ahead, behind) -> tuple[int, str]:
    """Last state and letters of the least path: back from the crossings to find the nodes it may use, then forwards."""
    n = len(codes)
    crossings = [v for v, cost in ahead.items() if cost + behind.get(v, NEVER) == best]
    useful, todo = set(crossings), list(crossings)
    while todo:
        at, q = todo.pop()
        for rows, before, price in arrivals(codes[at - 1] if at else None, q):
            node = (at - rows, before)
            if node not in useful and node in ahead and ahead[node] + price == ahead[at, q]:
                useful.add(node)
                todo.append(node)
    at, q, cost, letters = 0, start, 0, []
    while True:
        if at == n and cost + ends[q] == best:
            return q, "".join(letters)
        for letter, rows, after, price in moves(codes[at] if at < n else None, q):
            node, paid = (at + rows, after), cost + price
            on_front = node in useful and ahead.get(node) == paid
            if on_front or paid + behind.get(node, NEVER) == best:
                at, q, cost = at + rows, after, paid
                letters.append(letter)
                break


def edits(codes: Sequence[tuple[str, str]], state: int, letters: str) -> tuple[list[str], list[str], list[str], str]:
    """Per row: roles inserted before it, its edit, and its new initial if re-roled; then roles inserted at the end."""
    before, edit, role, open_turns = [], [], [], ""
    for letter in letters:
        if letter == "D":
            now = ""
        else:
            now = codes[len(edit)][0] if letter == "K" else ASKED[state]
            state = NEXT[state, now]
        if letter == "I":
            open_turns += now
            continue
        before.append(open_turns)
        edit.append(letter)
        role.append(now if letter == "R" else "")
        open_turns = ""
    return before, edit, role, open_turns


# ---- rows ----------------------------------------------------------------------------------

def initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def _placed(turns: DataFrame) -> DataFrame:
    """Every row stored with its place in its conversation, its fault and its letter; texts stay apart, by ``row``."""
    first = turns.groupBy("lost", "conv", "same").agg(F.min(F.struct("known", "turn", "row")).alias("first"))
    faults = turns.drop("text").join(first, ["lost", "conv", "same"])
    fault = (F.when(F.col("blank"), "blank").when(F.col("row") != F.col("first.row"), "duplicate")
             .when(F.col("cut"), "truncated").otherwise(""))
    kept = faults.select("lost", "conv", "known", "turn", "same", "row", "initial", fault.alias("fault"), F.lit(1).alias("one"))
    return running_totals(kept, ["known", "turn", "same", "row"], ["one"], ["lost", "conv"]).select(
        "lost", "conv", "known", "turn", "row", "initial", "fault", F.col("before_one").alias("place"), F.col("all_one").alias("rows"))


def _codes(rows: list[dict]) -> list[tuple[str, str]]:
    kinds = {"": "", "truncated": "t"}
    return [(r["initial"], kinds.get(r["fault"], "x")) for r in rows]


def _cut(placed: DataFrame, segment: int) -> DataFrame:
    """One row per segment: its rows' letters and faults in order, at most ``segment`` of them."""
    return placed.groupBy("lost", "conv", F.floor(F.col("place") / segment).alias("segment")).agg(
        F.sort_array(F.collect_list(F.struct("place", "row", "initial", "fault"))).alias("list"), F.max("rows").alias("rows"))


COSTS = "lost boolean, conv long, segment long, costs array<long>"
SOLVED = ("lost boolean, conv long, segment long, entry int, exit int, cost long, letters string, "
          "edits array<struct<row: long, before: string, edit: string, given: string>>, tail string")
SOLVED_ARROW = pa.schema([
    ("lost", pa.bool_()), ("conv", pa.int64()), ("segment", pa.int64()), ("entry", pa.int32()), ("exit", pa.int32()),
    ("cost", pa.int64()), ("letters", pa.string()),
    ("edits", pa.list_(pa.struct([("row", pa.int64()), ("before", pa.string()), ("edit", pa.string()), ("given", pa.string())]))),
    ("tail", pa.string())])


def _segment_costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each segment costs from every state to every state."""
    for batch in batches:
        out = []
        for rows in batch.column("list"):
            codes = _codes(rows.as_py())
            out.append([search(codes, q, [0 if e == to else NEVER for e in STATES])[0] for q in STATES for to in STATES])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("lost", "conv", "segment")),
                                          pa.array(out, pa.list_(pa.int64()))], ["lost", "conv", "segment", "costs"])


def _costs_behind(lists: pd.Series) -> list[list[int]]:
    """For segments in order, what each state at their end still costs."""
    behind, out = list(ENDS), []
    for costs in reversed(lists.tolist()):
        out.append(behind)
        behind = [min(NEVER, min(costs[4 * q + e] + behind[e] for e in STATES)) for q in STATES]
    return out[::-1]


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best path over every segment from each state it may begin in, with what lies behind it."""
    for batch in batches:
        out = []
        for found in batch.to_pylist():
            codes = _codes(found["list"])
            for entry in STATES if found["segment"] else [NONE]:
                cost, last, letters = search(codes, entry, found["behind"])
                if cost < NEVER:
                    before, edit, given, tail = edits(codes, entry, letters)
                    out.append({**{c: found[c] for c in ("lost", "conv", "segment")}, "entry": entry, "exit": last, "cost": cost,
                                "letters": letters, "tail": tail, "edits": [
                                    {"row": r["row"], "before": b, "edit": e, "given": g}
                                    for r, b, e, g in zip(found["list"], before, edit, given)]})
        yield pa.RecordBatch.from_pylist(out, SOLVED_ARROW)


def _chain(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """The entry state of every segment of one conversation: the state in which the one before it ended."""
    last = {(s, e): x for s, e, x in zip(frame["segment"], frame["entry"], frame["exit"])}
    state, out = NONE, []
    for segment in range(int(frame["segment"].max()) + 1):
        out.append((segment, state))
        state = last[segment, state]
    return pd.DataFrame({"lost": key[0], "conv": key[1], "segment": [s for s, _ in out], "entry": [e for _, e in out]})


def _paths(placed: DataFrame, segment: int) -> DataFrame:
    """The segments of every conversation with their part of its best path."""
    cut = materialize(_cut(placed, segment))
    keys = ["lost", "conv"]
    alone = cut.filter(F.col("rows") <= segment).withColumn("behind", F.array(*[F.lit(c).cast("long") for c in ENDS]))
    one = alone.select(*keys, "segment", "list", "behind").mapInArrow(_solve, SOLVED)
    many = cut.filter(F.col("rows") > segment)
    if many.isEmpty():
        return one.drop("exit", "entry")

    def behind(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("segment")
        return pd.DataFrame({"lost": key[0], "conv": key[1], "segment": frame["segment"],
                             "behind": _costs_behind(frame["costs"])})

    costs = many.select(*keys, "segment", "list").mapInArrow(_segment_costs, COSTS)
    after = costs.groupBy(*keys).applyInPandas(behind, "lost boolean, conv long, segment long, behind array<long>")
    solved = materialize(many.join(after, [*keys, "segment"]).select(*keys, "segment", "list", "behind").mapInArrow(_solve, SOLVED))
    chain = solved.select(*keys, "segment", "entry", "exit").groupBy(*keys).applyInPandas(
        _chain, "lost boolean, conv long, segment long, entry int")
    return one.unionByName(solved.join(chain, [*keys, "segment", "entry"])).drop("exit", "entry")


def repair(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """(report, repaired turns).

    The report has one row per conversation: ``key``, ``gaps`` in the turn numbers, rows that are ``blank``,
    ``duplicate`` or ``truncated`` (first fault only), neighbours with ``illegal`` roles, ``cost`` and ``audit``, the
    letters of the edits. The repaired turns have ``key``, ``place`` and ``part``, which order them, ``role``, ``text``
    and ``edit``.
    """
    told = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = materialize(turns.select(
        F.col(key).isNull().alias("lost"), F.coalesce(F.col(key), F.lit(0)).cast("long").alias("conv"),
        F.col(turn).isNotNull().alias("known"), F.coalesce(F.col(turn), F.lit(0)).cast("long").alias("turn"),
        told(role).alias("role"), told(text).alias("text"), F.monotonically_increasing_id().alias("row")))
    marked = rows.withColumns({
        "same": F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)),
        "initial": initial(F.col("role")), "blank": F.col("text").rlike(BLANK), "cut": ~F.col("text").rlike(ENDED)})
    placed = materialize(_placed(marked.drop("role")))
    paths = materialize(_paths(placed, segment))
    return _report(placed, paths, key, segment), _repaired(rows, placed, paths, key, segment)


def _report(placed: DataFrame, paths: DataFrame, key: str, segment: int) -> DataFrame:
    keys = ["lost", "conv"]
    count = lambda c: F.count(F.when(c, 1))
    turn = F.when(F.col("known"), F.col("turn"))
    wide = lambda c: c.cast("decimal(20,0)")
    # numbers further apart than 64 bits give a null
    gaps = (wide(F.max(turn)) - wide(F.min(turn)) + 1 - F.count_distinct(turn)).try_cast("long")
    facts = placed.groupBy(*keys).agg(
        F.when(F.count(turn) == 0, F.lit(0)).otherwise(gaps).alias("gaps"),
        *[count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    # neighbours inside a slice of rows, and across slices
    slices = placed.withColumn("slice", F.floor(F.col("place") / segment))
    inside = Window.partitionBy(*keys, "slice").orderBy("place")
    pairs = slices.withColumn("previous", F.lag("initial").over(inside))
    illegal = lambda a, b: ~F.concat(a, b).isin(*LEGAL)
    within = pairs.groupBy(*keys, "slice").agg(
        count(F.col("previous").isNotNull() & illegal(F.col("previous"), F.col("initial"))).alias("illegal"),
        F.min_by("initial", "place").alias("head"), F.max_by("initial", "place").alias("tail"))
    before = F.lag("tail").over(Window.partitionBy(*keys).orderBy("slice"))
    across = within.withColumn("previous", before).groupBy(*keys).agg(
        (F.sum("illegal") + count(F.col("previous").isNotNull() & illegal(F.col("previous"), F.col("head")))).alias("illegal"))
    # the first segment's cost holds what lies behind it
    found = paths.groupBy(*keys).agg(
        F.min_by("cost", "segment").alias("cost"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("segment", "letters"))), lambda s: s["letters"]), "").alias("audit"))
    return (facts.join(across, keys).join(found, keys)
            .select(F.when(~F.col("lost"), F.col("conv")).alias(key), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"))


def _repaired(rows: DataFrame, placed: DataFrame, paths: DataFrame, key: str, segment: int) -> DataFrame:
    named = lambda i: F.when(i == "u", ROLES["u"]).otherwise(ROLES["a"])
    blank = F.lit("")

    def inserted(turns: Column) -> Column:
        letters = F.filter(F.split(turns, ""), lambda i: i != "")
        return F.transform(letters, lambda i: F.struct(named(i).alias("role"), blank.alias("text"), F.lit("I").alias("edit")))

    role = F.when(F.col("edit") == "R", named(F.col("given"))).otherwise(F.col("role"))
    own = F.when(F.col("edit") != "D", F.array(F.struct(role.alias("role"), F.col("text"), F.col("edit"))))
    steps = paths.select(F.explode("edits").alias("e")).select("e.*")
    whole = placed.select("row", "place").join(steps, "row").join(rows.select("row", "lost", "conv", "role", "text"), "row")
    turns = whole.select("lost", "conv", "place", F.concat(inserted(F.col("before")), F.coalesce(own, F.array())).alias("turns"))
    last = F.col("segment") * segment + F.size("edits")
    tails = paths.filter("tail <> ''").select("lost", "conv", (last - F.lit(0.5)).alias("place"), inserted(F.col("tail")).alias("turns"))
    parts = turns.withColumn("place", F.col("place").cast("double")).unionByName(tails)
    return parts.select("lost", "conv", "place", F.posexplode("turns").alias("part", "turn")).select(
        F.when(~F.col("lost"), F.col("conv")).alias(key), "place", "part", "turn.*")


def turn_digests(repaired: DataFrame, key: str = "conv_id") -> DataFrame:
    """(``key``, ``sha256``) of every conversation's turns, as ``role:text`` joined by line feeds.

    A digest reads its conversation from front to back, so one task streams it; nothing but the digest's state is held.
    """
    order = [F.col(key).asc_nulls_first(), F.col("place"), F.col("part")]
    lines = repaired.repartition(F.col(key)).sortWithinPartitions(*order).select(
        F.col(key).alias("key"), F.encode(F.concat("role", F.lit(":"), "text"), "utf-8").alias("line"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done, line = [], batch.column("line")
            for at, found in enumerate(batch.column("key").to_pylist()):
                if state is None or found != now:
                    done += [(now, state.hexdigest())] if state else []
                    now, state = found, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(line[at].as_py())
            yield _digest_batch(done)
        yield _digest_batch([(now, state.hexdigest())] if state else [])

    return lines.mapInArrow(digest, "key long, sha256 string").withColumnRenamed("key", key)


def _digest_batch(done: list[tuple[int | None, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], ["key", "sha256"])
