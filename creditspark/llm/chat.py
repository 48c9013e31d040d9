"""Chat formatting in windows of a token budget.

Turns of a conversation are placed by prefix sums of their tokens. Every stretch of ``new_tokens`` tokens is one window
of whole turns; a turn that crosses the end of a stretch gets a window of its own, so no window holds more new
tokens unless a single turn does. Each window repeats the system turn (if the conversation opens with one) and the
turns just before it, as far as they fit ``history_tokens``. Repeated turns carry no loss; of the new ones, the
assistant's texts do. So every assistant text is a target exactly once.

A turn is written as ``<|im_start|>role``, line end, text, ``<|im_end|>``, line end. In texts a backslash is doubled and
``<|`` becomes ``<\\|``, so no text can forge a mark and reading back is exact; roles are percent-encoded.

Prefix sums run over ranges of turns and windows are joined by number, so one conversation may hold much of the table.
Null texts and roles count as empty, a null conversation id is a conversation of its own, turns of equal number
follow by role and text, and repeated rows are turns of their own. An empty table gives no windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditspark.operators.ranks import running_totals
from creditspark.session import materialize

NEW_TOKENS = 1024
HISTORY_TOKENS = 512
MARK_TOKENS = 4
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_\x09-\x0D ]"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def token_count(text: Column) -> Column:
    """Words and signs, and the marks of a turn."""
    return F.regexp_count(text, F.lit(TOKEN)).cast("long") + MARK_TOKENS


def place_turns(turns: DataFrame, new_tokens: int, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns with ``start`` and ``end`` (tokens before and after, the opening system turn left out), ``system`` and ``span``."""
    known = turns.select(
        F.coalesce(F.concat(F.lit("id "), F.col(conv).cast("string")), F.lit("null")).alias("key"),
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    known = known.withColumn("tokens", token_count(F.col("text")))
    summed = running_totals(known, ["turn", "role", "text", "row"], ["tokens"], ["key"])
    opening = (F.col("before_tokens") == 0) & (F.col("role") == "system")
    first = materialize(summed.withColumn("system", opening))
    heads = first.filter("system").select("key", F.col("tokens").alias("head_tokens"))
    # the other side has one row per conversation; adaptive execution splits a long conversation
    placed = first.join(heads, "key", "left").withColumn(
        "start", F.when(F.col("system"), 0).otherwise(F.col("before_tokens") - F.coalesce("head_tokens", F.lit(0))))
    placed = placed.withColumn("end", F.col("start") + F.when(F.col("system"), 0).otherwise(F.col("tokens")))
    slot = F.floor(F.col("start") / new_tokens)
    crossing = (F.col("end") > (slot + 1) * new_tokens) & (F.col("start") > slot * new_tokens)
    return placed.select("key", "conv", "turn", "role", "text", "row", "system", "tokens", "start", "end",
                         (slot * 2 + crossing.cast("long")).alias("span"))


def chat_windows(turns: DataFrame, new_tokens: int = NEW_TOKENS, history_tokens: int = HISTORY_TOKENS, conv: str = "conv_id",
                 turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per window: conversation, window (in order), text, tokens, ``new_from`` and ``loss``.

    Turns of the window from ``new_from`` (counted from 0) on are new in it; ``loss`` lists the code points
    [begin, end) of ``text`` that are targets.
    """
    placed = materialize(place_turns(turns, new_tokens, conv, turn, role, text))
    body = ["key", "conv", "turn", "role", "text", "row", "tokens"]
    spans = placed.groupBy("key", "span").agg(F.min("start").alias("from"), F.max(F.col("system").cast("int")).alias("opens"))
    new = placed.select(*body, "span", F.when(F.col("system"), 0).otherwise(2).alias("part"), "start")
    near = placed.filter(~F.col("system") & (F.col("tokens") <= history_tokens)).select(
        *body, "start", "end", F.explode(F.sequence(
            F.floor(F.col("end") / new_tokens) * 2, F.floor((F.col("start") + history_tokens) / new_tokens) * 2 + 1)).alias("span"))
    history = near.join(spans, ["key", "span"]).filter(
        (F.col("from") >= F.col("end")) & (F.col("from") <= F.col("start") + history_tokens)).select(
        *body, "span", F.lit(1).alias("part"), "start")
    heads = placed.filter("system").select(*body)
    repeated = spans.filter("opens = 0").join(heads, "key").select(*body, "span", F.lit(0).alias("part"), F.lit(0).cast("long").alias("start"))
    again = F.lit(True)
    rows = (new.withColumn("again", ~again).unionByName(history.withColumn("again", again))
            .unionByName(repeated.withColumn("again", again)))

    head = F.concat(F.lit(OPEN), F.url_encode("role"), F.lit("\n"))
    rows = rows.withColumn("safe", escape(F.col("text"))).withColumn("head", head)
    rows = rows.withColumn("line", F.concat("head", "safe", F.lit(CLOSE)))
    # a window holds few turns: its budget bounds them
    inside = Window.partitionBy("key", "span").orderBy("part", "start", "turn", "role", "row")
    begin = F.coalesce(F.sum(F.length("line")).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("head")
    lines = rows.withColumn("begin", begin).withColumn("place", F.row_number().over(inside))
    target = ~F.col("again") & (F.col("role") == "assistant")
    grouped = lines.groupBy("key", "span").agg(
        F.first("conv").alias("conv"), F.sum("tokens").alias("tokens"), F.sum(F.col("again").cast("int")).alias("new_from"),
        F.sort_array(F.collect_list(F.struct("place", "line"))).alias("lines"),
        F.sort_array(F.collect_list(F.when(target, F.struct(
            F.col("begin"), (F.col("begin") + F.length("safe")).alias("end"))))).alias("loss"))
    return grouped.select(F.col("conv").alias(conv), "key", F.col("span").alias("window"),
                          F.array_join(F.col("lines.line"), "").alias("text"), "tokens", "new_from", "loss")


def read_back(windows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per window, what its text says: ``turns`` (role, text) that are new in it, and ``targets``, texts under the loss."""
    pattern = r"(?s)<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n"
    roles, texts = (F.regexp_extract_all("text", F.lit(pattern), F.lit(g)) for g in (1, 2))
    turns = F.transform(F.arrays_zip(roles.alias("role"), texts.alias("text")), lambda t: F.struct(
        F.url_decode(t["role"]).alias("role"), unescape(t["text"]).alias("text")))
    targets = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["begin"].cast("int") + 1, (s["end"] - s["begin"]).cast("int"))))
    found = windows.select(conv, "key", "window", F.length("text").alias("chars"), "new_from", turns.alias("turns"), targets.alias("targets"))
    return found.withColumn("turns", F.slice("turns", F.col("new_from").cast("int") + 1, F.size("turns")))


def digests(windows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Counts and digests of whole conversations, from the formatted windows alone.

    A digest of a conversation needs its text in one row; the windows themselves never do.
    """
    parts = read_back(windows, conv).select(
        conv, "key", "window", "chars", F.size("turns").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join("targets", "").alias("learnt"))
    whole = parts.groupBy("key").agg(
        F.first(conv).alias(conv), F.sum("n").cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"),
        F.sum(F.length("learnt")).cast("long").alias("loss_chars"),
        F.sort_array(F.collect_list(F.struct("window", "said", "learnt"))).alias("parts"))
    return whole.select(
        conv, "n_turns", F.sha2(F.array_join("parts.said", ""), 256).alias("turns_sha256"), "loss_chars",
        F.sha2(F.array_join("parts.learnt", ""), 256).alias("loss_sha256"), "formatted_chars")
