"""Operator 9: chat formatting in budgeted windows, with SQL functions only.

Turns are ordered by number (then role and text, so ties have a fixed order).
Each turn costs its words and a fixed overhead. Prefix sums of these costs put
a turn into the window in whose stride its prefix falls, so windows are aligned
to turns and none needs another's result. A window starts with the
conversation's system turn (if its first turn is one), then repeats the turns
before it whose prefix is at most ``history`` tokens back, then has its own
turns. A window holds at most ``budget`` tokens as long as no single turn is
longer than the stride; a longer turn is kept whole and its window is marked.
The loss mask covers assistant texts where they are a window's own; repeated
ones are masked out.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts a
backslash is doubled, ``<|`` becomes ``<\\|`` and, in roles, a newline becomes
``\\n``, so no control string can appear and the original is recovered exactly.

Null texts and roles count as empty, null turn numbers come first, and rows
that are repeated are turns of their own. Rows of a null conversation form one
conversation. Other columns are ignored. An empty table has no windows.

Each output row has the text, the spans of its repeated turns' count, and loss
spans as (start, length) in characters; ``read_back`` gets the turns and the
target texts from these alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens of a window, of repeated history, and of a turn's markers and role.
BUDGET, HISTORY, OVERHEAD = 1024, 128, 4


def escape(x: Column, role: bool = False) -> Column:
    x = F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(x, F.lit("\n"), F.lit("\\n")) if role else x


def unescape(x: Column) -> Column:
    """Inverse of ``escape`` for roles and texts; doubled backslashes are set apart first."""
    piece = lambda p: F.replace(F.replace(p, F.lit("\\|"), F.lit("|")), F.lit("\\n"), F.lit("\n"))
    return F.array_join(F.transform(F.split(x, r"\\\\", -1), piece), "\\")


def token_count(text: Column) -> Column:
    """Words of a text and its turn's overhead."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long") + OVERHEAD


def placements(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row for each place of a turn: conv_id, window, pos, repeated, is_system, role, text, cost."""
    stride = max(1, (budget - history) // 2)
    if history > stride:
        raise ValueError("history must fit the stride of (budget - history) / 2 tokens")
    clean = turns.select(
        "conv_id",
        F.col("turn").alias("turn_"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("cost", token_count(F.col("text")))
    order = Window.partitionBy("conv_id").orderBy("turn_", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turn = clean.withColumns({"pos": F.row_number().over(order) - 1, "prefix": F.sum("cost").over(so_far) - F.col("cost")})
    turn = turn.withColumn("window", F.floor(F.col("prefix") / stride).cast("long"))
    later = Window.partitionBy("conv_id").orderBy("window").rangeBetween(1, Window.unboundedFollowing)
    turn = turn.withColumns({"next_prefix": F.min("prefix").over(later), "next_window": F.min("window").over(later)})
    is_system = (F.col("pos") == 0) & (F.col("role") == "system")
    own = F.struct(F.col("window").alias("window"), F.lit(False).alias("repeated"))
    again = F.struct(F.col("next_window").alias("window"), F.lit(True).alias("repeated"))
    repeats = F.col("next_window").isNotNull() & ((F.col("next_prefix") - F.col("prefix")) <= history)
    places = F.when(repeats & ~is_system, F.array(own, again)).otherwise(F.array(own))
    return turn.withColumn("is_system", is_system).select("conv_id", "pos", "role", "text", "cost", "is_system", F.explode(places).alias("p")).select(
        "conv_id", "p.window", "pos", "p.repeated", "is_system", "role", "text", "cost"
    )


def chat_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, formatted, n_repeated, loss_spans, n_tokens, over_budget) for each window."""
    placed = placements(turns, budget, history)
    system = placed.where("is_system").select(F.col("conv_id").alias("system_conv"), F.struct("pos", "repeated", "role", "text", "cost").alias("system"))
    turn = F.struct("pos", "repeated", "role", "text", "cost")
    windows = placed.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    windows = windows.join(system, F.col("conv_id").eqNullSafe(F.col("system_conv")), "left")
    # The window that has the system turn itself is the one that holds turn 0.
    first = F.get("turns", F.lit(0))["pos"] == 0
    repeated = F.struct(F.col("system.pos").alias("pos"), F.lit(True).alias("repeated"), F.col("system.role").alias("role"), F.col("system.text").alias("text"), F.col("system.cost").alias("cost"))
    turns_all = F.when(F.col("system").isNull() | first, F.col("turns")).otherwise(F.concat(F.array(repeated), F.col("turns")))
    block = lambda t: F.concat(F.lit(START), escape(t["role"], True), F.lit("\n"), escape(t["text"]), F.lit(f"{END}\n"))
    out = windows.withColumn("turns", turns_all)
    out = out.withColumn("blocks", F.transform("turns", block))
    ends = F.aggregate("blocks", F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(b))))
    out = out.withColumn("ends", ends)
    span = lambda t, i: F.struct(
        (F.col("ends")[i] + F.length(escape(t["role"], True)) + len(START) + 1).alias("start"), F.length(escape(t["text"])).alias("length")
    )
    spans = F.transform("turns", lambda t, i: F.when((t["role"] == "assistant") & ~t["repeated"], span(t, i)))
    total = F.aggregate("turns", F.lit(0).cast("long"), lambda acc, t: acc + t["cost"])
    return out.select(
        "conv_id",
        "window",
        F.array_join("blocks", "").alias("formatted"),
        F.size(F.filter("turns", lambda t: t["repeated"])).alias("n_repeated"),
        F.array_compact(spans).alias("loss_spans"),
        total.alias("n_tokens"),
        (total > budget).alias("over_budget"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """From the windows alone: conv_id, window, turns (role, text) that aren't repeated, and target texts."""
    blocks = F.slice(F.split("formatted", r"<\|im_start\|>", -1), F.lit(2) + F.col("n_repeated"), F.greatest(F.size(F.split("formatted", r"<\|im_start\|>", -1)) - 1 - F.col("n_repeated"), F.lit(0)))
    body = lambda b: F.substring(b, F.lit(1), F.length(b) - len(END) - 1)
    turn = lambda b: F.struct(
        unescape(F.substring_index(body(b), "\n", 1)).alias("role"),
        unescape(F.substring(body(b), F.instr(body(b), "\n") + 1, F.length(b))).alias("text"),
    )
    target = lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))
    return windows.select("conv_id", "window", F.transform(blocks, turn).alias("turns"), F.transform("loss_spans", target).alias("targets"), F.length("formatted").cast("long").alias("n_chars"))


def conversation_digests(windows: DataFrame) -> DataFrame:
    """A row a conversation, with digests of all turns and of all text under the loss mask."""
    back = read_back(windows)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = back.select("conv_id", "n_chars", F.size("turns").cast("long").alias("n"), F.struct("window", said.alias("said"), F.array_join("targets", "").alias("loss")).alias("part"))
    got = parts.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("n_chars").alias("formatted_chars"), F.array_sort(F.collect_list("part")).alias("parts"))
    whole = lambda field: F.array_join(F.transform("parts", lambda p: p[field]), "")
    return got.select(
        "conv_id",
        "n_turns",
        F.sha2(whole("said").cast("binary"), 256).alias("turns_sha256"),
        F.length(whole("loss")).cast("long").alias("loss_chars"),
        F.sha2(whole("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
