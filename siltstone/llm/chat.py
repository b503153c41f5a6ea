"""Chat formatting in budgeted windows: prefix sums of turn tokens choose turn-aligned spans. Native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, let

#: Fixed template. The escape character and the mark opener can't stand unescaped in a text.
TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
#: Tokens (words, one more for a turn's marks) of a window, of the turns repeated from the window before, and of new turns at least.
BUDGET, HISTORY, ROOM = 512, 128, 128
#: Turns that are dealt into spans in one task, and blocks whose tables of carried tokens are put together in one.
BLOCK, TABLES = 1024, 256


def escape(text: Column) -> Column:
    """Doubles backslashes, then parts ``<|`` by one; so ``<|`` stands for marks alone."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _placed(chats: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows (conv, role, text, tokens, row) with their place in the conversation, by turn number, role and text.

    Rows are sorted over all tasks and counted by conversation and task, so that neither a conversation nor a turn number with a large
    part of all rows is one task's.
    """

    def whole(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))

    own = chats.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), whole(role).alias("role"), whole(text).alias("text"))
    own = own.withColumn("tokens", F.regexp_count("text", F.lit("\\S+")).cast("long") + 1)
    spread = own.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 64))
    rows = cut(spread.sortWithinPartitions("conv", "turn", "role", "text").drop("turn")).withColumn("row", F.monotonically_increasing_id())
    task = F.shiftright("row", 33)
    runs = rows.groupBy("conv", task.alias("task")).agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("conv").alias("c"), F.col("task").alias("t"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    joined = rows.withColumn("task", task).join(runs, F.col("conv").eqNullSafe(F.col("c")) & (F.col("task") == F.col("t")))
    return joined.select("conv", "role", "text", "tokens", "row", (F.col("row") + F.col("shift")).alias("place"))


def _next_sum(sum_: Column, x: Column, room: Column) -> Column:
    """The tokens of the open span after a turn of ``x`` tokens; 0 if there is no span yet."""
    return F.when((sum_ == 0) | (sum_ + x <= room), sum_ + x).otherwise(x)


def spans_of(tokens: Column, room: Column, carried: Column) -> Column:
    """Of each turn the number of its span: a span takes turns while they fit into ``room`` tokens, one turn at least.

    ``carried`` tokens are in span 0, which was begun before these turns; with none of them span 0 begins here.
    """
    start = F.struct(F.lit(0).alias("span"), carried.alias("sum"), F.array().cast("array<int>").alias("spans"))

    def step(s: Column, x: Column) -> Column:
        fits = (s["sum"] == 0) | (s["sum"] + x <= room)
        span = F.when(fits, s["span"]).otherwise(s["span"] + 1)
        return F.struct(span.alias("span"), _next_sum(s["sum"], x, room).alias("sum"), F.array_append(s["spans"], span).alias("spans"))

    return F.aggregate(tokens, start, step, lambda s: s["spans"])


def _carried(blocks: DataFrame) -> DataFrame:
    """(conv, block, carried): of each block the tokens that are in the open span when it begins.

    A block's table says, for each number of carried tokens, how many it carries on; more than the room are as good as one more than it.
    Tables of neighbouring blocks make one, in a tree, so that no task has all of a conversation's.
    """
    more = F.col("room") + 1
    turns = F.transform("turns", lambda x: x["tokens"])
    table = F.transform(F.sequence(F.lit(0).cast("long"), more), lambda c: F.aggregate(turns, c, lambda s, x: F.least(_next_sum(s, x, F.col("room")), more)))
    levels = [cut(blocks.select("conv", "block", table.alias("table")))]
    while (levels[-1].agg(F.max("block")).first()[0] or 0) >= TABLES:
        groups = levels[-1].groupBy("conv", F.floor(F.col("block") / TABLES).alias("block")).agg(F.array_sort(F.collect_list(F.struct("block", "table"))).alias("t"))
        first = F.col("t")[0]["table"]
        put = F.transform(F.sequence(F.lit(0), F.size(first) - 1), lambda c: F.aggregate("t", c.cast("long"), lambda s, x: F.get(x["table"], s.cast("int"))))
        levels.append(cut(groups.select("conv", "block", put.alias("table"))))
    # down again: of each group what is carried into it, then into each of its members
    known = levels[-1].groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "table"))).alias("t")).select("conv", "t", F.lit(0).cast("long").alias("carried"))
    for level in [*reversed(levels[:-1]), None]:
        start = F.struct(F.col("carried").alias("sum"), F.array().cast("array<bigint>").alias("sums"))
        sums = F.aggregate("t", start, lambda s, x: F.struct(F.get(x["table"], s["sum"].cast("int")).alias("sum"), F.array_append(s["sums"], s["sum"]).alias("sums")), lambda s: s["sums"])
        each = known.select("conv", F.explode(F.arrays_zip(F.transform("t", lambda x: x["block"]).alias("block"), sums.alias("carried"))).alias("x"))
        each = each.select("conv", F.col("x.block").alias("block"), F.col("x.carried").alias("carried"))
        if level is not None:
            groups = level.groupBy("conv", F.floor(F.col("block") / TABLES).alias("group")).agg(F.array_sort(F.collect_list(F.struct("block", "table"))).alias("t"))
            into = each.select(F.col("conv").alias("c"), F.col("block").alias("g"), "carried")
            known = groups.join(into, F.col("conv").eqNullSafe(F.col("c")) & (F.col("group") == F.col("g"))).select("conv", "t", "carried")
    return each


def _windows(placed: DataFrame, budget: int, history: int) -> DataFrame:
    """(conv, place, start, window, next_start, last, system): of each turn the tokens before it, its window, where the next window's span
    begins, the conversation's last window, and the tokens of its system turn (0 without one).

    Blocks of BLOCK turns are dealt into spans in a task each, from what the blocks before carry into them; prefix sums over blocks number
    spans and tokens through. Blocks are a matter of work alone: they move no span.
    """
    own = placed.select("conv", "place", "tokens", F.floor(F.col("place") / BLOCK).alias("block"), F.when((F.col("place") == 0) & (F.col("role") == "system"), F.col("tokens")).alias("s"))
    told = own.groupBy("conv").agg(F.coalesce(F.max("s"), F.lit(0)).alias("system")).select(F.col("conv").alias("c"), "system")
    blocks = own.groupBy("conv", "block").agg(F.array_sort(F.collect_list(F.struct("place", "tokens"))).alias("turns"))
    blocks = blocks.join(told, blocks["conv"].eqNullSafe(told["c"]))
    room = F.greatest(F.lit(budget - history) - F.col("system"), F.lit(ROOM))
    blocks = blocks.withColumn("room", room)
    carried = F.lit(0).cast("long")
    if (placed.agg(F.max("place")).first()[0] or 0) >= BLOCK:
        blocks = cut(blocks)
        long = blocks.where("block > 0").select(F.col("conv").alias("many")).distinct()
        into = _carried(blocks.join(long, F.col("conv").eqNullSafe(F.col("many")), "left_semi")).select(F.col("conv").alias("v"), F.col("block").alias("b"), "carried")
        blocks = blocks.join(into, F.col("conv").eqNullSafe(F.col("v")) & (F.col("block") == F.col("b")), "left").drop("v", "b")
        carried = F.coalesce("carried", carried)
    blocks = blocks.withColumn("span", spans_of(F.transform("turns", lambda x: x["tokens"]), F.col("room"), carried))
    sums = F.aggregate("turns", F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    blocks = blocks.select("conv", "block", "turns", "system", "span", sums.alias("t"), F.element_at("span", -1).alias("n"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("conv")
    blocks = blocks.select(
        "conv", "block", "turns", "system", "span", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), (F.sum("n").over(every) + 1).alias("last")
    )
    each = blocks.select("conv", "system", "t0", "n0", "last", F.explode(F.arrays_zip("turns", "span")).alias("x"), "block")
    each = each.select("conv", "block", "system", "t0", (F.col("n0") + F.col("x.span") + 1).cast("long").alias("window"), "last", "x.turns.place", "x.turns.tokens")
    inside = Window.partitionBy("conv", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("start", F.col("t0") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    starts = each.groupBy("conv", "window").agg(F.min("start").alias("next_start"))
    starts = starts.select(F.col("conv").alias("c"), (F.col("window") - 1).alias("w"), "next_start")
    found = each.join(starts, each["conv"].eqNullSafe(starts["c"]) & (each["window"] == starts["w"]), "left")
    return found.select("conv", "place", "start", "window", "next_start", "last", "system")


def format_windows(chats: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: its conversation, number, formatted text, loss spans (from, length), and what it holds.

    A window shows the conversation's system turn (its first turn, if a system's), then turns of the window before that lie within
    ``history`` tokens of the span, then its own span of whole turns, ``budget`` tokens at most in all. The span has what system turn
    and history leave of the budget, ROOM tokens at least, and takes turns while they fit. So only a turn that is longer than its span's room, or a system turn that leaves less than ROOM, goes over the budget. Loss spans
    cover the assistant texts of the span alone; repeated ones are masked. ``n_repeated`` turns come before the span's own.

    Turns go by number, role and text; repeated rows are turns of their own; null texts and roles count as empty, a null
    conversation is one conversation, null turn numbers come first. An empty table gives no windows. Other columns aren't read.
    """
    placed = _placed(chats, conv, turn, role, text)
    found = _windows(placed, budget, history).withColumnsRenamed({"conv": "c", "place": "p"})
    turns = placed.join(found, placed["conv"].eqNullSafe(found["c"]) & (placed["place"] == found["p"])).drop("c", "p", "row")
    system = (F.col("place") == 0) & (F.col("role") == "system")
    # kind 0 the system turn, 1 history, 2 the span's own
    near = F.col("next_start").isNotNull() & ~system & (F.col("next_start") - F.col("start") <= history)
    marks = F.array(F.struct(F.col("window").alias("w"), F.lit(2).alias("kind")), F.when(near, F.struct((F.col("window") + 1).alias("w"), F.lit(1).alias("kind"))))
    # the system turn is told once for each later window of its conversation
    later = F.transform(F.sequence(F.lit(2).cast("long"), F.col("last")), lambda w: F.struct(w.alias("w"), F.lit(0).alias("kind")))
    shows = F.when(system & (F.col("last") > 1), F.concat(marks, later)).otherwise(marks)
    shown = turns.select("conv", "role", "text", "tokens", "place", F.explode(F.filter(shows, lambda x: x.isNotNull())).alias("m"))

    shown = shown.withColumn("head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY))).withColumn("body", escape(F.col("text")))
    turn_ = F.struct("place", F.col("m.kind").alias("kind"), "head", "body", (F.col("role") == "assistant").alias("target"), "tokens")
    gathered = shown.groupBy("conv", F.col("m.w").alias("w")).agg(F.array_sort(F.collect_list(turn_)).alias("t"))
    full = F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    lengths = F.transform("t", lambda x: F.struct((F.length(x["head"])).alias("h"), F.length(x["body"]).alias("b"), ((x["kind"] == 2) & x["target"]).alias("loss")))
    return gathered.select(
        F.col("conv").alias(conv),
        F.col("w").alias("window"),
        full.alias("formatted"),
        _loss(lengths).alias("loss"),
        F.size(F.filter("t", lambda x: x["kind"] < 2)).alias("n_repeated"),
        F.size("t").alias("n_turns"),
        F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("tokens"),
    )


def _loss(lengths: Column) -> Column:
    """Spans (from, length) of the bodies under the loss: places by prefix sums over the turns' lengths."""
    from_long = F.lit(0).cast("long")

    def starts(ls: Column) -> Column:
        return F.transform(ls, lambda x, i: F.struct((F.aggregate(F.slice(ls, 1, i), from_long, lambda a, y: a + y["h"] + y["b"] + len(END)) + x["h"]).alias("from"), x["b"].cast("long").alias("length"), x["loss"].alias("loss")))

    return let(lengths, lambda ls: F.transform(F.filter(starts(ls), lambda x: x["loss"]), lambda x: F.struct(x["from"], x["length"])))


def read_back(windows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation its turns and loss texts in order, read from the formatted windows alone."""
    turns = F.transform(F.filter(F.split(F.col("formatted"), "<\\|turn\\|>"), lambda x: x != ""), lambda x: let(F.split(F.regexp_replace(x, "<\\|end\\|>$", ""), "<\\|text\\|>"), lambda y: F.struct(unescape(y[0]).alias("role"), unescape(y[1]).alias("text"))))
    own = let(turns, lambda t: F.slice(t, F.col("n_repeated") + 1, F.size(t)))
    loss = F.array_join(F.transform("loss", lambda x: unescape(F.substring(F.col("formatted"), (x["from"] + 1).cast("int"), x["length"].cast("int")))), "")
    read = windows.select(F.col(conv), "window", own.alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("chars"))
    whole = read.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct("window", "turns", "loss_text"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    return whole.select(F.col(conv), F.flatten(F.transform("w", lambda x: x["turns"])).alias("turns"), F.array_join(F.transform("w", lambda x: x["loss_text"]), "").alias("loss_text"), "formatted_chars")


def digests(windows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row per conversation, from its windows: turns, their digest, the loss text's length and digest, and characters of all windows.

    A digest is of one string, so a conversation's text stands in one row here (the windows themselves are bounded). A null
    conversation is a row; without windows there are no rows.
    """
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read_back(windows, conv).select(
        F.col(conv),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )
