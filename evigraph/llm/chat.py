"""Chat formatting: conversations cut into budgeted windows with a loss mask.

The budget of a window holds its system turn, its history and its new turns.  The conversation's system turn (its
first turn, if its role says so) is repeated at the start of every later window; one that alone takes more than
half of the budget is not.  A quarter of the budget is kept for history, and prefix sums of turn tokens place every
turn: a window's new turns start in the same stretch of half of what is left; a turn larger than that is a
window of its own.  Up to ``history`` turns before a window are repeated if they fit in the quarter and in what the
window's new turns leave.  So a window is over its budget only where one turn and the system turn alone are,
and turns are never cut.
Only the texts of new assistant turns are under the loss mask, so each counts once.

Template: ``<|turn|>role<|text|>text<|end|>`` per turn.  In roles and texts a backslash follows
every ``<``, ``[`` and backslash, so no control string of this or another template survives, and
taking it away again gives the text back.

Prefix sums run in cells of 1,024 turn numbers and over the cells, so a long
conversation is spread over tasks; a window's turns meet in one row, bounded by the budget.
Built-in functions only.  Defined results: null roles and texts count as empty; turns are ordered by turn
(null first), role and text; rows without a conversation id form one conversation; repeated rows are repeated turns; an
empty table gives no windows; other columns are not carried, as a window spans rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evigraph.llm.mixing import words
from evigraph.session import cut

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CELL, MARKS = 1024, 4


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def placed(df: DataFrame, conv: str, turn: str, role: str, text: str, budget: int) -> DataFrame:
    """Turns with their position, tokens before them and window number."""
    turns = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    turns = turns.withColumn("tokens", words(F.col("text")) + MARKS)
    first = turns.groupBy(F.col("conv").alias("of")).agg(F.min(F.struct("turn", "role", "text", "tokens")).alias("f"))
    heads = first.select("of", F.when((F.col("f.role") == "system") & (F.col("f.tokens") <= budget // 2), F.col("f.tokens")).otherwise(0).alias("system"))
    turns = turns.join(heads, F.col("conv").eqNullSafe(F.col("of"))).drop("of").withColumn("stretch", F.floor((budget - budget // 4 - F.col("system")) / 2))
    turns = turns.withColumn("big", (F.col("tokens") > F.col("stretch")).cast("int")).withColumn("cell", F.floor(F.col("turn") / CELL))
    order = Window.partitionBy("conv").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = turns.groupBy("conv", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"), F.sum("big").alias("b"))
    before = cells.select(F.col("conv").alias("c"), F.col("cell").alias("l"), *[F.coalesce(F.sum(x).over(order), F.lit(0)).alias(f"{x}0") for x in ("n", "t", "b")])
    inside = Window.partitionBy("conv", "cell").orderBy("turn", "role", "text")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = turns.select("*", F.row_number().over(inside).alias("n1"), F.sum("tokens").over(upto).alias("t1"), F.sum("big").over(upto).alias("b1"))
    joined = ranked.join(before, F.col("conv").eqNullSafe(F.col("c")) & F.col("cell").eqNullSafe(F.col("l")))
    start = F.col("t0") + F.col("t1") - F.col("tokens")
    return joined.select("conv", (F.col("n0") + F.col("n1")).alias("pos"), start.alias("start"), "role", "text", "tokens", "system",
                         (F.floor(start / F.col("stretch")) + 2 * (F.col("b0") + F.col("b1")) - F.col("big")).cast("long").alias("window"))


def formatted(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = 1024, history: int = 2) -> DataFrame:
    """One row per window: conversation, ``window`` (ascending), ``formatted``, ``loss`` (array<struct<start, end>> in code points) and ``repeats`` (turns at its start that earlier windows hold)."""
    turns = cut(placed(df, conv, turn, role, text, budget), "chat-turns")
    windows = turns.groupBy("conv", "window").agg(F.min("pos").alias("first"), F.min("start").alias("from"), F.sum("tokens").alias("own"), F.max("system").alias("head"))
    system = (F.col("pos") == 1) & (F.col("system") > 0)
    room = F.least(F.lit(budget // 4), budget - F.col("head") - F.col("own")).alias("room")
    later = windows.where("first > 1").select(F.col("conv").alias("c"), F.col("window").alias("w"), "first", "from", room)
    back = later.select("c", "w", "from", "room", F.explode(F.sequence(F.greatest(F.lit(1).cast("long"), F.col("first") - history), F.col("first") - 1)).alias("p"))
    kept = turns.where(~system).join(back, F.col("conv").eqNullSafe(F.col("c")) & (F.col("pos") == F.col("p"))).where(F.col("from") - F.col("start") <= F.col("room"))
    heads = turns.where(system).join(later.select("c", "w"), F.col("conv").eqNullSafe(F.col("c")))
    columns = lambda window, again: ["conv", F.col(window).alias("window"), "pos", "role", F.lit(again).alias("again"), escape(F.col("role")).alias("r"), escape(F.col("text")).alias("t")]
    every = turns.select(*columns("window", False)).union(kept.select(*columns("w", True))).union(heads.select(*columns("w", True)))
    rows = every.groupBy("conv", "window").agg(F.array_sort(F.collect_list(F.struct("pos", "again", "role", "r", "t"))).alias("turns"))
    lead = lambda x: F.concat(F.lit(TURN), x["r"], F.lit(TEXT))

    def masked(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(lead(x))
        end = start + F.length(x["t"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + len(END)).alias("at"), F.when(~x["again"] & (x["role"] == "assistant"), F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    none = F.struct(F.lit(0).alias("at"), F.from_json(F.lit("[]"), "array<struct<start: int, end: int>>").alias("out"))
    return rows.select(F.col("conv").alias(conv), "window", F.array_join(F.transform("turns", lambda x: F.concat(lead(x), x["t"], F.lit(END))), "").alias("formatted"),
                       F.aggregate("turns", none, masked, lambda acc: acc["out"]).alias("loss"), F.size(F.filter("turns", lambda x: x["again"])).alias("repeats"))


def read_turns(formatted: Column, repeats: Column) -> Column:
    """array<struct<role, text>> of the new turns of a window, from its string alone."""
    parts = F.split(formatted, r"<\|end\|>", -1)
    own = F.slice(parts, repeats + 1, F.greatest(F.size(parts) - 1 - repeats, F.lit(0)))
    halves = F.transform(own, lambda p: F.split(F.substr(p, F.lit(len(TURN) + 1)), r"<\|text\|>", -1))
    return F.transform(halves, lambda h: F.struct(unescape(F.element_at(h, 1)).alias("role"), unescape(F.element_at(h, 2)).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, joined."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
