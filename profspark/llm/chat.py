"""Chat formatting in windows of a token budget, with DataFrame functions only.

Prefix sums of the turns' tokens deal turns into spans: with `half` half the room of a window, a turn belongs to the
span number floor(tokens before it / half), and a turn of more than half to a span of its own. A span so holds at most
`half` tokens of turns that begin in it, and less than another half of the last one, without any step from turn to turn.
Prefix sums are taken in blocks of turn numbers and then over the blocks' totals, so that a very long conversation is
not one group. Each window shows the system turn, turns of the span before that fit the history budget, and its span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, HISTORY = 512, 128
#: Tokens that the template adds to a turn.
MARKS = 4
BLOCK_TURNS = 256
OPEN, CLOSE = "### ", "</turn>\n"
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


def tokens(text: Column) -> Column:
    """Runs of letters and digits, and other single characters that are not white space."""
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def escaped(text: Column) -> Column:
    """Text without any character that begins a control string; backslashes only begin escapes."""
    for plain, code in (("\\", "\\b"), ("#", "\\h"), ("<", "\\l")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for code, plain in (("\\n", "\n"), ("\\l", "<"), ("\\h", "#"), ("\\b", "\\")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def windows(df: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, formatted, repeated, loss, n_tokens), one row per window, of conv_id, turn, role, text.

    window: numbers that rise within a conversation, with gaps. formatted: the system turn, history and new turns, each
    as its role, a line break and its text between marks. repeated: how many turns at its start an earlier window has
    had. loss: start (from 1) and length, in code points, of the new assistant texts in `formatted`; repeated ones are
    not in it. A window keeps to the budget unless one turn, or the system turn, is too long: turns are never cut.

    Turns are ordered by turn, role and text, so that ties have one order; repeated rows are turns of their own. Null
    texts and roles count as empty, rows with a null turn come first, and rows with a null conv_id are one conversation.
    The system turn is a conversation's first turn if its role is `system`; later ones are ordinary turns. Columns other
    than the four are not read. No rows, no windows.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = df.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS)).withColumn("cost", tokens(F.col("text")) + MARKS)
    in_block = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    of_block = Window.partitionBy("conv_id").orderBy("block")
    head = F.min(F.struct("turn", "role", "text", "cost"))
    totals = rows.groupBy("conv_id", "block").agg(F.sum("cost").alias("sum"), head.alias("head"))
    system = F.first(F.when(F.col("head.role") == "system", F.col("head.cost")).otherwise(0)).over(of_block)
    totals = totals.select(
        "conv_id",
        "block",
        (F.row_number().over(of_block) == 1).alias("is_first"),
        system.alias("system_cost"),
        F.coalesce(F.sum("sum").over(of_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.lead("head").over(of_block)["cost"].alias("next_head"),
    )
    inner = rows.select("*", F.sum("cost").over(in_block.rowsBetween(Window.unboundedPreceding, 0)).alias("inner"), F.row_number().over(in_block).alias("number"), F.lead("cost").over(in_block).alias("next"))
    at = ["conv_id", "block"]
    same = F.lit(True)
    for c in at:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}"))
    turns = inner.alias("r").join(totals.alias("t"), same).select(
        "r.conv_id",
        "role",
        "text",
        "cost",
        "system_cost",
        (F.col("is_first") & (F.col("number") == 1) & (F.col("role") == "system")).alias("is_system"),
        # Sums go over all but the system turn, which stands first.
        (F.col("before") + F.col("inner") - F.col("system_cost")).alias("sum"),
        F.coalesce("next", "next_head").alias("next"),
    )
    half = F.floor(F.greatest(F.lit(budget - history) - F.col("system_cost"), F.lit(budget // 4)) / 2)

    def number(before: Column, cost: Column) -> Column:
        return F.floor(before / half) * 2 + F.when(cost > half, 1).otherwise(0)

    spans = (
        turns.where(~F.col("is_system"))
        .withColumn("window", number(F.col("sum") - F.col("cost"), F.col("cost")))
        .withColumn("after", F.when(F.col("next").isNotNull(), number(F.col("sum"), F.col("next"))))
        .groupBy("conv_id", "window")
        .agg(F.sort_array(F.collect_list(F.struct("sum", "cost", "role", "text"))).alias("new"), F.max("sum").alias("end"), F.max_by("after", "sum").alias("after"))
    )
    tail = F.filter("new", lambda t: F.col("end") - t["sum"] + t["cost"] <= history)
    past = spans.where("after is not null").select(F.col("conv_id").alias("past_id"), F.col("after").alias("past_window"), tail.alias("past"))
    spans = spans.join(past, F.col("conv_id").eqNullSafe(F.col("past_id")) & (F.col("window") == F.col("past_window")), "left")
    system_turns = turns.where("is_system").select(F.col("conv_id").alias("own_id"), F.struct(F.lit(0).cast("long").alias("sum"), "cost", "role", "text").alias("system"))
    both = spans.join(system_turns, F.col("conv_id").eqNullSafe(F.col("own_id")), "left")
    alone = system_turns.join(spans.select("conv_id"), F.col("conv_id").eqNullSafe(F.col("own_id")), "left_anti")
    none = F.array().cast(spans.schema["new"].dataType)
    both = both.select("conv_id", "window", "system", F.coalesce("past", none).alias("past"), "new").unionByName(
        alone.select(F.col("own_id").alias("conv_id"), F.lit(0).cast("long").alias("window"), "system", none.alias("past"), none.alias("new"))
    )
    first = F.col("window") == F.min("window").over(Window.partitionBy("conv_id"))
    return _formatted(both.withColumn("is_first", first))


def _formatted(spans: DataFrame) -> DataFrame:
    head = F.when(F.col("system").isNotNull(), F.array("system")).otherwise(F.array().cast(spans.schema["new"].dataType))
    shown = F.concat(head, "past", "new")
    parts = F.transform(shown, lambda t: F.struct(F.concat(F.lit(OPEN), _role(t["role"]), F.lit("\n")).alias("mark"), escaped(t["text"]).alias("body"), (t["role"] == "assistant").alias("learn")))
    repeated = F.size("past") + F.when(F.col("is_first"), 0).otherwise(F.size(head))
    spans = spans.select("conv_id", "window", repeated.alias("repeated"), parts.alias("parts"), F.aggregate(shown, F.lit(0).cast("long"), lambda a, t: a + t["cost"]).alias("n_tokens"))
    whole = F.array_join(F.transform("parts", lambda p: F.concat(p["mark"], p["body"], F.lit(CLOSE))), "")
    # Running positions over the few turns of a window.
    start = F.lit(1).cast("long")
    zero = F.struct(start.alias("at"), F.array().cast("array<struct<start: bigint, length: bigint>>").alias("loss"))

    def step(a: Column, p: Column) -> Column:
        begin, size = a["at"] + F.length(p["mark"]), F.length(p["body"]).cast("long")
        own = F.when(p["learn"], F.array(F.struct(begin.alias("start"), size.alias("length")))).otherwise(F.array().cast("array<struct<start: bigint, length: bigint>>"))
        return F.struct((begin + size + len(CLOSE)).alias("at"), F.concat(a["loss"], own).alias("loss"))

    skipped = F.transform("parts", lambda p, i: F.struct(p["mark"].alias("mark"), p["body"].alias("body"), (p["learn"] & (i >= F.col("repeated"))).alias("learn")))
    return spans.select("conv_id", "window", whole.alias("formatted"), F.col("repeated").cast("int"), F.aggregate(skipped, zero, step)["loss"].alias("loss"), "n_tokens")


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, window, formatted, turns, learned): the new turns' roles and texts, and the texts under the loss mask."""
    turns = F.split("formatted", CLOSE)
    count = F.size(turns) - 1 - F.col("repeated")
    new = F.slice(turns, F.col("repeated") + 1, count)
    mark = len(OPEN)

    def turn(part: Column) -> Column:
        line = F.instr(part, "\n")
        return F.struct(unescaped(F.substring(part, mark + 1, line - mark - 1)).alias("role"), unescaped(F.substring(part, line + 1, F.length(part))).alias("text"))

    learned = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s["start"].cast("int"), s["length"].cast("int"))))
    return formatted.select("conv_id", "window", "formatted", F.transform(new, turn).alias("turns"), learned.alias("learned"))
