"""Operator 6: chat formatting in budgeted windows. DataFrame functions only.

A turn is written as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside texts ``&``
becomes ``&amp;`` and ``<|`` becomes ``&lt;|``, so no text can hold a control string, and
both can be undone; a line break in a role becomes ``&nl;``.

Prefix sums of turn tokens place each turn on the token axis of its conversation,
the system turn left out. The axis has cells of the target budget. The turns
inside a cell are one span, a turn across a cell border is a span of its own, so
spans end at turns and hold no more than the budget unless one turn does. A
window is the system turn, then as many whole turns before the span as the
history budget holds, then the span. Only the assistant texts of the span are
under the loss mask; repeated history is not, so each is learned once.

Prefix sums are taken in two levels, over ranges of turn numbers and within them,
and history is found by an equi-join on cells; a conversation with any number of
turns is dealt over many tasks. A window is bounded by its budgets.

Cases: NULL text and NULL role are empty; NULL conversations are one
conversation; NULL turns come first; equal turns are ordered by role and text,
and repeated rows stay. Only a first turn with the role ``system`` is retained.
Empty tables give no window; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
TURNS_PER_RANGE = 512
TURN_OVERHEAD = 4


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def piece_count(text: Column) -> Column:
    """Tokens of a text: words, numbers and other signs, with the overhead of a turn."""
    return F.regexp_count(text, F.lit(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]")).cast("long") + F.lit(TURN_OVERHEAD)


def placed(turns: DataFrame, tokens: Callable[[Column], Column], budget: int, history: int) -> tuple[DataFrame, DataFrame]:
    """Turns on the token axis with cell and span, and the system turns by conversation."""
    rows = turns.withColumn("tokens", tokens(F.col("text"))).withColumn("range", F.expr(f"turn div {TURNS_PER_RANGE}"))
    # The axis: one row for each range of turns, then within the range.
    first = F.min(F.struct(F.col("turn"), F.col("role"), F.col("text"), F.col("tokens")))
    ranges = rows.groupBy("conv", "range").agg(F.sum("tokens").alias("range_tokens"), first.alias("first"))
    along = Window.partitionBy("conv").orderBy(F.asc_nulls_first("range"))
    is_first = F.row_number().over(along) == 1
    head = F.first("first").over(along)
    has_system = head["role"] == "system"
    ranges = ranges.select(
        "conv", "range",
        (is_first & has_system).alias("starts_with_system"),
        F.when(has_system, head["tokens"]).otherwise(0).alias("system_tokens"),
        F.coalesce(F.sum("range_tokens").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
        F.when(is_first & has_system, head["text"]).alias("system_text"),
    )
    system = ranges.filter("starts_with_system").select("conv", "system_text", "system_tokens")
    inside = Window.partitionBy("conv", "range").orderBy(F.asc_nulls_first("turn"), "role", "text")
    here = rows.select(
        "*", F.row_number().over(inside).alias("nth"),
        F.coalesce(F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    r = ranges.drop("system_text").select(F.col("conv").alias("c2"), F.col("range").alias("r2"), "starts_with_system", "system_tokens", "base")
    on = F.col("conv").eqNullSafe(F.col("c2")) & F.col("range").eqNullSafe(F.col("r2"))
    here = here.join(r, on).filter(~(F.col("starts_with_system") & (F.col("nth") == 1)))
    begin = F.col("base") + F.col("before") - F.col("system_tokens")
    # A long system turn leaves at least as much for the span as for its history.
    cell_size = F.greatest(F.lit(budget - history) - F.col("system_tokens"), F.lit(max(history, 1)))
    here = here.withColumn("begin", begin).withColumn("end", F.col("begin") + F.col("tokens")).withColumn("size", cell_size)
    here = here.withColumn("cell", F.expr("begin div size"))
    across = F.col("end") > (F.col("cell") + 1) * F.col("size")
    return here.select("conv", "role", "text", "tokens", "begin", "end", "cell", across.alias("across")), system


def windows(
    turns: DataFrame, budget: int = 1024, history: int = 256, tokens: Callable[[Column], Column] = piece_count,
    conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row per window.

    Columns: the conversation, ``window_start`` (where its span begins on the
    token axis; windows in this order hold the turns in order), ``formatted``,
    ``context_turns`` (turns at the start that are retained or repeated),
    ``loss_spans`` (array of start and length, in characters of ``formatted``)
    and ``n_tokens``. The conversation has a window even if it is a system turn alone.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    here, system = placed(rows, tokens, budget, history)
    spans = here.groupBy("conv", "cell", "across").agg(F.min("begin").alias("start"))
    # History begins within the cell of the span or the one before: the history budget is no larger than a cell.
    wanted = spans.select(
        F.col("conv").alias("c2"), F.explode(F.array(F.col("cell") - 1, F.col("cell"))).alias("from_cell"),
        F.col("cell").alias("span_cell"), F.col("across").alias("span_across"), "start",
    )
    near = (
        F.col("conv").eqNullSafe(F.col("c2")) & (F.col("cell") == F.col("from_cell"))
        & (F.col("end") <= F.col("start")) & (F.col("begin") >= F.col("start") - history)
    )
    piece = ["conv", "cell", "across", "kind", "begin", "role", "text", "tokens"]
    repeated = here.join(wanted, near).select("conv", F.col("span_cell").alias("cell"), F.col("span_across").alias("across"), F.lit(1).alias("kind"), *piece[4:])
    targets = here.withColumn("kind", F.lit(2)).select(*piece)
    s = system.select(F.col("conv").alias("c2"), "system_text", "system_tokens")
    with_system = spans.join(s, F.col("conv").eqNullSafe(F.col("c2")), "right").select(
        F.col("c2").alias("conv"), F.coalesce("cell", F.lit(0)).alias("cell"), F.coalesce("across", F.lit(False)).alias("across"), F.lit(0).alias("kind"),
        F.lit(-1).cast("long").alias("begin"), F.lit("system").alias("role"), F.col("system_text").alias("text"), F.col("system_tokens").alias("tokens"),
    )
    both = targets.unionByName(repeated).unionByName(with_system)
    header = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    cells = both.select("conv", "cell", "across", F.struct("kind", "begin", F.col("role").alias("role"), header.alias("header"), body.alias("body"), "tokens").alias("turn"))
    grouped = cells.groupBy("conv", "cell", "across").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    no_span = F.array().cast("array<struct<start:int,length:int>>")

    def add(done: Column, t: Column) -> Column:
        begin = done["at"] + F.char_length(t["header"])
        span = F.struct(begin.alias("start"), F.char_length(t["body"]).alias("length"))
        learned = (t["kind"] == 2) & (t["role"] == "assistant")
        return F.struct(
            (begin + F.char_length(t["body"]) + F.lit(len(END))).alias("at"),
            F.when(learned, F.array_append(done["spans"], span)).otherwise(done["spans"]).alias("spans"),
        )

    zero = F.struct(F.lit(0).alias("at"), no_span.alias("spans"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["header"], t["body"], F.lit(END))), "")
    targets_only = F.filter("turns", lambda t: t["kind"] == 2)
    return grouped.select(
        F.col("conv").alias(conv_col),
        F.coalesce(F.get(targets_only, F.lit(0))["begin"], F.lit(0)).alias("window_start"),
        text.alias("formatted"),
        F.size(F.filter("turns", lambda t: t["kind"] < 2)).alias("context_turns"),
        F.aggregate("turns", zero, add, lambda done: done["spans"]).alias("loss_spans"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + t["tokens"]).alias("n_tokens"),
    )


def parse(window: DataFrame) -> DataFrame:
    """Read windows back: ``turns`` (role, text) of the formatted text alone, and ``loss_texts`` under the mask."""
    parts = F.split(F.col("formatted"), r"<\|im_end\|>\n")
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(part: Column) -> Column:
        at = F.instr(part, "\n")
        role = F.substring(part, F.lit(len(START) + 1), at - F.lit(len(START) + 1))
        return F.struct(unescape_role(role).alias("role"), unescape(F.substring(part, at + 1, F.char_length(part))).alias("text"))

    learned = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return window.withColumn("turns", F.transform(parts, turn)).withColumn("loss_texts", learned)
