"""Size checks that decide whether a small side may be broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.session import checkpointed

# A catalog of monitored names holds tens of rows; this bound leaves two orders
# of magnitude of room and keeps the broadcast below a few megabytes.
SMALL_ROWS = 20_000
# What every executor can hold beside its tasks: one row per post, say, with short values.
BESIDE_BYTES = 128 << 20


def within(df: DataFrame, rows: int = SMALL_ROWS) -> bool:
    """True when ``df`` holds at most ``rows`` rows (reads ``rows + 1`` at most)."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Hint a broadcast after counting; otherwise leave the join to the planner."""
    return F.broadcast(df) if within(df, rows) else df


def beside(df: DataFrame, most: int = BESIDE_BYTES) -> DataFrame:
    """``df`` staged, and broadcast if it takes at most ``most`` bytes, so that rows with large texts meet it where they are.

    Beyond that a join moves the rows, whatever their texts.
    """
    df = checkpointed(df)
    # A row takes 8 bytes a column, strings rounded up to 8 more, and its place in the table.
    widths = [F.coalesce(F.octet_length(c), F.lit(0)) + 16 if kind == "string" else F.lit(8) for c, kind in df.dtypes]
    held = df.agg(F.sum(sum(widths, F.lit(48))).alias("held")).first()["held"] or 0
    return F.broadcast(df) if held <= most else df


def broadcast_top(df: DataFrame) -> DataFrame:
    """Broadcast a frame whose row count is fixed by a ``limit`` in its own plan."""
    return F.broadcast(df)


def packed(df: DataFrame, order: str) -> Column:
    """All rows of a *bounded* frame as one array of structs, ordered by ``order``.

    The array is a scalar subquery, so it is computed once and needs no join.
    Callers must have bounded ``df`` by ``within`` or by a ``limit``.
    """
    cols = [order] + [c for c in df.columns if c != order]
    rows = df.agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("rows"))
    return rows.scalar()


def unnest(df: DataFrame, keep: list, items: Column, name: str, position: str | None = None) -> DataFrame:
    """One row per array element; elements are never NULL.

    A plain explode makes the planner infer a "not empty" filter that evaluates
    ``items`` again, so a costly array would be computed twice or more.
    """
    if position is None:
        return df.select(*keep, F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())
    rows = df.select(*keep, F.posexplode_outer(items).alias(position, name))
    return rows.filter(F.col(position).isNotNull())


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it inside ``body``.

    Without this, a projection merged by the optimizer may evaluate the value
    once per array element of a higher-order function.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
