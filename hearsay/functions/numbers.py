"""Parsing and arithmetic on counts, timestamps and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d{1,2})?$"


def parse_timestamp(text: Column, default: Column | None = None) -> Column:
    """Epoch seconds when numeric, else an ISO timestamp, else ``default``."""
    epoch = F.when(
        text.rlike(r"^\d{1,11}(\.\d+)?$"), F.timestamp_seconds(F.expr("1D") * text.try_cast("double"))
    )
    parsed = F.coalesce(epoch, F.when(~text.rlike(r"^\d+(\.\d+)?$"), F.try_to_timestamp(text)))
    return parsed if default is None else F.coalesce(parsed, default)


def parse_epoch(text: Column, default: Column | None = None) -> Column:
    """Whole epoch seconds only; anything else gives ``default``."""
    parsed = F.when(
        text.rlike(r"^\s*[+-]?\d{1,11}\s*$"), F.timestamp_seconds(text.try_cast("bigint"))
    )
    return parsed if default is None else F.coalesce(parsed, default)


def safe_int(text: Column) -> Column:
    return F.nullif(text, F.lit("")).try_cast("bigint")


def human_count(text: Column, strict: bool = False) -> Column:
    """``46k`` and ``1.2m`` style counts as whole numbers.

    Unreadable input gives 0, or NULL with ``strict``, which also wants plain
    numbers to be whole.
    """
    shown = F.lower(F.btrim(text, F.lit(" \t\n\r")))

    def scaled(mark: str, factor: int) -> Column:
        digits = F.replace(shown, F.lit(mark), F.lit(""))
        return F.when(
            digits.rlike(_NUMBER), (digits.try_cast("double") * F.lit(float(factor))).try_cast("bigint")
        )

    plain = shown.try_cast("bigint") if strict else scaled("#", 1)
    value = (
        F.when(F.contains(shown, F.lit("k")), scaled("k", 1_000))
        .when(F.contains(shown, F.lit("m")), scaled("m", 1_000_000))
        .otherwise(plain)
    )
    return value if strict else F.coalesce(value, F.lit(0).cast("bigint"))


def like_weight(likes: Column) -> Column:
    return F.lit(1.0) + F.coalesce(likes, F.lit(0)) / F.lit(100.0)


def percent_of(part: Column, total: Column) -> Column:
    """Share in percent with one decimal; 0 when there is no total."""
    return F.coalesce(F.bround(F.try_divide(part.cast("double"), total) * 100, 1), F.lit(0.0))


def percent_change(before: Column, after: Column) -> Column:
    """Change relative to the size of ``before``; 0 when that is 0."""
    return F.when(before == 0, F.lit(0.0)).otherwise((after - before) / F.abs(before) * 100)


def ratio(total: Column, count: Column) -> Column:
    """Sum over count as a double, NULL for an empty group."""
    return F.try_divide(total.cast("double"), count)
