"""String functions on urls, ids, names and comment text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearsay import fixed_values as fv

_WHITESPACE = " \t\n\r\x0b\x0c"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_WHITESPACE))


def first_non_empty(*candidates: Column) -> Column:
    """The first candidate that is neither NULL nor the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])


def _url_segments(url: Column) -> Column:
    return F.split(F.rtrim(url, F.lit("/")), "/")


def post_id_from_url(url: Column) -> Column:
    """The code after ``/p/``; without one, the last path segment."""
    code = F.regexp_extract(F.rtrim(url, F.lit("/")), r"/p/([^/?]+)", 1)
    return F.coalesce(F.nullif(code, F.lit("")), F.element_at(_url_segments(url), -1))


def post_id_from_last_segment(url: Column) -> Column:
    """The last path segment, or the one before when that is a bare ``p``."""
    parts = _url_segments(url)
    last = F.element_at(parts, -1)
    return F.when(last == "p", F.try_element_at(parts, F.lit(-2))).otherwise(last)


def app_link_media_id(link: Column) -> Column:
    """Digits of ``id=...`` in an app link; NULL when there are none."""
    return F.nullif(F.regexp_extract(link, r"id=(\d+)", 1), F.lit(""))


def rounded_id_prefix(numeric_id: Column) -> Column:
    """The 15 digits that survive when a spreadsheet rounds a long id."""
    return F.substring(numeric_id, 1, 15)


def raw_row_json(*columns: str) -> Column:
    """The whole source row as JSON, keeping NULL fields."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def strip_hint(name: Column) -> Column:
    """Drop a trailing `` (hint)`` and surrounding white space."""
    return strip(F.substring_index(name, " (", 1))


def with_hint(name: Column, aliases: Column) -> Column:
    """Entity name plus the hint shown to a scorer to tell namesakes apart."""
    listed = F.concat(
        name, F.lit(" (aliases: "), F.array_join(F.slice(aliases, 1, 3), ", "), F.lit(")")
    )
    out = F.when(F.size(F.coalesce(aliases, F.array().cast("array<string>"))) > 0, listed).otherwise(name)
    for words, hint in reversed(fv.DISAMBIGUATION_HINTS):
        named = F.lit(True)
        for word in words:
            named = named & F.contains(name, F.lit(word))
        out = F.when(named, F.concat(name, F.lit(hint))).otherwise(out)
    return out


def clip(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)


def caption_preview(caption: Column, length: int = 100) -> Column:
    """The caption, cut with an ellipsis when longer than ``length``."""
    short = F.when(
        F.length(caption) > length, F.concat(F.substring(caption, 1, length), F.lit("..."))
    ).otherwise(caption)
    return F.coalesce(short, F.lit(""))


def quote_sample(text: Column, likes: Column) -> Column:
    """One-line quote with its like count; empty text gives an empty string."""
    line = F.replace(strip(F.coalesce(text, F.lit(""))), F.lit("\n"), F.lit(" "))
    cut = F.when(
        F.length(line) > 160, F.concat(F.substring(line, 1, 157), F.lit("..."))
    ).otherwise(line)
    shown = F.concat(F.format_number(F.coalesce(likes, F.lit(0)), 0), F.lit(" likes · "), cut)
    return F.when(line == "", F.lit("")).otherwise(shown)


@F.pandas_udf(T.StringType())
def _compatibility_form(text: pd.Series) -> pd.Series:
    return text.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def display_text(text: Column) -> Column:
    """NFKC form without control characters, for display."""
    return F.regexp_replace(_compatibility_form(F.coalesce(text, F.lit(""))), r"\p{C}", "")


def _letters(name: Column) -> Column:
    return F.length(F.regexp_replace(name, r"\P{L}", ""))


def is_scored_name(name: Column) -> Column:
    """Whether a name returned by a scorer may become a signal."""
    return F.coalesce(
        (F.length(name) >= 2)
        & ~name.rlike("[■□▪]")
        & ~strip(name).rlike(fv.EMOJI_ONLY_PATTERN)
        & ~F.lower(name).isin(fv.NOT_SCORED_NAMES)
        & (_letters(name) >= F.length(name) * 0.5),
        F.lit(False),
    )


def is_discovered_name(name: Column) -> Column:
    """Whether a mention outside the catalog is worth tracking."""
    clean = strip(name)
    dropped = fv.FUNCTION_WORDS + fv.BOILERPLATE_NAMES + fv.BOILERPLATE_PHRASES
    return F.coalesce(
        ~clean.rlike(fv.EMOJI_ONLY_PATTERN)
        & (F.length(clean) >= 2)
        & clean.rlike("[a-zA-Z]")
        & ~F.lower(clean).isin(dropped)
        & ~name.rlike(fv.WIDE_SYMBOL_PATTERN)
        & ~name.rlike("[■□]"),
        F.lit(False),
    )


def is_reported_name(name: Column) -> Column:
    """Whether a discovered name may appear in a report."""
    return F.coalesce(
        ~strip(F.lower(name)).isin(fv.REPORT_BLOCKLIST)
        & ~name.rlike("[■□]")
        & (F.length(name) >= 2)
        & name.rlike(r"\p{L}"),
        F.lit(False),
    )
