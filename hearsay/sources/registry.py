"""Readers by name, so that callers can add their own source layouts.

A reader maps (spark, paths, **options) to a DataFrame of raw comment records.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hearsay.schemas import RAW_COMMENT
from hearsay.sources import comments as _comments

Reader = Callable[..., DataFrame]
_READERS: dict[str, Reader] = {}


def register_source(name: str, reader: Reader) -> None:
    _READERS[name] = reader


def read_source(spark: SparkSession, name: str, paths, **options) -> DataFrame:
    """Records of the named source; fails early when the contract is broken."""
    if name not in _READERS:
        raise ValueError(f"unknown source {name!r}; known: {', '.join(sorted(_READERS))}")
    records = _READERS[name](spark, paths, **options)
    missing = [f.name for f in RAW_COMMENT.fields if f.name not in records.columns]
    if missing:
        raise ValueError(f"source {name!r} lacks columns: {', '.join(missing)}")
    return records


register_source("vendor", _comments.read_vendor_comments)
register_source("simple", _comments.read_simple_comments)
register_source("raw", _comments.read_raw_comments)
register_source("auto", _comments.read_comments)
