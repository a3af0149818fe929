"""Deterministic row ids from natural keys: a retried task makes the same id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SEPARATOR = "\u0001"


def natural_id(*parts: Column) -> Column:
    # NULL is a value of its own here, different from the empty string.
    shown = [F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]
    return F.sha2(F.concat_ws(_SEPARATOR, *shown), 256)


def post_id(platform: Column, external_id: Column) -> Column:
    return natural_id(platform, external_id)


def comment_id(post: Column, author: Column, text: Column, created_at: Column) -> Column:
    return natural_id(post, author, text, F.unix_micros(created_at))


def signal_id(comment: Column, entity: Column, signal_type: Column, model: Column, value: Column) -> Column:
    """A comment has many topics, so there the topic itself is part of the key."""
    topic = F.when(signal_type == "topic", value)
    return natural_id(comment, entity, signal_type, model, topic)


def review_id(comment: Column, mention: Column) -> Column:
    return natural_id(comment, mention)
