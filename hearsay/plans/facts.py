"""The windowed fact join that every report query starts from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.session import checkpointed
from hearsay.tables import Tables

# A stored fact table also carries its day as a partition column; a window on
# the exact time then prunes the files of both join sides.
_DAY = {"comments": "created_date", "signals": "comment_date"}


def as_time(moment) -> Column:
    return moment if isinstance(moment, Column) else F.lit(moment).cast("timestamp")


def in_window(at: Column, start=None, end=None, after=None) -> Column:
    """Inclusive ``start``/``end``; ``after`` is exclusive."""
    keep = F.lit(True)
    if start is not None:
        keep = keep & (at >= as_time(start))
    if end is not None:
        keep = keep & (at <= as_time(end))
    if after is not None:
        keep = keep & (at > as_time(after))
    return keep


def _day_range(df: DataFrame, day: str, start, end, after) -> DataFrame:
    if day not in df.columns:
        return df
    low = start if start is not None else after
    if low is not None:
        df = df.filter(F.col(day) >= F.to_date(as_time(low)))
    if end is not None:
        df = df.filter(F.col(day) <= F.to_date(as_time(end)))
    return df


def window_comments(t: Tables, start=None, end=None, after=None) -> DataFrame:
    comments = _day_range(t.comments, _DAY["comments"], start, end, after)
    return comments.filter(in_window(F.col("created_at"), start, end, after))


def window_signals(
    t: Tables, signal_type: str, start=None, end=None, after=None, with_entity=False, scored=False
) -> DataFrame:
    """Signals of one type, before the join that applies the exact window."""
    signals = _day_range(t.extracted_signals, _DAY["signals"], start, end, after)
    signals = signals.filter(F.col("signal_type") == signal_type)
    signals = _narrowed(signals, with_entity, scored)
    return signals.select("comment_id", "entity_id", "value", "numeric_value", "weight_score")


def _narrowed(signals: DataFrame, with_entity: bool, scored: bool) -> DataFrame:
    if with_entity:
        signals = signals.filter(F.col("entity_id").isNotNull())
    if scored:
        signals = signals.filter(F.col("numeric_value").isNotNull())
    return signals


def signal_facts(
    t: Tables, signal_type="sentiment", start=None, end=None, after=None, with_entity=False, scored=True
) -> DataFrame:
    """One row per signal with its comment's post, likes and time.

    Both sides are filtered and pruned first, then meet on ``comment_id``: a
    comment has few signals, so that key is never hot, and grouping by it
    afterwards needs no further shuffle.
    """
    if t.facts is not None:
        staged = t.facts.filter(F.col("signal_type") == signal_type)
        staged = staged.filter(in_window(F.col("created_at"), start, end, after))
        return _narrowed(staged, with_entity, scored).drop("signal_type")
    comments = window_comments(t, start, end, after).select("comment_id", "post_id", "created_at", "likes")
    signals = window_signals(t, signal_type, start, end, after, with_entity, scored)
    return signals.join(comments, "comment_id")


def stage_facts(t: Tables, start, end) -> Tables:
    """Join signals and comments of a window once, for many report sections.

    The join is written to the shared folder by signal type, so each section
    scans only its type and a lost executor costs no recomputation.
    """
    comments = window_comments(t, start, end).select("comment_id", "post_id", "created_at", "likes")
    signals = _day_range(t.extracted_signals, _DAY["signals"], start, end, None)
    joined = signals.select(
        "comment_id", "entity_id", "signal_type", "value", "numeric_value", "weight_score"
    ).join(comments, "comment_id")
    return t.with_(facts=checkpointed(joined, "signal_type"))


def sentiment_rollup(t: Tables, start, end, keys: list[str], with_entity=True) -> DataFrame:
    """Sums of scored sentiment per ``keys`` out of ``entity_id`` and ``post_id``.

    Distinct comments are counted after the co-located join; a hot entity or
    post is pre-aggregated in every task before anything is shuffled.
    """
    facts = signal_facts(t, "sentiment", start, end, with_entity=with_entity)
    weighted = F.col("numeric_value") * F.col("weight_score")
    return facts.groupBy(*keys).agg(
        F.countDistinct("comment_id").alias("mention_count"),
        F.count(F.lit(1)).alias("n_signals"),
        F.sum("numeric_value").alias("sum_score"),
        F.sum(weighted).alias("sum_weighted"),
        F.sum("weight_score").alias("sum_weight"),
        F.sum("likes").alias("total_likes"),
    )


def fold_rollup(rollup: DataFrame, *keys: str) -> DataFrame:
    """Add up rollup rows; exact because a comment belongs to one post."""
    names = ["mention_count", "n_signals", "sum_score", "sum_weighted", "sum_weight", "total_likes"]
    return rollup.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])


def with_platform(t: Tables, rollup: DataFrame, platforms: list[str] | None = None) -> DataFrame:
    """Attach the platform of each post to a per-post rollup.

    The rollup has one row per post (and entity), so a viral post is one row
    here however many comments it drew.
    """
    posts = t.posts.select("post_id", "platform")
    if platforms:
        posts = posts.filter(F.col("platform").isin(list(platforms)))
    return rollup.join(posts, "post_id")


def average(total="sum_score", count="n_signals") -> Column:
    return F.try_divide(F.col(total), F.col(count))


def weighted_average() -> Column:
    """Like-weighted mean, or the plain mean when the weights do not add up."""
    return F.when(
        F.col("sum_weight") > 0, F.try_divide(F.col("sum_weighted"), F.col("sum_weight"))
    ).otherwise(average())
