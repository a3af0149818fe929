"""Recurring storylines among the comments of a window."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay import fixed_values as fv
from hearsay.functions.labels import trajectory
from hearsay.plans.facts import window_comments
from hearsay.session import checkpointed
from hearsay.sizing import packed, unnest
from hearsay.tables import Tables


def engaged_comments(
    t: Tables, start, end, min_likes: int = fv.STORYLINE_MIN_LIKES, limit: int = fv.STORYLINE_COMMENTS
) -> DataFrame:
    """The most liked comments of a window, ties by id."""
    liked = window_comments(t, start, end).filter(F.col("likes") >= min_likes)
    return liked.orderBy(F.desc("likes"), "comment_id").limit(limit)


# The border of a word of letters, digits of any kind and underscores; Java's own takes accents that
# stand alone and invisible joiners for parts of words, and raised digits and fractions for none.
_WORD = r"[\p{L}\p{N}_]"
_BORDER = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def _hits(text: Column, line: str) -> Column:
    """Whole-word hits of ``line``, a word, phrase or pattern, in a lower-case text.

    Only a text that contains the phrase is worth the pattern.
    """
    if re.search(r"[^\w ]", line) or line != line.strip():
        return F.regexp_count(text, F.lit(rf"(?U){_BORDER}{line}{_BORDER}"))
    # The phrase comes first in the pattern, so places without it cost little.
    counted = F.regexp_count(text, F.lit(rf"{line}(?<!{_WORD}{line})(?!{_WORD})"))
    return F.when(F.contains(text, F.lit(line)), counted).when(text.isNotNull(), 0)


def storyline_counts(
    comments: DataFrame, storylines: list[str] | None = None, min_hits: int = fv.STORYLINE_MIN_HITS,
    keep: int = fv.STORYLINE_KEEP,
) -> DataFrame:
    """Whole-word hits of each storyline over the texts, the most frequent first."""
    names = storylines or fv.STORYLINES
    hits = [F.sum(_hits(F.lower("text"), s)).alias(f"_{i}") for i, s in enumerate(names)]
    listed = F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(s).alias("storyline"), F.col(f"_{i}").alias("mention_count")) for i, s in enumerate(names)
    ])
    # One row of sums: texts are neither repeated nor shuffled.
    counts = comments.agg(*hits).select(F.inline(listed))
    return counts.filter(F.col("mention_count") >= min_hits).orderBy(F.desc("mention_count"), "ord").limit(keep)


def storylines(
    t: Tables, start, end, top: DataFrame, names: list[str] | None = None, min_likes: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Storylines with the top entities that share at least two comments with them.

    ``top`` is a bounded ranking (``rank``, ``entity_name``). Counting is by
    whole words; sharing a comment is by containment. All comments of the window
    count, unless ``min_likes`` or ``limit`` ask for the most liked ones only.
    """
    comments = window_comments(t, start, end)
    if min_likes is not None:
        comments = comments.filter(F.col("likes") >= min_likes)
    if limit is not None:
        # Staged: a few rows that the counts and the pairs both read.
        comments = checkpointed(comments.orderBy(F.desc("likes"), "comment_id").limit(limit).select("comment_id", "text"))
    listed = names or fv.STORYLINES
    people = packed(top.select("rank", "entity_name", F.lower("entity_name").alias("term")), "rank")
    texts = comments.select(F.lower("text").alias("_text"), people.alias("_people"))
    found = F.array(*[
        F.struct(F.lit(i).alias("ord"), _hits(F.col("_text"), s).alias("hits"), F.contains("_text", F.lit(s.lower())).alias("inside"))
        for i, s in enumerate(listed)
    ])
    met = texts.select("_text", "_people", F.filter(found, lambda x: (x["hits"] > 0) | x["inside"]).alias("_lines")).select(
        "_lines", F.when(
            F.size("_lines") > 0, F.filter("_people", lambda x: F.contains(F.col("_text"), x["term"]))
        ).alias("_people"),
    )
    # A line gives one row with its hits and one for each entity of the same comment.
    nobody = F.array(F.lit(None).cast(top.select("rank", "entity_name", F.lower("entity_name").alias("term")).schema))
    lines = unnest(met, ["_people"], F.col("_lines"), "line")
    with_them = F.when(F.col("line.inside"), F.concat(nobody, "_people")).otherwise(nobody)
    rows = lines.select("line", F.explode_outer(with_them).alias("who"))
    # Staged: at most lines times entities rows, all that one scan of the texts gives.
    folded = checkpointed(rows.groupBy("line.ord", "who.rank", "who.entity_name").agg(F.count(F.lit(1)).alias("n"), F.sum("line.hits").alias("hits")))
    titles = F.array(*map(F.lit, listed))
    counts = (
        folded.filter("rank IS NULL AND hits >= 1").withColumn("storyline", F.get(titles, F.col("ord")))
        .filter(F.col("hits") >= fv.STORYLINE_MIN_HITS).orderBy(F.desc("hits"), "ord").limit(fv.STORYLINE_KEEP)
        .select("ord", "storyline", F.col("hits").alias("mention_count"))
    )
    linked = (
        folded.filter("rank IS NOT NULL AND n >= 2")
        .groupBy("ord")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "entity_name"))).alias("_who"))
    )
    shown = F.array_join(F.slice(F.transform("_who", lambda w: w["entity_name"]), 1, 3), ", ")
    highest = counts.agg(F.max("mention_count").alias("m")).scalar()
    out = counts.join(linked, "ord", "left").withColumn("_max", highest)
    return out.select(
        F.initcap("storyline").alias("storyline"), "mention_count",
        F.coalesce(shown, F.lit("General")).alias("entities"),
        F.bround(F.col("mention_count") * 100.0 / F.col("_max"), 1).alias("intensity"),
        trajectory(F.col("mention_count"), F.col("_max")).alias("trajectory"),
        F.lit("trending").alias("type"),
    )
