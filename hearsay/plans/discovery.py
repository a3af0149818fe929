"""Reports that treat frequent discovered names like monitored entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.functions.text import is_reported_name
from hearsay.operators.textsearch import find_terms
from hearsay.plans.analytics import top_entities
from hearsay.plans.facts import window_comments, window_signals
from hearsay.tables import Tables


def name_mentions(t: Tables, names: DataFrame, start, end, platforms=None) -> DataFrame:
    """(name, comment) pairs where the comment's text contains the name.

    ``names`` has a ``name`` column; ``%`` and ``_`` in a name are plain characters.
    """
    comments = window_comments(t, start, end).select("comment_id", "post_id", "likes", "text")
    if platforms:
        posts = t.posts.filter(F.col("platform").isin(list(platforms))).select("post_id")
        comments = comments.join(posts, "post_id", "left_semi")
    terms = names.withColumn("ord", F.col("name")).withColumn("term", F.lower("name"))
    return find_terms(comments.drop("post_id"), "text", terms).drop("ord", "term")


def unmonitored(discovered: DataFrame, monitored: DataFrame, monitored_name: str = "name") -> DataFrame:
    """Discovered names that are not the name of a monitored entity, ignoring case."""
    known = monitored.select(F.lower(monitored_name).alias("_known")).distinct()
    return discovered.join(known, F.lower(discovered["name"]) == F.col("_known"), "left_anti")


def dynamic_entities(
    t: Tables, start, end, min_mentions: int = 10, platforms: list[str] | None = None, limit: int = 50
) -> DataFrame:
    """Monitored entities and frequent discovered names in one ranking.

    Every discovered name that is tallied often enough, may be reported and is
    not in the catalog is counted in the window; ``limit`` cuts the ranking only.
    """
    monitored = top_entities(t, start, end, platforms, limit).withColumn("is_monitored", F.lit(True))

    candidates = t.discovered_entities.filter(
        (F.col("mention_count") >= min_mentions) & is_reported_name(F.col("name"))
    ).select("name", F.coalesce("entity_type", F.lit("unknown")).alias("entity_type"))
    mentions = name_mentions(t, unmonitored(candidates, t.monitored_entities), start, end, platforms)

    # One pass per comment and name: the left join keeps unscored mentions, and
    # the per-comment sums let both counts come out of a single aggregation.
    scored = (
        window_signals(t, "sentiment", start, end, scored=True)
        .groupBy("comment_id")
        .agg(
            F.sum("numeric_value").alias("s"),
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("numeric_value") * F.col("weight_score")).alias("sw"),
            F.sum("weight_score").alias("w"),
        )
    )
    totals = (
        mentions.join(scored, "comment_id", "left")
        .groupBy("name", "entity_type")
        .agg(
            F.count(F.lit(1)).alias("mention_count"),
            F.coalesce(F.sum("likes"), F.lit(0)).alias("total_likes"),
            F.try_divide(F.sum("s"), F.sum("n")).alias("avg"),
            F.sum("sw").alias("sw"),
            F.sum("w").alias("w"),
        )
        .filter(F.col("mention_count") >= min_mentions)
    )
    weighted = F.when(F.col("avg") == 0, 0.0).when(F.col("w") > 0, F.try_divide("sw", "w")).otherwise(F.col("avg"))
    discovered = totals.select(
        F.lit(None).cast(monitored.schema["entity_id"].dataType).alias("entity_id"),
        F.col("name").alias("entity_name"),
        "entity_type",
        "mention_count",
        F.bround(F.coalesce("avg", F.lit(0.0)), 3).alias("avg_sentiment"),
        "total_likes",
        F.bround(F.coalesce(weighted, F.lit(0.0)), 3).alias("weighted_sentiment"),
        F.lit(False).alias("is_monitored"),
    )
    both = monitored.unionByName(discovered)
    return both.orderBy(F.desc("mention_count"), F.desc("is_monitored"), "entity_id", "entity_name").limit(limit)


def resolve_promoted(t: Tables, ranking: DataFrame) -> DataFrame:
    """Give discovered rows the id of an entity that was added under their name since."""
    known = t.monitored_entities.groupBy(F.col("name").alias("entity_name")).agg(
        F.min("entity_id").alias("_promoted")
    )
    return ranking.join(known, "entity_name", "left").withColumn(
        "entity_id", F.coalesce("entity_id", "_promoted")
    ).drop("_promoted")
