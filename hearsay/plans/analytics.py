"""Entity, platform and post analytics over the signals table.

Every query works on all entities in one pass; callers filter the result for
one entity. ``as_of`` stands for "now", so that results can be reproduced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay import fixed_values as fv
from hearsay.functions.labels import sentiment_bucket
from hearsay.functions.numbers import percent_change, percent_of
from hearsay.functions.text import caption_preview, clip
from hearsay.operators.textsearch import find_terms
from hearsay.plans.facts import (
    as_time,
    average,
    fold_rollup,
    in_window,
    sentiment_rollup,
    signal_facts,
    weighted_average,
    window_comments,
    with_platform,
)
from hearsay.session import checkpointed
from hearsay.sizing import SMALL_ROWS, broadcast_if_small, broadcast_top, within
from hearsay.tables import Tables


def _ago(as_of, **span: int) -> Column:
    (unit, amount), = span.items()
    return as_time(as_of) - F.expr(f"INTERVAL {int(amount)} {unit.upper()}")


def _entity_names(t: Tables, *columns: str) -> DataFrame:
    return t.monitored_entities.select("entity_id", F.col("name").alias("entity_name"), *columns)


def only_entities(df: DataFrame, ids) -> DataFrame:
    """Rows of the given entities: a list of ids, or a DataFrame of ids."""
    if isinstance(ids, DataFrame):
        return df.join(broadcast_if_small(ids.select("entity_id").distinct()), "entity_id", "left_semi")
    return df.filter(F.col("entity_id").isin(list(ids)))


# ---------------------------------------------------------------- entities


def entity_totals(t: Tables, start, end, platforms: list[str] | None = None) -> DataFrame:
    """Mentions, sentiment and likes of every mentioned entity in a window."""
    if platforms:
        rollup = sentiment_rollup(t, start, end, ["entity_id", "post_id"])
        rollup = fold_rollup(with_platform(t, rollup, platforms), "entity_id")
    else:
        rollup = sentiment_rollup(t, start, end, ["entity_id"])
    return rollup.join(_entity_names(t, "entity_type"), "entity_id").select(
        "entity_id",
        "entity_name",
        "entity_type",
        "mention_count",
        average().alias("avg_sentiment"),
        "total_likes",
        weighted_average().alias("weighted_sentiment"),
    )


def top_entities(
    t: Tables, start, end, platforms: list[str] | None = None, limit: int = 20,
    entity_types: list[str] | None = None,
) -> DataFrame:
    """Entities by number of mentioning comments, ties by id."""
    totals = entity_totals(t, start, end, platforms)
    if entity_types:
        totals = totals.filter(F.col("entity_type").isin(list(entity_types)))
    return totals.orderBy(F.desc("mention_count"), "entity_id").limit(limit)


def _compare_halves(facts: DataFrame, older: Column, newer: Column, names: tuple[str, str]) -> DataFrame:
    """Average and count per entity in two (touching, inclusive) periods."""
    old, new = names
    score = F.col("numeric_value")
    return facts.groupBy("entity_id").agg(
        F.avg(F.when(newer, score)).alias(f"{new}_avg"),
        F.count_if(newer).alias(f"{new}_count"),
        F.avg(F.when(older, score)).alias(f"{old}_avg"),
        F.count_if(older).alias(f"{old}_count"),
    )


def velocity(t: Tables, as_of, window_hours: int = fv.VELOCITY_HOURS, min_sample_size: int = 10) -> DataFrame:
    """Sentiment change between the last window and the one before, per entity.

    One conditional aggregation serves all entities. An entity with too few
    signals in either window gets an ``error`` instead of a change.
    """
    recent_start = _ago(as_of, hours=window_hours)
    previous_start = _ago(as_of, hours=2 * window_hours)
    facts = signal_facts(t, "sentiment", previous_start, as_time(as_of), with_entity=True)
    at = F.col("created_at")
    sides = _compare_halves(
        facts, in_window(at, previous_start, recent_start), in_window(at, recent_start, as_of),
        ("previous", "recent"),
    )
    counted = _entity_names(t).join(sides, "entity_id", "left").fillna(0, ["recent_count", "previous_count"])
    enough = (F.col("recent_count") >= min_sample_size) & (F.col("previous_count") >= min_sample_size)
    change = F.when(enough, percent_change(F.col("previous_avg"), F.col("recent_avg")))
    return counted.withColumn("change", change).select(
        "entity_id",
        "entity_name",
        F.lit(window_hours).alias("window_hours"),
        F.when(enough, F.bround("recent_avg", 3)).alias("recent_sentiment"),
        F.when(enough, F.bround("previous_avg", 3)).alias("previous_sentiment"),
        F.bround("change", 1).alias("percent_change"),
        F.col("recent_count").alias("recent_sample_size"),
        F.col("previous_count").alias("previous_sample_size"),
        (F.abs("change") > fv.ALERT_PERCENT).alias("alert"),
        F.when(enough, F.when(F.col("change") > 0, "up").otherwise("down")).alias("direction"),
        F.when(~enough, "Insufficient data").alias("error"),
    )


def window_velocity(t: Tables, start, end, min_sample_size: int = 5) -> DataFrame:
    """First against second half of one window, per entity; the midpoint counts in both."""
    low, high = as_time(start), as_time(end)
    middle = F.timestamp_micros(F.shiftright(F.unix_micros(low) + F.unix_micros(high), 1))
    facts = signal_facts(t, "sentiment", low, high, with_entity=True)
    at = F.col("created_at")
    sides = _compare_halves(facts, in_window(at, low, middle), in_window(at, middle, high), ("first_half", "second_half"))
    counted = _entity_names(t).join(sides, "entity_id", "left").fillna(0, ["first_half_count", "second_half_count"])
    enough = (F.col("first_half_count") >= min_sample_size) & (F.col("second_half_count") >= min_sample_size)
    change = F.when(enough, percent_change(F.col("first_half_avg"), F.col("second_half_avg")))
    return counted.withColumn("change", change).select(
        "entity_id",
        "entity_name",
        F.concat(F.to_date(low).cast("string"), F.lit(" to "), F.to_date(high).cast("string")).alias("brief_window"),
        F.when(enough, F.bround("first_half_avg", 3)).alias("first_half_sentiment"),
        F.when(enough, F.bround("second_half_avg", 3)).alias("second_half_sentiment"),
        F.bround("change", 1).alias("percent_change"),
        F.when(enough, F.when(F.col("change") > 0, "up").otherwise("down")).alias("trending"),
        F.when(~enough, "Insufficient data for brief window").alias("error"),
    )


def emotion_distribution(t: Tables, as_of, days: int = 7) -> DataFrame:
    """Emotion counts per entity over the last ``days``."""
    facts = signal_facts(t, "emotion", after=_ago(as_of, days=days), with_entity=True, scored=False)
    return facts.groupBy("entity_id", F.col("value").alias("emotion")).agg(F.count(F.lit(1)).alias("count"))


def top_topics(t: Tables, as_of, days: int = 7, limit: int = 10) -> DataFrame:
    facts = signal_facts(t, "topic", after=_ago(as_of, days=days), scored=False)
    counts = facts.groupBy(F.col("value").alias("topic")).agg(F.count(F.lit(1)).alias("mentions"))
    return counts.orderBy(F.desc("mentions"), "topic").limit(limit)


def stance_breakdown(t: Tables, as_of, days: int = 7) -> DataFrame:
    """Support, oppose and neutral counts per entity; absent stances are 0."""
    facts = signal_facts(t, "stance", after=_ago(as_of, days=days), with_entity=True, scored=False)
    counts = facts.groupBy("entity_id").agg(
        *[F.count_if(F.col("value") == stance).alias(stance) for stance in fv.STANCES]
    )
    return t.monitored_entities.select("entity_id").join(counts, "entity_id", "left").fillna(0, fv.STANCES)


def sentiment_history(t: Tables, as_of, days: int = 30) -> DataFrame:
    """Daily average, distinct comments and likes per entity."""
    facts = signal_facts(t, "sentiment", after=_ago(as_of, days=days), with_entity=True)
    return facts.groupBy("entity_id", F.to_date("created_at").alias("date")).agg(
        F.avg("numeric_value").alias("avg_sentiment"),
        F.countDistinct("comment_id").alias("mention_count"),
        F.sum("likes").alias("total_likes"),
    )


def trend_feed(t: Tables, start, end, platforms=None, limit: int = fv.TREND_ENTITIES) -> DataFrame:
    """Daily history of the top entities of a window, for a trend chart."""
    top = top_entities(t, start, end, platforms, limit)
    facts = signal_facts(t, "sentiment", start, end, with_entity=True)
    named = facts.join(broadcast_top(top.select("entity_id", "entity_name")), "entity_id")
    return named.groupBy("entity_id", "entity_name", F.to_date("created_at").alias("date")).agg(
        F.avg("numeric_value").alias("avg_sentiment")
    )


def comment_count(t: Tables, start, end) -> DataFrame:
    return window_comments(t, start, end).agg(F.count(F.lit(1)).alias("comment_count"))


def entity_comparison(t: Tables, ids, start, end) -> DataFrame:
    """Side-by-side metrics of chosen entities, by name."""
    facts = only_entities(signal_facts(t, "sentiment", start, end, with_entity=True), ids)
    named = facts.join(broadcast_if_small(_entity_names(t)), "entity_id")
    return named.groupBy("entity_name").agg(
        F.countDistinct("comment_id").alias("mention_count"),
        F.avg("numeric_value").alias("avg_sentiment"),
        F.min("numeric_value").alias("min_sentiment"),
        F.max("numeric_value").alias("max_sentiment"),
        F.stddev_samp("numeric_value").alias("sentiment_stddev"),
        F.sum("likes").alias("total_likes"),
    )


def label_distribution(t: Tables, start, end, entity_id=None) -> DataFrame:
    """Sentiment signals per stored label, for all comments or one entity."""
    facts = signal_facts(t, "sentiment", start, end, scored=False)
    if entity_id is not None:
        facts = facts.filter(F.col("entity_id") == entity_id)
    return facts.groupBy(F.col("value").alias("sentiment_label")).agg(F.count(F.lit(1)).alias("count"))


# ------------------------------------------------------------- platforms


def platform_breakdown(t: Tables, start, end, platforms: list[str] | None = None) -> DataFrame:
    """Distinct scored comments, average score and likes per platform."""
    per_post = sentiment_rollup(t, start, end, ["post_id"], with_entity=False)
    return fold_rollup(with_platform(t, per_post, platforms), "platform").select(
        "platform",
        F.col("mention_count").alias("comment_count"),
        F.coalesce(average(), F.lit(0.0)).alias("avg_sentiment"),
        F.coalesce("total_likes", F.lit(0)).alias("total_likes"),
    )


def score_distribution(t: Tables, start, end, platforms: list[str] | None = None) -> DataFrame:
    """Positive, negative and neutral signals with their shares."""
    facts = signal_facts(t, "sentiment", start, end)
    level = sentiment_bucket(F.col("numeric_value"))
    kinds = ["positive", "negative", "neutral"]
    counts = [F.count_if(level == kind).alias(kind) for kind in kinds]
    if platforms:
        per_post = facts.groupBy("post_id").agg(*counts)
        facts = with_platform(t, per_post, platforms)
        counts = [F.coalesce(F.sum(kind), F.lit(0)).alias(kind) for kind in kinds]
    total = facts.agg(*counts).withColumn("total", F.expr("positive + negative + neutral"))
    return total.select(
        *kinds, "total", *[percent_of(F.col(k), F.col("total")).alias(f"{k}_pct") for k in kinds]
    )


def platform_deltas(t: Tables, start, end, entities: DataFrame) -> DataFrame:
    """Best and worst platform of each given entity with two or more platforms.

    ``entities`` holds ``entity_id`` and ``entity_name`` of a bounded top list.
    """
    rollup = sentiment_rollup(t, start, end, ["entity_id", "post_id"])
    listed = rollup.join(broadcast_top(entities.select("entity_id", "entity_name")), "entity_id")
    split = fold_rollup(with_platform(t, listed), "entity_id", "entity_name", "platform")
    scored = split.select("entity_id", "entity_name", "platform", average().alias("score"))
    sides = scored.groupBy("entity_id", "entity_name").agg(
        F.count(F.lit(1)).alias("n_platforms"),
        F.min(F.struct((-F.col("score")).alias("k"), "platform", "score")).alias("best"),
        F.min(F.struct(F.col("score").alias("k"), "platform", "score")).alias("worst"),
    )
    return sides.filter("n_platforms >= 2").select(
        "entity_id",
        "entity_name",
        F.col("best.platform").alias("best_platform"),
        F.col("best.score").alias("best_sentiment"),
        F.col("worst.platform").alias("worst_platform"),
        F.col("worst.score").alias("worst_sentiment"),
        (F.col("best.score") - F.col("worst.score")).alias("delta"),
    )


# ----------------------------------------------------------------- posts


def top_posts(t: Tables, start, end, limit: int = 10, platform: str | None = None) -> DataFrame:
    """Posts by comment volume with likes, average sentiment and top entity.

    Comments are counted per post first, so a viral post is one row before
    anything is joined. The ranking moves ids and counts only and is staged once
    (``limit`` rows); captions and the follow-up aggregates are read for the kept
    posts alone.
    """
    volume = window_comments(t, start, end).groupBy("post_id").agg(
        F.count(F.lit(1)).alias("comment_count"), F.sum("likes").alias("total_likes")
    )
    known = t.posts.select("post_id", "platform")
    if platform:
        known = known.filter(F.col("platform") == platform)
    order = [F.desc("comment_count"), F.asc("post_id")]
    kept = volume.join(known.select("post_id"), "post_id").orderBy(*order).limit(limit)
    kept = checkpointed(kept.select("*", F.row_number().over(Window.orderBy(*order)).alias("rank")))
    top = t.posts.select("post_id", "platform", "url", "caption").join(broadcast_top(kept), "post_id")

    facts = signal_facts(t, "sentiment", start, end, scored=False).join(
        broadcast_top(kept.select("post_id")), "post_id", "left_semi"
    )
    per_entity = facts.groupBy("post_id", "entity_id").agg(
        F.sum("numeric_value").alias("sum_score"),
        F.count("numeric_value").alias("n_scored"),
        F.count(F.lit(1)).alias("n_signals"),
    )
    named = per_entity.join(_entity_names(t), "entity_id", "left")
    summary = named.groupBy("post_id").agg(
        F.try_divide(F.sum("sum_score"), F.sum("n_scored")).alias("avg"),
        F.min(
            F.when(F.col("entity_name").isNotNull(), F.struct((-F.col("n_signals")).alias("k"), "entity_name"))
        ).alias("most"),
    )
    subject = caption_entity(t, top.select("post_id", "caption"))
    return (
        top.join(F.broadcast(summary), "post_id", "left")
        .join(F.broadcast(subject), "post_id", "left")
        .select(
            "rank", "post_id", "platform", "url",
            caption_preview(F.col("caption")).alias("caption"),
            "comment_count",
            F.coalesce("total_likes", F.lit(0)).alias("total_likes"),
            F.bround(F.coalesce("avg", F.lit(0.0)), 2).alias("avg_sentiment"),
            F.coalesce("caption_entity", F.col("most.entity_name")).alias("top_entity"),
        )
    )


def caption_entity(t: Tables, posts: DataFrame) -> DataFrame:
    """The first entity in catalog order named in each post's caption."""
    entities = t.active_entities
    order = F.col("load_order") if "load_order" in entities.columns else F.col("entity_id")
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))) \
        if "aliases" in entities.columns else F.array("name")
    terms = entities.select(
        order.alias("ord"), "name", F.explode(names).alias("term")
    ).select("ord", "name", F.lower("term").alias("term")).filter("term <> ''")
    hits = find_terms(posts.select("post_id", "caption"), "caption", terms)
    return hits.groupBy("post_id").agg(F.min(F.struct("ord", "name")).alias("first")).select(
        "post_id", F.col("first.name").alias("caption_entity")
    )


def post_scores(t: Tables, start, end, min_signals: int = 5) -> DataFrame:
    """Average sentiment of posts with enough sentiment signals."""
    facts = signal_facts(t, "sentiment", start, end, scored=False)
    per_post = facts.groupBy("post_id").agg(
        F.avg("numeric_value").alias("avg_score"), F.count(F.lit(1)).alias("comment_count")
    ).filter(F.col("comment_count") >= min_signals)
    return per_post.withColumn("avg_score", F.coalesce("avg_score", F.lit(0.0)))


def post_distribution(t: Tables, start, end, min_signals: int = 5) -> DataFrame:
    """Posts per sentiment bucket, and the most positive and negative post."""
    scored = post_scores(t, start, end, min_signals)
    level = sentiment_bucket(F.col("avg_score"))
    row = F.struct("post_id", F.bround("avg_score", 2).alias("avg_sentiment"), "comment_count")
    found = scored.agg(
        F.count_if(level == "positive").alias("positive_posts"),
        F.count_if(level == "neutral").alias("neutral_posts"),
        F.count_if(level == "negative").alias("negative_posts"),
        F.count(F.lit(1)).alias("total_posts"),
        F.min(F.struct((-F.col("avg_score")).alias("k"), "post_id", row.alias("post"))).alias("high"),
        F.min(F.struct(F.col("avg_score").alias("k"), "post_id", row.alias("post"))).alias("low"),
    )
    out = found.select(
        "positive_posts", "neutral_posts", "negative_posts", "total_posts",
        *[
            F.col(f"{side}.post.{name}").alias(f"most_{word}_{name}")
            for side, word in (("high", "positive"), ("low", "negative"))
            for name in ("post_id", "avg_sentiment", "comment_count")
        ],
    )
    posts = t.posts.select("post_id", "url", clip(F.col("caption"), 100).alias("caption"))
    for word in ("positive", "negative"):
        named = posts.select(*[F.col(c).alias(f"most_{word}_{c}") for c in posts.columns])
        named = named.withColumnRenamed(f"most_{word}_post_id", "k")
        out = out.join(named, F.col(f"most_{word}_post_id") == F.col("k"), "left").drop("k")
    return out


# -------------------------------------------------------- comments and lists


def toxicity_alerts(
    t: Tables, as_of, threshold: float = 0.7, days: int = 7, limit: int = 50
) -> DataFrame:
    """Comments above a toxicity threshold, worst and most liked first."""
    after = _ago(as_of, days=days)
    toxic = signal_facts(t, "toxicity", after=after).filter(F.col("numeric_value") >= threshold)
    top = toxic.orderBy(F.desc("numeric_value"), F.desc_nulls_last("likes"), "comment_id").limit(limit)
    # Text and url are fetched for the kept rows only, which are staged once (``limit`` rows).
    top = checkpointed(top)
    detail = _of_these(window_comments(t, after=after), top).select("comment_id", "text", F.col("author_name").alias("author"))
    urls = t.posts.select("post_id", F.col("url").alias("post_url"))
    shown = detail.join(broadcast_top(top), "comment_id")
    return (
        urls.join(broadcast_top(shown), "post_id")
        .select(
            "comment_id", clip(F.col("text"), 200).alias("text"), "author", "likes",
            F.col("numeric_value").alias("toxicity"), "post_url",
        )
        .orderBy(F.desc("toxicity"), F.desc_nulls_last("likes"), "comment_id")
    )


def _few_per_entity(best: DataFrame, entities: DataFrame, per_entity: int) -> DataFrame:
    """Broadcast a top-k per entity when the counted catalog bounds its size.

    The texts it is joined to then stay where they are.
    """
    return F.broadcast(best) if within(entities, SMALL_ROWS // max(per_entity, 1)) else best


def _of_these(comments: DataFrame, few: DataFrame) -> DataFrame:
    """The comments of ``few``, staged rows of a bounded number.

    Their posts are named too: texts that are stored with posts are then filtered
    before a join moves them.
    """
    ids, posts = (few.agg(F.collect_set(c).alias("ids")).scalar() for c in ("comment_id", "post_id"))
    of_post = F.array_contains(posts, F.col("post_id")) | F.col("post_id").isNull()
    return comments.filter(F.array_contains(ids, F.col("comment_id")) & of_post)


def top_comments(t: Tables, per_entity: int = 3, entities: DataFrame | None = None, stage: bool = False) -> DataFrame:
    """The most liked comments of each entity, newest first among equals.

    Ranking runs on ids; the planner keeps ``per_entity`` rows per entity in
    every task before the shuffle. Text is joined to the winners only; with ``stage``
    winners of few entities are written first, so that texts of no others are moved.
    """
    facts = signal_facts(t, "sentiment", with_entity=True)
    if entities is not None:
        facts = facts.join(broadcast_top(entities.select("entity_id")), "entity_id", "left_semi")
    order = Window.partitionBy("entity_id").orderBy(
        F.desc_nulls_last("likes"), F.desc("created_at"), "comment_id"
    )
    best = facts.select("entity_id", "comment_id", "post_id", "likes", "created_at").withColumn(
        "rank", F.row_number().over(order)
    ).filter(F.col("rank") <= per_entity)
    known = entities if entities is not None else t.monitored_entities
    comments = t.comments
    if stage and within(known, SMALL_ROWS // max(per_entity, 1)):
        best = F.broadcast(checkpointed(best))
        comments = _of_these(comments, best)
    else:
        best = _few_per_entity(best, known, per_entity)
    return comments.select("comment_id", "text").join(best.drop("post_id"), "comment_id").select(
        "entity_id", "rank", "comment_id", F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("likes", F.lit(0)).alias("likes"), "created_at",
    )


def entity_comments(t: Tables, per_entity: int = 10) -> DataFrame:
    """Distinct comments of each entity with their post's caption, by likes."""
    facts = signal_facts(t, "sentiment", with_entity=True, scored=False)
    distinct = facts.groupBy("entity_id", "comment_id", "post_id", "created_at", "likes").agg(
        F.count(F.lit(1)).alias("n_signals")
    )
    order = Window.partitionBy("entity_id").orderBy(
        F.desc_nulls_last("likes"), F.desc("created_at"), "comment_id"
    )
    best = distinct.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_entity)
    best = _few_per_entity(best, t.monitored_entities, per_entity)
    shown = t.comments.select("comment_id", "text", "author_name").join(best, "comment_id")
    return (
        t.posts.select("post_id", "caption")
        .join(_few_per_entity(shown, t.monitored_entities, per_entity), "post_id")
        .select("entity_id", "rank", "comment_id", "author_name", "text", "likes", "created_at", "caption")
    )


def discovered_list(
    t: Tables, min_mentions: int = 5, reviewed: bool | None = False, limit: int = 50
) -> DataFrame:
    """Discovered names by mentions; ``reviewed=None`` lists all of them."""
    found = t.discovered_entities.filter(F.col("mention_count") >= min_mentions)
    if reviewed is not None:
        found = found.filter(F.col("reviewed") == reviewed)
    return found.select(
        "name", "entity_type", "mention_count", "first_seen_at", "last_seen_at", "sample_mentions"
    ).orderBy(F.desc("mention_count"), "name").limit(limit)


def name_suggestions(t: Tables, query: str, limit: int = 5) -> DataFrame:
    """Active entities whose name contains the query, ignoring case."""
    hit = F.contains(F.lower("name"), F.lit(query.lower()))
    return t.active_entities.filter(hit).select("name").orderBy("name").limit(limit)
