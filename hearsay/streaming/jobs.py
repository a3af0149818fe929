"""The live jobs. Each takes a streaming DataFrame and ends in a started query
or in a streaming result; tests run them with ``availableNow``.

Every sink is idempotent: merges are keyed on natural ids, and appended results
are written per batch id, so a batch replayed after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hearsay.functions.numbers import percent_change
from hearsay.functions.text import clip
from hearsay.operators.enrich import rule_signals
from hearsay.operators.merge import apply_comments, apply_posts, apply_signals, post_records
from hearsay.operators.run import enrich
from hearsay.tables import read_tables


def _start(df: DataFrame, batch, checkpoint: str, mode: str = "append", **trigger) -> StreamingQuery:
    return (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(batch)
        .start()
    )


def ingest_stream(
    records: DataFrame, root: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Merge raw comment records into the stored posts and comments.

    The merge is idempotent and rewrites only the touched partitions, so records
    need no watermark: late ones and likes that return to an earlier value count.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        held = batch.persist()
        try:
            stored = read_tables(spark, root, ["posts", "comments"])
            apply_posts(root, stored.posts, post_records(held))
            apply_comments(root, stored.comments, held)
        finally:
            held.unpersist()

    return _start(records, merge, checkpoint, **trigger)


def enrich_stream(
    comments: DataFrame, entities: DataFrame, posts: DataFrame | None, root: str, checkpoint: str,
    run_ts: Column, **trigger,
) -> StreamingQuery:
    """Match and score new comments against a static catalog and merge the signals.

    A comment that a batch delivers more than once counts once.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        held = batch.dropDuplicates(["comment_id"]).persist()
        try:
            days = held.select("comment_id", F.to_date("created_at").alias("comment_date"))
            signals = rule_signals(held, entities, posts, run_ts).join(days, "comment_id")
            stored = read_tables(spark, root, ["extracted_signals"]).extracted_signals
            apply_signals(root, stored, signals)
        finally:
            held.unpersist()

    return _start(comments, merge, checkpoint, **trigger)


def response_stream(
    comments: DataFrame, responses: DataFrame, entities: DataFrame, posts: DataFrame, root: str, checkpoint: str,
    run_ts: Column, source_model: str, name: str = "responses", wait: str = "1 hour", delay: str = "10 minutes", **trigger,
) -> StreamingQuery:
    """Join live comments to the responses that follow them, and enrich both into the stored tables.

    ``comments`` as in ``enrich``; ``responses``: comment_id, raw_json, responded_at. A response counts if it
    comes within ``wait`` of its comment; a comment that has none by then, or a late one, gets the neutral analysis once the
    watermark shows it. Of two deliveries of a comment or a response the first counts. Rows that arrive
    more than ``delay`` behind their stream may be left out, as may rows without id or time.
    Each batch is a named run, so a batch replayed after a failure changes nothing.
    """
    said = comments.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["comment_id"])
    answers = responses.select(F.col("comment_id").alias("_answered"), "raw_json", "responded_at")
    answers = answers.withWatermark("responded_at", delay).dropDuplicatesWithinWatermark(["_answered"])
    near = (F.col("comment_id") == F.col("_answered")) & (F.col("responded_at") >= F.col("created_at")) & (
        F.col("responded_at") <= F.col("created_at") + F.expr(f"INTERVAL {wait}")
    )
    joined = said.join(answers, near, "left_outer").drop("_answered", "responded_at")

    def merge(batch: DataFrame, batch_id: int) -> None:
        enrich(batch, None, entities, posts, root, f"{name}-{batch_id}", run_ts, source_model)

    return _start(joined, merge, checkpoint, **trigger)


def append_batches(df: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append results as files; the file sink commits each batch once."""
    return (
        df.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def toxicity_stream(facts: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Toxicity signals at or above the threshold, as they arrive (stateless)."""
    toxic = (F.col("signal_type") == "toxicity") & (F.col("numeric_value") >= threshold)
    text = [clip(F.col("text"), 200).alias("text")] if "text" in facts.columns else []
    return facts.filter(toxic).select(
        "comment_id", *text, "likes", F.col("numeric_value").alias("toxicity"), "created_at"
    )


def _entity_sentiment(facts: DataFrame, delay: str) -> DataFrame:
    scored = facts.filter(
        (F.col("signal_type") == "sentiment") & F.col("entity_id").isNotNull() & F.col("numeric_value").isNotNull()
    )
    return scored.withWatermark("created_at", delay)


def daily_history_stream(facts: DataFrame, delay: str = "1 day") -> DataFrame:
    """Daily average, distinct comments and likes per entity, once a day is closed.

    Two chained window aggregations: the first has one row per comment, so the
    second counts distinct comments exactly.
    """
    per_comment = (
        _entity_sentiment(facts, delay)
        .groupBy(F.window("created_at", "1 day"), "entity_id", "comment_id")
        .agg(F.sum("numeric_value").alias("s"), F.count(F.lit(1)).alias("n"), F.sum("likes").alias("l"))
    )
    per_day = per_comment.groupBy(F.window(F.window_time("window"), "1 day"), "entity_id").agg(
        F.sum("s").alias("s"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("mention_count"),
        F.sum("l").alias("total_likes"),
    )
    return per_day.select(
        "entity_id", F.to_date("window.start").alias("date"), F.try_divide("s", "n").alias("avg_sentiment"),
        "mention_count", "total_likes",
    )


def hourly_sums(facts: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Sum and count per entity and hour ``window``, which keeps the watermark."""
    return _entity_sentiment(facts, delay).groupBy(F.window("created_at", "1 hour"), "entity_id").agg(
        F.sum("numeric_value").alias("sum_score"), F.count(F.lit(1)).alias("n")
    )


def hourly_sentiment_stream(facts: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Hourly sums per entity: the small state from which any window is rolled up.

    Sliding 72-hour windows would hold every signal in 72 of them; one tumbling
    hour per signal carries the same information.
    """
    return hourly_sums(facts, delay).select("entity_id", F.col("window.start").alias("hour"), "sum_score", "n")


def velocity_from_hours(
    hourly: DataFrame, window_hours: int = 72, min_sample_size: int = 10, alert_percent: float = 30
) -> DataFrame:
    """Velocity at the end of every hour, from the hourly sums.

    Rolling sums run over hours, not signals; an entity has 8,760 hours a year.
    """
    at = F.unix_seconds("hour")
    hour = 3600
    by_entity = Window.partitionBy("entity_id").orderBy(at)
    recent = by_entity.rangeBetween(-(window_hours - 1) * hour, 0)
    previous = by_entity.rangeBetween(-(2 * window_hours - 1) * hour, -window_hours * hour)
    rolled = hourly.select(
        "entity_id", "hour",
        F.try_divide(F.sum("sum_score").over(recent), F.sum("n").over(recent)).alias("recent_avg"),
        F.sum("n").over(recent).alias("recent_count"),
        F.try_divide(F.sum("sum_score").over(previous), F.sum("n").over(previous)).alias("previous_avg"),
        F.coalesce(F.sum("n").over(previous), F.lit(0)).alias("previous_count"),
    )
    enough = (F.col("recent_count") >= min_sample_size) & (F.col("previous_count") >= min_sample_size)
    return velocity_columns(rolled.filter(enough), alert_percent)


def velocity_columns(rolled: DataFrame, alert_percent: float, *keep: str) -> DataFrame:
    """The comparison of two windows that end with ``hour``, from their averages and counts."""
    change = percent_change(F.col("previous_avg"), F.col("recent_avg"))
    return rolled.withColumn("change", change).select(
        "entity_id", (F.col("hour") + F.expr("INTERVAL 1 HOUR")).alias("as_of"),
        F.bround("recent_avg", 3).alias("recent_sentiment"), F.bround("previous_avg", 3).alias("previous_sentiment"),
        F.bround("change", 1).alias("percent_change"), "recent_count", "previous_count",
        (F.abs("change") > alert_percent).alias("alert"),
        F.when(F.col("change") > 0, "up").otherwise("down").alias("direction"),
        *keep,
    )
