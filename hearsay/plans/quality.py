"""Counts, completeness, metric roll-ups and score checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.functions.labels import completeness_band
from hearsay.plans.analytics import top_entities
from hearsay.session import checkpointed
from hearsay.tables import Tables

KEPT_VALUES = 1000


def table_counts(t: Tables) -> DataFrame:
    """Rows of the stored tables and the number of comments with signals."""
    counted = [
        ("posts", t.posts), ("comments", t.comments), ("monitored_entities", t.monitored_entities),
        ("extracted_signals", t.extracted_signals), ("discovered_entities", t.discovered_entities),
    ]
    rows = [
        df.agg(F.count(F.lit(1)).alias("count")).select(F.lit(name).alias("table"), "count")
        for name, df in counted if df is not None
    ]
    enriched = t.extracted_signals.agg(F.countDistinct("comment_id").alias("count"))
    out = enriched.select(F.lit("enriched_comments").alias("table"), "count")
    for row in rows:
        out = out.unionByName(row)
    return out


def completeness(t: Tables) -> DataFrame:
    """Share of comments with signals, and its band."""
    total = t.comments.agg(F.count(F.lit(1)).alias("n")).scalar()
    enriched = t.extracted_signals.agg(F.countDistinct("comment_id").alias("enriched_comments"))
    share = F.coalesce(F.try_divide(F.col("enriched_comments") * F.lit(100.0), F.col("total_comments")), F.lit(0.0))
    return enriched.withColumn("total_comments", total).withColumn("percent", share).select(
        "total_comments", "enriched_comments",
        F.greatest(F.col("total_comments") - F.col("enriched_comments"), F.lit(0)).alias("pending_comments"),
        F.bround("percent", 1).alias("percent"), completeness_band(F.col("percent")).alias("band"),
    )


def signal_breakdown(t: Tables) -> DataFrame:
    return t.extracted_signals.groupBy("signal_type").agg(F.count(F.lit(1)).alias("count"))


def freshness(t: Tables) -> DataFrame:
    """Row counts and the time of the latest comment."""
    posts = t.posts.agg(F.count(F.lit(1)).alias("n")).scalar()
    signals = t.extracted_signals.agg(F.count(F.lit(1)).alias("n")).scalar()
    latest = t.comments.agg(F.count(F.lit(1)).alias("comments"), F.max("created_at").alias("latest_comment"))
    return latest.withColumn("posts", posts).withColumn("signals", signals)


# ----------------------------------------------------------------- metrics


def latest_values(metrics: DataFrame, kept: int = KEPT_VALUES) -> DataFrame:
    """A report of the last ``kept`` values of every metric."""
    order = Window.partitionBy("metric").orderBy(F.desc("at"), F.desc("value"))
    return metrics.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= kept).drop("_n")


def metric_summary(metrics: DataFrame, kept: int | None = None) -> DataFrame:
    """Count, mean, extremes and floor-index percentiles of all values, or of the latest ``kept`` of each metric.

    Equal values are counted first. The distinct values are sorted over all tasks and
    their counts added up in two steps, within tasks and over the tasks' totals, so no
    task holds a whole metric. NULL values are left out.
    """
    values = (metrics if kept is None else latest_values(metrics, kept)).filter("value is not null")
    counted = values.groupBy("metric", "value").agg(F.count(F.lit(1)).alias("n"))
    # Staged, for which task holds a value has to stay the same.
    ranged = checkpointed(counted.repartitionByRange("metric", "value").withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy("metric", "part").agg(F.sum("n").alias("part_n"))
    before = Window.partitionBy("metric").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("part_n").over(before), F.lit(0))).drop("part_n")
    totals = values.groupBy("metric").agg(
        F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    within = Window.partitionBy("metric", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.join(parts, ["metric", "part"]).withColumn("upto", F.col("before") + F.sum("n").over(within)).join(totals, "metric")

    def at(share: float) -> Column:
        index = F.floor(F.col("count") * F.lit(share))
        return F.max(F.when((F.col("upto") > index) & (F.col("upto") - F.col("n") <= index), F.col("value")))

    return placed.groupBy("metric", "count", "mean", "min", "max").agg(at(0.50).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def counters(metrics: DataFrame) -> DataFrame:
    """Sum of the increments of each counter."""
    return metrics.groupBy("metric").agg(F.sum("value").alias("total"))


# --------------------------------------------------------------- overviews


def overview(t: Tables, start, end, platforms=None, limit: int = 20) -> DataFrame:
    """Headline figures over the top entities of a window."""
    top = top_entities(t, start, end, platforms, limit)
    return top.agg(
        F.count(F.lit(1)).alias("entities"),
        F.avg("avg_sentiment").alias("avg_sentiment"),
        F.sum("total_likes").alias("total_likes"),
        F.min(F.struct((-F.col("mention_count")).alias("k"), "entity_id", "entity_name")).alias("first"),
    ).select("entities", "avg_sentiment", "total_likes", F.col("first.entity_name").alias("top_entity"))


def history_summary(history: DataFrame) -> DataFrame:
    """Mean of the daily averages, total mentions and likes, per entity."""
    return history.groupBy("entity_id").agg(
        F.avg("avg_sentiment").alias("avg_sentiment"),
        F.sum("mention_count").alias("total_mentions"),
        F.sum("total_likes").alias("total_likes"),
    )


def quadrants(entities: DataFrame) -> DataFrame:
    """Entities split by median volume and the sign of their sentiment."""
    median = entities.agg(F.percentile("mention_count", F.lit(0.5)).alias("m")).scalar()
    high = F.col("mention_count") >= F.col("median_mentions")
    good = F.col("avg_sentiment") >= 0
    name = F.concat(
        F.when(high, "High Volume").otherwise("Low Volume"), F.lit(" "),
        F.when(good, "Positive").otherwise("Negative"),
    )
    return entities.withColumn("median_mentions", median).withColumn("quadrant", name)


# ------------------------------------------------------------- score checks


def analysis_totals(analyses: DataFrame, high_toxicity: float = 0.5) -> DataFrame:
    a = "analysis"
    return analyses.agg(
        F.count(F.lit(1)).alias("responses"),
        F.count_if(F.size(f"{a}.entity_scores") > 0).alias("with_entity_scores"),
        F.count_if("recovered").alias("recovered"),
        F.avg(f"{a}.toxicity").alias("avg_toxicity"),
        F.max(f"{a}.toxicity").alias("max_toxicity"),
        F.count_if(F.col(f"{a}.toxicity") > high_toxicity).alias("high_toxicity"),
    )


def label_counts(analyses: DataFrame) -> DataFrame:
    """How often each emotion, stance and number of scored entities occurs."""
    kinds = F.array(
        F.struct(F.lit("emotion").alias("kind"), F.col("analysis.emotion").alias("label")),
        F.struct(F.lit("stance").alias("kind"), F.col("analysis.stance").alias("label")),
        F.struct(F.lit("entities").alias("kind"), F.size("analysis.entity_scores").cast("string").alias("label")),
    )
    return analyses.select(F.explode(kinds).alias("k")).groupBy("k.kind", "k.label").agg(
        F.count(F.lit(1)).alias("count")
    )


def scored_name_stats(analyses: DataFrame, low: float = -0.5) -> DataFrame:
    """Count, average, extremes and share of low scores of each scored name."""
    # explode_outer: an inferred "map is not empty" filter would parse responses twice.
    scores = analyses.select(F.explode_outer("analysis.entity_scores").alias("entity_name", "score")).filter(
        F.col("entity_name").isNotNull()
    )
    return scores.groupBy("entity_name").agg(
        F.count(F.lit(1)).alias("scores"),
        F.avg("score").alias("avg_score"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
        F.count_if(F.col("score") < low).alias("low_scores"),
        F.bround(F.try_divide(F.count_if(F.col("score") < low) * F.lit(100.0), F.count(F.lit(1))), 1).alias("low_pct"),
    )
