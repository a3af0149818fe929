"""The period brief: a set of small sections over one staged fact join."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay import fixed_values as fv
from hearsay.functions import sentences as say
from hearsay.functions.labels import sentiment_label, trend_label, velocity_phrase, velocity_status
from hearsay.functions.text import quote_sample
from hearsay.plans import analytics as an
from hearsay.plans.discovery import dynamic_entities, resolve_promoted
from hearsay.plans.facts import stage_facts
from hearsay.plans.storylines import storylines
from hearsay.schemas import struct
from hearsay.session import checkpointed
from hearsay.tables import Tables

# --- fixed values: section titles ---
TITLES = {
    "top_entities": "Top Entities by Volume",
    "velocity_alerts": "Sentiment Velocity Alerts",
    "discovered_entities": "Discovered Entities",
    "platform_breakdown": "Platform Breakdown",
    "sentiment_distribution": "Sentiment Distribution",
    "contextual_narrative": "Contextual Narrative",
    "entity_comparison": "Entity Comparison",
    "what_changed": "What Changed This Week",
    "cross_platform_deltas": "Cross-Platform Deltas",
    "key_risks": "Key Risks & Watchouts",
    "entity_micro_insights": "Entity Micro-Insights",
    "emotion_analysis": "Emotion Analysis",
    "topic_clusters": "Topic Clusters",
    "toxicity_alerts": "Toxicity Alerts",
    "stance_summary": "Stance Summary",
    "post_performance": "Top Posts This Week",
    "storylines": "Active Storylines",
    "risk_signals": "Risk Signals",
    "topline_summary": "Topline Summary",
}
# --- fixed values: summaries of sections by their number of items, and of sections without any ---
SUMMARIES = {
    "velocity_alerts": ("%d entities with significant sentiment shifts (30%%+ change in 72hrs)", None),
    "discovered_entities": ("%d new entities discovered by NLP (not yet in monitoring)", None),
    "platform_breakdown": ("Comment volume and sentiment by platform", None),
    "entity_comparison": ("Top entities ranked by mention volume and sentiment", "No comparison data available"),
    "cross_platform_deltas": ("Platform-specific sentiment analysis for %d top entities", None),
    "key_risks": ("%d actionable risks identified", None),
    "emotion_analysis": ("Emotion analysis for top %d entities", "No emotion signals found"),
    "topic_clusters": ("%d trending topics identified", "No topic signals found"),
    "stance_summary": ("Stance breakdown for top %d entities", "No stance signals found"),
    "risk_signals": ("Risk signal detection not yet implemented", None),
}
RISK_SIGNALS = struct("risk string, severity string, type string")


def _moment(value) -> datetime:
    return value if isinstance(value, datetime) else datetime.fromisoformat(str(value))


def window_days(start, end) -> int:
    """Whole days of a window; a window below one day counts as 30."""
    return (_moment(end) - _moment(start)).days or 30


def ranked(top: DataFrame) -> DataFrame:
    """Number a bounded ranking from 1 in its own order."""
    order = Window.orderBy(F.desc("mention_count"), F.desc("is_monitored"), "entity_id", "entity_name")
    return top.withColumn("rank", F.row_number().over(order))


def velocity_alerts(t: Tables, top: DataFrame, as_of, keep: int = fv.MAX_VELOCITY_ALERTS) -> DataFrame:
    """Alerts among the ten top entities, the biggest swing first."""
    checked = resolve_promoted(t, top.filter(F.col("rank") <= 10)).filter("entity_id is not null")
    # The catalog is small, and the kept entities are at most ten.
    moved = an.velocity(t, as_of).filter("alert").drop("entity_name")
    joined = moved.join(F.broadcast(checked.select("entity_id", "entity_name", "rank")), "entity_id")
    order = Window.orderBy(F.desc(F.abs("percent_change")), "rank")
    kept = joined.orderBy(F.desc(F.abs("percent_change")), "rank").limit(keep)
    change, recent, previous = F.col("percent_change"), F.col("recent_sentiment"), F.col("previous_sentiment")
    return kept.select(
        F.row_number().over(order).alias("alert_rank"), "entity_id", "entity_name", "window_hours",
        "recent_sentiment", "previous_sentiment", "percent_change", "recent_sample_size",
        "previous_sample_size", "direction",
        velocity_status(change, recent, previous).alias("status"),
        velocity_phrase(change, recent, previous).alias("direction_phrase"),
        say.alert_text(F.col("entity_name"), change, previous, recent).alias("narrative"),
    )


def entity_comparison(top: DataFrame, limit: int = 5) -> DataFrame:
    return top.filter(F.col("rank") <= limit).select(
        "rank", "entity_name", F.col("avg_sentiment").alias("current_sentiment"), "mention_count",
        trend_label(F.col("avg_sentiment")).alias("trend"),
    )


def _with_alerts(top: DataFrame, alerts: DataFrame) -> DataFrame:
    moved = alerts.select("entity_name", "alert_rank", "percent_change", "recent_sentiment")
    return top.join(F.broadcast(moved), "entity_name", "left")


def _changes(top: DataFrame, alerts: DataFrame) -> DataFrame:
    """Every riser, faller, new negative and positive entity and surprising shift, numbered by kind."""
    change, score = F.col("percent_change"), F.col("avg_sentiment")
    riser = F.coalesce(change > fv.ALERT_PERCENT, F.lit(False))
    faller = F.coalesce(change < -fv.ALERT_PERCENT, F.lit(False))
    surprise = F.coalesce((F.col("mention_count") > 500) & (F.abs(change) > fv.CRITICAL_PERCENT), F.lit(False))
    mentions = F.concat(F.col("mention_count").cast("string"), F.lit(" mentions"))
    current = F.concat(F.lit("Sentiment: "), say.signed(F.col("recent_sentiment")))
    percent = F.concat(say.signed(change, 1), F.lit("%"))

    def entry(when, place, category, keep, order, metric, detail):
        return F.when(when, F.struct(
            F.lit(place).alias("place"), F.lit(category).alias("category"), F.lit(keep).alias("keep"),
            order.cast("int").alias("order"), metric.alias("metric"), detail.alias("detail")))

    by_alert, by_rank = F.col("alert_rank"), F.col("rank")
    entries = F.array_compact(F.array(
        entry(riser, 1, "Top Riser", 3, by_alert, percent, current),
        entry(faller, 2, "Top Faller", 3, by_alert, percent, current),
        entry((score < -0.3) & ~riser & ~faller, 3, "New Negative", 2, by_rank, say.signed(score), mentions),
        entry((score > 0.5) & ~riser, 4, "New Positive", 2, by_rank, say.signed(score), mentions),
        entry(surprise, 5, "Surprising Shift", 2, by_alert, percent, mentions),
    ))
    rows = _with_alerts(top, alerts).select("entity_name", F.explode(entries).alias("e")).select("entity_name", "e.*")
    nth = F.row_number().over(Window.partitionBy("place").orderBy("order"))
    return rows.withColumn("nth", nth)


def what_changed(top: DataFrame, alerts: DataFrame) -> DataFrame:
    """The first risers, fallers, new negative and positive entities and surprising shifts."""
    return _changes(top, alerts).filter("nth <= keep").select(
        "place", "nth", "category", F.col("entity_name").alias("entity"), "metric", "detail"
    )


def change_summary(top: DataFrame, alerts: DataFrame) -> DataFrame:
    """How many changes of each kind there are, shown or not."""
    n = [F.count_if(F.col("place") == place) for place in (1, 2, 3, 4)]
    known = top.agg(F.count(F.lit(1)).alias("n")).scalar()
    text = F.format_string("%d risers, %d fallers, %d new negative trends, %d new positive narratives", *n)
    return _changes(top, alerts).agg(text.alias("_text")).select(
        F.when(known > 0, F.col("_text")).otherwise("No entity data available").alias("summary"))


def top_summary(top: DataFrame) -> DataFrame:
    return top.agg(F.min(F.struct("rank", "entity_name", "mention_count", "avg_sentiment")).alias("f")).select(
        F.when(F.col("f").isNull(), say.NO_ACTIVITY).otherwise(
            say.headline(F.col("f.entity_name"), F.col("f.mention_count"), F.col("f.avg_sentiment"))).alias("summary"))


def toxicity_summary(alerts: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return alerts.agg(F.when(n > 0, F.format_string("%d high-toxicity comments (threshold: 0.7)", n)).otherwise(
        "No high-toxicity comments detected").alias("summary"))


def storyline_summary(found: DataFrame, comments: DataFrame) -> DataFrame:
    """``comments`` has the number of comments that were searched."""
    searched = comments.select("comment_count").scalar()
    n = F.count(F.lit(1))
    return found.agg(n.alias("n")).select(
        F.when(searched == 0, "No high-engagement comments found for storyline detection")
        .when(F.col("n") == 0, "No clear storylines detected in high-engagement comments")
        .otherwise(F.format_string("%d storylines detected from %d high-engagement comments", "n", searched)).alias("summary"))


class Sections(dict[str, DataFrame]):
    """The sections of a brief by name, and one-row frames (``summary``) of those that items alone do not tell."""

    def __init__(self, sections: dict[str, DataFrame], summaries: dict[str, DataFrame]):
        super().__init__(sections)
        self.summaries = summaries


def key_risks(top: DataFrame, alerts: DataFrame, platforms: DataFrame, keep: int = 5) -> DataFrame:
    """Critical swings first, then fragile entities and a negative platform."""
    critical = alerts.filter(F.abs("percent_change") > fv.CRITICAL_PERCENT).select(
        F.lit(0).alias("place"), F.col("alert_rank").alias("nth"),
        say.velocity_risk(F.col("entity_name"), F.col("percent_change")).alias("risk"),
        F.lit("critical").alias("severity"), F.lit("velocity").alias("type"),
    )
    score = F.col("avg_sentiment")
    fragile = top.filter((score > -0.6) & (score < -0.3) & (F.col("mention_count") > 200)).select(
        F.lit(1).alias("place"), F.col("rank").alias("nth"),
        say.fragile_risk(F.col("entity_name"), score, F.col("mention_count")).alias("risk"),
        F.lit("warning").alias("severity"), F.lit("fragile").alias("type"),
    )
    worst = platforms.agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("avg_sentiment", "platform", "comment_count")).alias("w")
    ).filter("n >= 2 and w.avg_sentiment < -0.2").select(
        F.lit(2).alias("place"), F.lit(1).alias("nth"),
        say.platform_risk(F.col("w.platform"), F.col("w.avg_sentiment"), F.col("w.comment_count")).alias("risk"),
        F.lit("warning").alias("severity"), F.lit("platform").alias("type"),
    )
    return critical.unionByName(fragile).unionByName(worst).orderBy("place", "nth").limit(keep)


def micro_insights(top: DataFrame, alerts: DataFrame) -> DataFrame:
    return _with_alerts(top, alerts).select(
        "rank", "entity_name",
        say.micro_insight(F.col("avg_sentiment"), F.col("mention_count"), F.col("total_likes"), F.col("percent_change")).alias("insight"),
    )


def cross_platform_deltas(t: Tables, start, end, top: DataFrame, limit: int = 5) -> DataFrame:
    """Platform contrast of the first entities that are in the catalog by name."""
    known = resolve_promoted(t, top.filter(F.col("rank") <= limit)).filter("entity_id is not null")
    deltas = an.platform_deltas(t, start, end, known)
    return deltas.join(F.broadcast(known.select("entity_id", "rank")), "entity_id").select(
        "rank", F.col("entity_name").alias("entity"),
        say.platform_contrast(
            F.col("entity_name"), F.col("best_platform"), F.col("best_sentiment"),
            F.col("worst_platform"), F.col("worst_sentiment")).alias("insight"),
        "best_platform", "worst_platform", "delta",
    )


def emotion_section(t: Tables, top: DataFrame, as_of, days: int, limit: int = 5) -> DataFrame:
    listed = top.filter((F.col("rank") <= limit) & F.col("entity_id").isNotNull())
    counts = an.emotion_distribution(t, as_of, days).join(
        F.broadcast(listed.select("entity_id", "entity_name", "rank")), "entity_id")
    return counts.groupBy("rank", "entity_name").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("emotion", "count")))).alias("emotions"),
        F.sum("count").alias("total_emotion_signals"),
    )


def stance_section(t: Tables, top: DataFrame, as_of, days: int, limit: int = 5) -> DataFrame:
    listed = top.filter((F.col("rank") <= limit) & F.col("entity_id").isNotNull())
    counts = an.stance_breakdown(t, as_of, days).join(
        F.broadcast(listed.select("entity_id", "entity_name", "rank")), "entity_id")
    total = F.col("support") + F.col("oppose") + F.col("neutral")
    return counts.withColumn("total", total).filter("total > 0").select(
        "rank", "entity_name", "support", "oppose", "neutral", "total")


def narrative_context(t: Tables, top: DataFrame, alerts: DataFrame, samples: int = 3, stage: bool = True) -> DataFrame:
    """The detailed entities with velocity and sample quotes, which ``stage`` chooses first."""
    detailed = top.filter(F.col("rank") <= fv.TOP_ENTITIES_NARRATIVE)
    quoted = an.top_comments(t, samples, detailed.filter("entity_id is not null"), stage).filter("text <> ''")
    quotes = quoted.groupBy("entity_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", quote_sample(F.col("text"), F.col("likes")).alias("q")))).alias("_q")
    ).select("entity_id", F.transform("_q", lambda x: x["q"]).alias("sample_comments"))
    return _with_alerts(detailed, alerts).join(quotes, "entity_id", "left").select(
        "rank", F.col("entity_name").alias("name"), F.col("mention_count").alias("mentions"),
        F.col("avg_sentiment").alias("sentiment"), F.col("percent_change").alias("velocity"),
        F.coalesce("sample_comments", F.array().cast("array<string>")).alias("sample_comments"),
    )


def narrative(top: DataFrame, alerts: DataFrame) -> DataFrame:
    """The template narrative: headline of the top entity, then the biggest swing."""
    first = F.min(F.struct("rank", "entity_name", "mention_count", "avg_sentiment")).alias("f")
    swing = alerts.filter("alert_rank = 1").agg(
        F.max(say.critical_shift(F.col("entity_name"), F.col("percent_change"))).alias("s")).scalar()
    return top.agg(first).withColumn("_swing", swing).select(
        F.when(F.col("f").isNull(), say.NO_ACTIVITY).otherwise(F.concat_ws(
            " ",
            say.narrative_headline(F.col("f.entity_name"), F.col("f.mention_count"), F.col("f.avg_sentiment")),
            F.col("_swing"),
        )).alias("narrative")
    )


def topline(t: Tables, start, end, top: DataFrame, alerts: DataFrame) -> DataFrame:
    entities = top.agg(F.count(F.lit(1)).alias("n")).scalar()
    n_alerts = alerts.agg(F.count(F.lit(1)).alias("n")).scalar()
    critical = alerts.agg(F.count_if(F.abs("percent_change") > fv.CRITICAL_PERCENT).alias("n")).scalar()
    return an.comment_count(t, start, end).select(
        F.col("comment_count").alias("total_comments"), entities.alias("total_entities"),
        critical.alias("critical_alerts"), n_alerts.alias("velocity_alerts_count"))


def big_numbers(t: Tables, start, end, top: DataFrame, alerts: DataFrame, platforms: DataFrame) -> DataFrame:
    """Up to four callouts: volume, top entity, first critical swing, best platform."""
    volume = an.comment_count(t, start, end).select(
        F.lit(1).alias("place"), say.grouped(F.col("comment_count")).alias("number"),
        F.lit("Total Comments Analyzed").alias("label"))
    entity = top.filter("rank = 1").select(
        F.lit(2).alias("place"), say.grouped(F.col("mention_count")).alias("number"),
        F.concat(F.lit("Mentions: "), "entity_name", F.lit(" ("), sentiment_label(F.col("avg_sentiment")), F.lit(")")).alias("label"))
    swing = alerts.filter(F.abs("percent_change") > fv.CRITICAL_PERCENT).agg(
        F.min(F.struct("alert_rank", "entity_name", "percent_change")).alias("a")).filter("a is not null").select(
        F.lit(3).alias("place"), F.concat(say.fixed(F.abs("a.percent_change"), 1), F.lit("%")).alias("number"),
        F.concat(F.lit("Sentiment Shift: "), "a.entity_name").alias("label"))
    best = platforms.agg(
        F.min(F.struct((-F.col("avg_sentiment")).alias("k"), "platform", "avg_sentiment")).alias("b")).filter("b is not null").select(
        F.lit(4).alias("place"), say.signed(F.col("b.avg_sentiment")).alias("number"),
        F.concat(F.lit("Top Platform: "), F.initcap("b.platform"), F.lit(" Sentiment")).alias("label"))
    return volume.unionByName(entity).unionByName(swing).unionByName(best)


def post_section(t: Tables, start, end) -> DataFrame:
    return an.top_posts(t, start, end).select(
        "rank", "caption", "url", "platform", "comment_count", "total_likes", "avg_sentiment", "top_entity")


def post_section_summary(t: Tables, start, end, posts: DataFrame) -> DataFrame:
    shown = posts.agg(F.count(F.lit(1)).alias("n")).scalar()
    return an.post_distribution(t, start, end).withColumn("_shown", shown).select(
        say.post_summary(F.col("_shown"), F.col("positive_posts"), F.col("neutral_posts"),
                         F.col("negative_posts"), F.col("total_posts")).alias("summary"))


def build_brief(
    t: Tables, start, end, platforms: list[str] | None = None, as_of=None, stage: bool = True,
    storyline_names: list[str] | None = None,
) -> Sections:
    """All sections of the brief as small DataFrames.

    ``as_of`` (by default ``end``) anchors the look-back sections, which see no comment later than it or
    ``end``, staged or not; only the quotes are the best of all time. The signal and
    comment tables are joined once and staged; rankings that several sections
    use are staged too. Nothing is collected here.
    """
    as_of = as_of or end
    days = window_days(start, end)
    earliest = min(
        _moment(start), _moment(as_of) - timedelta(days=days), _moment(as_of) - timedelta(hours=2 * fv.VELOCITY_HOURS)
    )
    latest = max(_moment(end), _moment(as_of))
    facts = stage_facts(t, earliest, latest) if stage else t.with_(comments=t.comments.filter(F.col("created_at") <= F.lit(latest)))
    hold = checkpointed if stage else (lambda df: df)

    top = hold(ranked(dynamic_entities(facts, start, end, 10, platforms, fv.TOP_ENTITIES_TABLE)))
    alerts = hold(velocity_alerts(facts, top, as_of))
    by_platform = hold(an.platform_breakdown(facts, start, end, platforms))
    posts = hold(post_section(facts, start, end))
    toxic = hold(an.toxicity_alerts(facts, as_of, 0.7, days))
    stories = hold(storylines(t, start, end, top, storyline_names))
    spark = t.comments.sparkSession
    summaries = {
        "top_entities": top_summary(top),
        "contextual_narrative": narrative(top, alerts).select(F.col("narrative").alias("summary")),
        "what_changed": change_summary(top, alerts),
        "toxicity_alerts": toxicity_summary(toxic),
        "post_performance": post_section_summary(facts, start, end, posts),
        "storylines": storyline_summary(stories, an.comment_count(facts, start, end)),
    }
    return Sections({
        "topline_summary": topline(facts, start, end, top, alerts),
        "top_entities": top,
        "velocity_alerts": alerts,
        "discovered_entities": an.discovered_list(t, 10, False, fv.MAX_DISCOVERED),
        "platform_breakdown": by_platform,
        "sentiment_distribution": an.score_distribution(facts, start, end, platforms),
        # Sample quotes are the best of all time, so they read the full tables.
        "contextual_narrative": narrative_context(t, top, alerts, stage=stage),
        "entity_comparison": entity_comparison(top),
        "what_changed": what_changed(top, alerts),
        "cross_platform_deltas": cross_platform_deltas(facts, start, end, top),
        "key_risks": key_risks(top, alerts, by_platform),
        "entity_micro_insights": micro_insights(top, alerts),
        "emotion_analysis": emotion_section(facts, top, as_of, days),
        "topic_clusters": an.top_topics(facts, as_of, days, 10),
        "toxicity_alerts": toxic.orderBy(F.desc("toxicity"), F.desc("likes"), "comment_id").limit(10),
        "stance_summary": stance_section(facts, top, as_of, days),
        "post_performance": posts,
        "storylines": stories,
        "risk_signals": spark.createDataFrame([], RISK_SIGNALS),
    }, summaries)


# What orders the items of sections that do not lead with a rank.
ITEM_ORDER = {
    "top_entities": ["rank"],
    "discovered_entities": ["-mention_count"],
    "topic_clusters": ["-mentions"],
    "toxicity_alerts": ["-toxicity", "likes is null", "-likes"],
    "storylines": ["-mention_count"],
}


def _section(name: str, df: DataFrame, summary: DataFrame | None) -> DataFrame:
    """One row: the section as a struct of its title, items in their order and summary.

    Sections are bounded by the limits of the brief, so each fits one array.
    """
    maps = {c for c, kind in df.dtypes if kind.startswith("map")}
    order = [F.expr(key).alias(f"_{i}") for i, key in enumerate(ITEM_ORDER.get(name, []))]
    # Maps cannot be ordered, so they are lists of entries while the items are sorted.
    columns = [F.map_entries(c).alias(c) if c in maps else F.col(c) for c in df.columns]
    key = F.struct(*order, *[F.col(c) for c in df.columns if c not in maps])
    listed = df.agg(F.array_sort(F.collect_list(F.struct(key.alias("k"), F.struct(*columns).alias("item")))).alias("_items"))

    def item(row: Column) -> Column:
        cells = [(c, row["item"][c]) for c in df.columns]
        return F.struct(*[(F.map_from_entries(cell) if c in maps else cell).alias(c) for c, cell in cells])

    n = F.size("_items")
    some, none = SUMMARIES.get(name, (None, None))
    told = F.lit(None).cast("string") if some is None else F.format_string(some, n) if "%d" in some else F.lit(some)
    if none is not None:
        told = F.when(n > 0, told).otherwise(none)
    if summary is not None:
        told = summary.scalar()
    return listed.select(F.struct(
        F.lit(TITLES[name]).alias("title"), F.transform("_items", item).alias("items"), told.alias("summary")).alias("section"))


def brief_rows(sections: Sections) -> DataFrame:
    """One row per section: name, title, number of items, the items as a JSON array in their order, and summary."""
    out = None
    keep_nulls = {"ignoreNullFields": "false"}
    notes = getattr(sections, "summaries", {})
    for name, df in sections.items():
        row = _section(name, df, notes.get(name)).select(
            F.lit(name).alias("section"), "section.title", F.size("section.items").cast("bigint").alias("n_items"),
            F.to_json("section.items", keep_nulls).alias("items"), "section.summary",
        )
        out = row if out is None else out.unionByName(row)
    return out


def brief_struct(
    sections: Sections, start, end, platforms: list[str] | None = None, focus_entities: list[str] | None = None, generated_at=None,
) -> DataFrame:
    """The brief as one typed row: timeframe, platforms, a struct for each section, and metadata."""
    spark = next(iter(sections.values())).sparkSession
    told = F.array(*[F.lit(p) for p in (platforms or ["all"])])
    focus = F.array(*[F.lit(str(e)) for e in focus_entities or []]).cast("array<string>")
    at = F.current_timestamp() if generated_at is None else F.lit(_moment(generated_at))
    frame = F.struct(F.lit(_moment(start).isoformat()).alias("start"), F.lit(_moment(end).isoformat()).alias("end"))
    # Each section is a subquery of one value, so no section meets another in a join.
    parts = [_section(name, df, sections.summaries.get(name)).scalar().alias(name) for name, df in sections.items()]
    metadata = F.struct(at.alias("generated_at"), told.alias("platforms"), focus.alias("focus_entities"))
    return spark.range(1).select(frame.alias("timeframe"), told.alias("platforms"), *parts, metadata.alias("metadata"))


def brief_document(
    sections: Sections, start, end, platforms: list[str] | None = None, focus_entities: list[str] | None = None, generated_at=None,
) -> DataFrame:
    """The whole brief as one JSON document; times are in ISO form, missing values are null."""
    whole = brief_struct(sections, start, end, platforms, focus_entities, generated_at)
    options = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    return whole.select(F.to_json(F.struct(*whole.columns), options).alias("brief"))
