"""From comments to signal rows, review items and discovered names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay import fixed_values as fv
from hearsay.functions.labels import sentiment_label, toxicity_level
from hearsay.functions.numbers import like_weight
from hearsay.functions.text import is_discovered_name, is_scored_name, strip
from hearsay.keys import review_id, signal_id
from hearsay.operators.matching import capitalised_names, mention_arrays, resolved_ids
from hearsay.operators.scoring import score_texts
from hearsay.sizing import let, unnest

_ITEM = "struct<signal_type:string,entity_id:{id},value:string,numeric_value:double,confidence:double>"


# ---------------------------------------------------------------- work set


def work_set(comments: DataFrame, signals: DataFrame | None = None, ids: DataFrame | None = None, since=None) -> DataFrame:
    """Comments to enrich: the given ids, else those since a time, else those without signals."""
    if ids is not None:
        return comments.join(ids.select("comment_id").distinct(), "comment_id", "left_semi")
    if since is not None:
        return comments.filter(F.col("created_at") >= F.lit(since).cast("timestamp"))
    return unenriched(comments, signals)


def unenriched(comments: DataFrame, signals: DataFrame) -> DataFrame:
    """Comments that have no signal yet."""
    return comments.join(signals.select("comment_id"), "comment_id", "left_anti")


def finish_signals(df: DataFrame, run_ts: Column, source_model: Column, *keep: str) -> DataFrame:
    """Add id, model and time to rows that have the other signal columns."""
    return df.select(
        signal_id(F.col("comment_id"), F.col("entity_id"), F.col("signal_type"), source_model, F.col("value")).alias("signal_id"),
        "comment_id", "entity_id", "signal_type", "value", "numeric_value", "weight_score", "confidence",
        source_model.alias("source_model"), run_ts.alias("created_at"),
        *keep,
    )


# --------------------------------------------------------------- rule path


def rule_signals(
    comments: DataFrame, entities: DataFrame, posts: DataFrame | None, run_ts: Column, scorer: str = fv.RULE_MODEL
) -> DataFrame:
    """One sentiment signal per comment plus one per catalog mention.

    A mention's confidence is its own times that of the score. One pass over
    the comments matches, scores and fans out, whatever the size of the catalog.
    """
    no_entity = F.lit(None).cast(entities.schema["entity_id"].dataType)
    weight = like_weight(F.col("likes")).alias("weight_score")
    matched = score_texts(mention_arrays(comments, entities, posts), "text", scorer)

    def target(entity: Column, share: Column) -> Column:
        return F.struct(entity.alias("entity_id"), share.alias("share"))

    targets = F.concat(
        F.array(target(no_entity, F.lit(1.0))),
        F.transform("mentions", lambda m: target(m["entity_id"], m["confidence"])),
    )
    spread = unnest(matched, ["comment_id", "sentiment", weight], targets, "_t")
    spread = spread.select("comment_id", "sentiment", "weight_score", "_t.entity_id", F.col("_t.share").alias("_share"))
    rows = spread.select(
        "comment_id", "entity_id", F.lit("sentiment").alias("signal_type"),
        sentiment_label(F.col("sentiment.score")).alias("value"),
        F.col("sentiment.score").alias("numeric_value"), "weight_score",
        (F.col("_share") * F.col("sentiment.confidence")).alias("confidence"),
        F.col("sentiment.source_model").alias("_model"),
    )
    return finish_signals(rows, run_ts, F.col("_model"))


# ----------------------------------------------------------- response path


def analysed_comments(comments_with_mentions: DataFrame, analyses: DataFrame) -> DataFrame:
    """Comments with their mentions and their validated analysis.

    The one join all fan-outs share; write it as a table (``checkpointed``)
    when several of them follow.
    """
    return comments_with_mentions.join(analyses.select("comment_id", "analysis"), "comment_id")


def response_signals(
    analysed: DataFrame, entities: DataFrame, run_ts: Column, source_model: str, *keep: str
) -> DataFrame:
    """All signals of validated analyses, entities resolved by any spelling.

    Needs ``comment_id, likes, mentions, analysis``, one row per comment; ``keep`` names
    columns to carry along. Names are resolved and folded inside the row, so nothing moves after
    the fan-out: of two spellings of one entity in a comment the last wins.
    """
    id_type = entities.schema["entity_id"].dataType.simpleString()
    item = _ITEM.format(id=id_type)
    none = F.array().cast(f"array<{item}>")
    a, mentions = F.col("analysis"), F.col("mentions")

    def row(kind, entity=None, value=None, number=None, confidence=None) -> Column:
        return F.struct(
            F.lit(kind).alias("signal_type"),
            (F.lit(None) if entity is None else entity).cast(id_type).alias("entity_id"),
            (F.lit(None) if value is None else value).cast("string").alias("value"),
            (F.lit(None) if number is None else number).cast("double").alias("numeric_value"),
            (F.lit(None) if confidence is None else F.lit(confidence)).cast("double").alias("confidence"),
        )

    found = analysed.withColumn("_trusted", F.filter(_scored_names(a), lambda s: s["confidence"] >= fv.MIN_ENTITY_CONFIDENCE))
    found = found.withColumn("_ids", resolved_ids(found, F.transform("_trusted", lambda s: s["name"]), entities))

    def last_known(s: Column, i: Column) -> Column:
        entity = F.get("_ids", i)
        later = F.array_contains(F.slice("_ids", i + 2, F.size("_ids")), entity)
        # Beside unknown names, "not found" is NULL.
        return entity.isNotNull() & ~F.coalesce(later, F.lit(False))

    placed = F.transform("_trusted", lambda s, i: F.struct(s.alias("s"), F.get("_ids", i).alias("entity_id")))
    targeted = F.transform(
        F.filter(placed, lambda p, i: last_known(p, i)),
        lambda p: row("sentiment", p["entity_id"], sentiment_label(p["s"]["score"]), p["s"]["score"], p["s"]["confidence"]),
    )
    stance = (
        F.when(a["stance"] == "oppose", -fv.STANCE_FALLBACK_SCORE)
        .when(a["stance"] == "support", fv.STANCE_FALLBACK_SCORE)
        .otherwise(0.0)
    )
    fallback = F.when(
        F.size(a["entity_scores"]) == 0,
        F.transform(mentions, lambda m: row(
            "sentiment", m["entity_id"], sentiment_label(stance), stance, fv.STANCE_FALLBACK_CONFIDENCE)),
    ).otherwise(none)
    emotion = F.when(
        F.size(mentions) > 0,
        F.transform(mentions, lambda m: row("emotion", m["entity_id"], a["emotion"], None, fv.EMOTION_CONFIDENCE)),
    ).otherwise(F.array(row("emotion", None, a["emotion"], None, fv.EMOTION_CONFIDENCE)))
    topics = F.transform(F.array_distinct(a["topics"]), lambda t: row("topic", None, t, None, fv.TOPIC_CONFIDENCE))
    toxicity = F.array(row("toxicity", None, toxicity_level(a["toxicity"]), a["toxicity"], fv.TOXICITY_CONFIDENCE))
    sarcasm = F.when(
        a["sarcasm"], F.array(row("sarcasm", None, F.lit("sarcasm"), F.lit(1.0), fv.SARCASM_CONFIDENCE))
    ).otherwise(none)
    items = F.concat(targeted, fallback, emotion, topics, toxicity, sarcasm)
    weight = like_weight(F.col("likes")).alias("weight_score")
    out = unnest(found, ["comment_id", weight, *keep], items, "s").select("comment_id", "weight_score", *keep, "s.*")
    return finish_signals(out, run_ts, F.lit(source_model), *keep)


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with the same key keep the last; combines in every task first."""
    rest = F.struct(*[c for c in df.columns if c != key])
    return df.groupBy(key).agg(F.max_by(rest, F.col(order)).alias("_row")).select(key, "_row.*")


def _scored_names(a: Column) -> Column:
    """Plausible scored names with their score and confidence."""
    scored = F.transform(
        F.map_entries(a["entity_scores"]),
        lambda e: F.struct(
            e["key"].alias("name"),
            e["value"].alias("score"),
            F.coalesce(
                F.try_element_at(a["entity_confidence"], e["key"]), F.lit(fv.DEFAULT_ENTITY_CONFIDENCE)
            ).alias("confidence"),
        ),
    )
    return F.filter(scored, lambda s: is_scored_name(s["name"]))


def review_items(analysed: DataFrame, run_ts: Column) -> DataFrame:
    """Mentions a human should decide: low-confidence scores and ambiguous names.

    Needs ``text`` and ``caption`` besides the analysis.
    """
    a = F.col("analysis")
    unsure = F.transform(
        F.filter(_scored_names(a), lambda s: s["confidence"] < fv.MIN_ENTITY_CONFIDENCE),
        lambda s: F.struct(
            s["name"].alias("name"),
            F.array(s["name"]).alias("possible_entities"),
            s["confidence"].alias("confidence"),
            F.format_string("Low confidence (%.2f) for entity assignment", s["confidence"]).alias("reason"),
        ),
    )
    # Of a name that a comment queues twice the last item counts.
    once = let(F.concat(unsure, a["ambiguous_mentions"]), lambda items: let(
        F.transform(items, lambda x: x["name"]),
        lambda names: F.filter(items, lambda x, i: ~F.coalesce(F.array_contains(F.slice(names, i + 2, F.size(names)), x["name"]), F.lit(False))),
    ))
    kept = ["comment_id", F.col("text").alias("context"), F.col("caption").alias("post_caption")]
    items = unnest(analysed, kept, once, "m")
    return items.select(
        review_id(F.col("comment_id"), F.col("m.name")).alias("review_id"),
        "comment_id", F.col("m.name").alias("entity_mention"), "context", "post_caption",
        "m.confidence", "m.possible_entities", "m.reason", F.lit(False).alias("reviewed"),
        run_ts.alias("created_at"),
    )


def discovered_from_responses(analysed: DataFrame, entities: DataFrame) -> DataFrame:
    """Names outside the catalog: other entities, then unresolved scored names.

    A name counts once per comment, whatever its case. Needs ``text``.
    """
    a = F.col("analysis")
    listed = F.concat(
        F.transform(a["other_entities"], lambda n: F.struct(
            n.alias("name"), strip(F.lower(n)).alias("key"), F.lit(True).alias("sure"))),
        F.transform(F.map_keys(a["entity_scores"]), lambda n: F.struct(
            n.alias("name"), strip(F.lower(n)).alias("key"), F.lit(False).alias("sure"))),
    )
    once = let(listed, lambda names: F.filter(
        names, lambda x, i: F.array_position(F.transform(names, lambda y: y["key"]), x["key"]) == i + 1
    ))
    found = analysed.withColumn("_listed", once)
    found = found.withColumn("_ids", resolved_ids(found, F.transform("_listed", lambda n: n["name"]), entities))
    outside = F.filter("_listed", lambda n, i: (n["sure"] | F.get("_ids", i).isNull()) & is_discovered_name(n["name"]))
    names = unnest(found, ["comment_id", "created_at", "text"], outside, "n")
    return names.select("comment_id", "n.name", F.lit("PERSON").alias("entity_type"), "created_at", "text")


def discovered_in_texts(matched: DataFrame, entity_type: str = "PERSON") -> DataFrame:
    """Names the built-in annotator finds in texts, once per comment, unless the catalog's mentions cover them.

    Needs ``comment_id, created_at, text, mentions``.
    """
    known = F.transform("mentions", lambda m: m["mention_text"])
    named = F.filter(F.array_distinct(capitalised_names(F.col("text"))), lambda n: ~F.array_contains(known, F.lower(n)))
    names = unnest(matched, ["comment_id", "created_at", "text"], named, "name")
    return names.select("comment_id", "name", F.lit(entity_type).alias("entity_type"), "created_at", "text")


def enrichment_stats(comments: DataFrame, signals: DataFrame, discovered: DataFrame, review: DataFrame | None = None) -> DataFrame:
    """Counts of one run, one row per kind."""

    def counted(df: DataFrame, kind: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("count")).select(F.lit(kind).alias("kind"), "count")

    out = counted(comments, "comments_processed").unionByName(counted(signals, "signals_created"))
    out = out.unionByName(counted(discovered, "entities_discovered"))
    return out if review is None else out.unionByName(counted(review, "queued_for_review"))
