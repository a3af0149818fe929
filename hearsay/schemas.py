"""Column layouts of the input records and of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Allowed values of the coded string columns (fixed values).
PLATFORMS = ("instagram", "youtube", "tiktok")
SIGNAL_TYPES = (
    "sentiment", "emotion", "storyline", "risk_flag",
    "stance", "topic", "toxicity", "sarcasm",
)
CONTEXT_TYPES = ("direct", "reply", "thread")
ENTITY_TYPES = ("person", "show", "couple", "brand")


_SIMPLE = {
    "string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
    "strings": T.ArrayType(T.StringType()),
    "scores": T.MapType(T.StringType(), T.DoubleType()),
}


def struct(spec: str, **nested: T.DataType) -> T.StructType:
    """A struct from ``name type, ...``; nested types are passed by name.

    Unlike a DDL string this needs no session.
    """
    pairs = [part.split() for part in spec.split(",")]
    return T.StructType([T.StructField(n, nested[n] if n in nested else _SIMPLE[t]) for n, t in pairs])


# What every source reader returns. ``seq`` is the arrival order inside one
# load; ``has_post_metadata`` marks records that carry the post's own timestamp.
RAW_COMMENT = struct(
    "platform string, external_post_id string, post_url string, post_caption string,"
    " post_subject string, comment_author string, comment_text string,"
    " comment_timestamp timestamp, like_count bigint, raw string,"
    " has_post_metadata boolean, seq bigint"
)

# Same columns minus the comment part: updates of posts without a comment.
POST_UPDATE = struct(
    "platform string, external_post_id string, post_url string, post_caption string,"
    " post_subject string, posted_at timestamp, raw string, seq bigint"
)

POSTS = struct(
    "post_id string, platform string, external_id string, url string, caption string,"
    " subject_line string, posted_at timestamp, raw_data string"
)
COMMENTS = struct(
    "comment_id string, post_id string, author_name string, text string,"
    " created_at timestamp, likes bigint, reply_count bigint, parent_id string,"
    " context_type string, extra_data string"
)
ENTITIES = struct(
    "entity_id string, name string, canonical_name string, entity_type string,"
    " is_active boolean, aliases strings, load_order bigint"
)
SIGNALS = struct(
    "signal_id string, comment_id string, entity_id string, signal_type string,"
    " value string, numeric_value double, weight_score double, confidence double,"
    " source_model string, created_at timestamp"
)
DISCOVERED = struct(
    "name string, entity_type string, first_seen_at timestamp, last_seen_at timestamp,"
    " mention_count bigint, sample_mentions strings, reviewed boolean,"
    " reviewed_at timestamp, action_taken string"
)
REVIEW_QUEUE = struct(
    "review_id string, comment_id string, entity_mention string, context string,"
    " post_caption string, confidence double, possible_entities strings,"
    " reason string, reviewed boolean, reviewed_at timestamp, reviewed_by string,"
    " assigned_entity_id string, assigned_entity_name string, decision string,"
    " notes string, created_at timestamp"
)
POST_TRACKER = struct("url string, last_scraped timestamp, comment_count bigint")
METRICS = struct("metric string, kind string, value double, at timestamp")

TABLE_SCHEMAS = {
    "posts": POSTS,
    "comments": COMMENTS,
    "monitored_entities": ENTITIES,
    "extracted_signals": SIGNALS,
    "discovered_entities": DISCOVERED,
    "review_queue": REVIEW_QUEUE,
    "post_tracker": POST_TRACKER,
    "metrics": METRICS,
}

# One validated multi-signal analysis of a comment.
AMBIGUOUS_MENTION = struct(
    "name string, possible_entities strings, confidence double, reason string"
)
ANALYSIS = struct(
    "entity_scores scores, entity_confidence scores, emotion string, stance string,"
    " topics strings, other_entities strings, sarcasm boolean, toxicity double,"
    " ambiguous_mentions nested",
    ambiguous_mentions=T.ArrayType(AMBIGUOUS_MENTION),
)

# Nested JSON item of a live comment feed.
FEED_ITEM = struct(
    "pk string, text string, created_at double, created_at_utc double,"
    " comment_like_count bigint, media_id string, post_url string, url string, user nested",
    user=struct("username string, full_name string, is_private boolean, profile_pic_url string"),
)
