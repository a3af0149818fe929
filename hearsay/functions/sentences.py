"""Report sentences built from aggregate columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearsay.functions.labels import sentiment_bucket, sentiment_label

NO_ACTIVITY = "No significant entity activity in this period."


def _even(value: Column, decimals: int) -> Column:
    """The nearest number of so many decimals, with ties to the even digit, where the formatter would round up.

    What counts is the stored number: -0.015 is stored a little nearer to zero, which makes it -0.01. A small
    negative number keeps its sign.
    """
    number = F.abs(value.cast("double"))
    scale = 2.0 * 10**decimals
    halves = F.rint(number * scale)
    # The rest is exact: a head of 26 bits and a tail, each times the scale, have room in a double.
    wide = number * 134217729.0
    head = wide - (wide - number)
    rest = (head * scale - halves) + (number - head) * scale
    near = F.when(halves % 2 == 0, halves / 2).when(rest > 0, (halves + 1) / 2).when(rest < 0, (halves - 1) / 2).otherwise(F.rint(halves / 2))
    # Beyond this, far beyond any score or percentage, the formatter rounds.
    rounded = F.when(number < 2.0**40, near / 10.0**decimals).otherwise(number)
    return F.when(value < 0, -rounded).otherwise(rounded)


def signed(value: Column, decimals: int = 2) -> Column:
    """A number with an explicit sign, e.g. ``+0.25``."""
    return F.format_string(f"%+.{decimals}f", _even(value, decimals))


def fixed(value: Column, decimals: int) -> Column:
    return F.format_string(f"%.{decimals}f", _even(value, decimals))


def grouped(value: Column) -> Column:
    """A whole number with thousands separators."""
    return F.format_number(value.cast("bigint"), 0)


def headline(name: Column, mentions: Column, score: Column) -> Column:
    return F.concat(
        name, F.lit(" dominated conversations with "), grouped(mentions), F.lit(" mentions and "),
        sentiment_bucket(score), F.lit(" sentiment ("), signed(score), F.lit(")."),
    )


def narrative_headline(name: Column, mentions: Column, score: Column) -> Column:
    return F.concat(
        name, F.lit(" dominated conversations with "), grouped(mentions), F.lit(" mentions and "),
        sentiment_bucket(score), F.lit(" sentiment."),
    )


def critical_shift(name: Column, change: Column) -> Column:
    return F.concat(
        name, F.lit(" shows a critical sentiment shift ("), signed(change, 1),
        F.lit("%), indicating significant change in public perception."),
    )


def alert_text(name: Column, change: Column, previous: Column, recent: Column) -> Column:
    return F.concat(
        name, F.lit(" experienced a "), signed(change, 1), F.lit("% sentiment shift from "),
        fixed(previous, 2), F.lit(" to "), fixed(recent, 2), F.lit("."),
    )


def micro_insight(score: Column, mentions: Column, likes: Column, change: Column) -> Column:
    """Up to two bullets: sentiment, then velocity, then engagement."""
    n = F.concat(grouped(mentions), F.lit(" mentions"))
    feeling = (
        F.when(score > 0.5, F.concat(F.lit("Strong positive sentiment ("), signed(score), F.lit(") with "), n))
        .when(score < -0.5, F.concat(F.lit("Significant negative sentiment ("), signed(score), F.lit(") across "), n))
        .otherwise(F.concat(F.lit("Neutral sentiment ("), signed(score), F.lit(") with "), n))
    )
    moved = F.when(
        F.abs(change) > 30,
        F.concat(
            F.lit("Sentiment "), F.when(change > 0, "improved").otherwise("declined"), F.lit(" "),
            fixed(F.abs(change), 1), F.lit("% in past 72hrs"),
        ),
    )
    engaged = F.when(
        likes > 50_000, F.concat(F.lit("High engagement: "), grouped(likes), F.lit(" total likes"))
    )
    bullets = F.filter(F.array(feeling, moved, engaged), lambda b: b.isNotNull())
    return F.array_join(F.slice(bullets, 1, 2), " • ")


def platform_contrast(name: Column, best: Column, best_score: Column, worst: Column, worst_score: Column) -> Column:
    """How an entity's sentiment differs between its best and worst platform."""
    split = F.concat(
        name, F.lit(" shows "), F.initcap(best), F.lit("-driven positivity ("), signed(best_score),
        F.lit(") while "), F.initcap(worst), F.lit(" is more negative ("), signed(worst_score), F.lit(")"),
    )
    even = F.concat(
        name, F.lit(" sentiment is consistent across platforms ("), F.initcap(best), F.lit(": "),
        signed(best_score), F.lit(", "), F.initcap(worst), F.lit(": "), signed(worst_score), F.lit(")"),
    )
    return F.when(best_score - worst_score > 0.3, split).otherwise(even)


def velocity_risk(name: Column, change: Column) -> Column:
    return F.concat(
        name, F.lit(" negativity "), F.when(change < 0, "accelerating").otherwise("improving"),
        F.lit("; "), fixed(F.abs(change), 1), F.lit("% sentiment shift in 72hrs"),
    )


def fragile_risk(name: Column, score: Column, mentions: Column) -> Column:
    return F.concat(
        name, F.lit(" sentiment remains fragile ("), signed(score), F.lit(") with high volume ("),
        grouped(mentions), F.lit(" mentions)"),
    )


def platform_risk(platform: Column, score: Column, comments: Column) -> Column:
    return F.concat(
        F.initcap(platform), F.lit(" shows negative sentiment ("), signed(score), F.lit(") across "),
        grouped(comments), F.lit(" comments"),
    )


def distribution_explainer(positive_pct: Column, negative_pct: Column, total: Column) -> Column:
    pos, neg, n = fixed(positive_pct, 1), fixed(negative_pct, 1), grouped(total)
    return (
        F.when(
            positive_pct > negative_pct * 1.5,
            F.concat(F.lit("Positive sentiment dominates with "), pos, F.lit("% of "), n,
                     F.lit(" comments, indicating overall favorable discourse.")),
        )
        .when(
            negative_pct > positive_pct * 1.5,
            F.concat(F.lit("Negative sentiment leads with "), neg, F.lit("% of "), n,
                     F.lit(" comments, signaling significant criticism or concern.")),
        )
        .otherwise(
            F.concat(F.lit("Sentiment is balanced: "), pos, F.lit("% positive, "), neg,
                     F.lit("% negative across "), n, F.lit(" comments."))
        )
    )


def platform_explainer(best: Column, best_score: Column, worst: Column, worst_score: Column) -> Column:
    apart = F.concat(
        F.initcap(best), F.lit(" shows "), F.lower(sentiment_label(best_score)), F.lit(" sentiment ("),
        signed(best_score), F.lit("), while "), F.initcap(worst), F.lit(" is "),
        F.lower(sentiment_label(worst_score)), F.lit(" ("), signed(worst_score),
        F.lit("), indicating platform-specific discourse patterns."),
    )
    close = F.concat(
        F.lit("Platform sentiment is relatively consistent, with "), F.initcap(best),
        F.lit(" slightly more positive."),
    )
    return F.when(best_score - worst_score > 0.2, apart).otherwise(close)


def trend_explainer(names: Column) -> Column:
    """``names``: entity names by volume, at most three of them are shown."""
    one = F.concat(
        F.get(names, F.lit(0)),
        F.lit(" sentiment trend shows the entity's sentiment trajectory over the reporting period."),
    )
    several = F.concat(
        F.lit("Top entities show divergent sentiment patterns, with "),
        F.array_join(F.slice(names, 1, 3), ", "),
        F.lit(" representing the highest-volume conversations."),
    )
    return F.when(F.size(names) == 1, one).when(F.size(names) > 1, several)


def editorial_guidance(high_count: Column, name: Column, mentions: Column) -> Column:
    """Advice on discovered names: ``name`` is the one with most mentions."""
    many = F.concat(
        high_count.cast("string"),
        F.lit(" entities show high relevance (20+ mentions) and should be considered for"
              " addition to the monitored list. Top candidate: "),
        name, F.lit(" ("), mentions.cast("string"), F.lit(" mentions)."),
    )
    one = F.concat(
        name, F.lit(" should probably be added as a monitored entity due to emerging relevance ("),
        mentions.cast("string"), F.lit(" mentions)."),
    )
    return F.when(high_count > 0, many).when(mentions >= 10, one)


def post_summary(shown: Column, positive: Column, neutral: Column, negative: Column, total: Column) -> Column:
    return F.concat(
        F.lit("Top "), shown.cast("string"), F.lit(" posts by comment volume. Post sentiment distribution: "),
        positive.cast("string"), F.lit(" positive, "), neutral.cast("string"), F.lit(" neutral, "),
        negative.cast("string"), F.lit(" negative (out of "), total.cast("string"),
        F.lit(" posts with 5+ comments)."),
    )
