"""Named levels of scores, changes and volumes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sentiment_label(score: Column, strict: bool = False) -> Column:
    """Five levels; ``strict`` excludes the boundary at the two upper levels."""
    strong = score > 0.7 if strict else score >= 0.7
    good = score > 0.3 if strict else score >= 0.3
    return (
        F.when(score.isNull(), None)
        .when(strong, "Strongly Positive")
        .when(good, "Positive")
        .when(score > -0.3, "Neutral")
        .when(score > -0.7, "Negative")
        .otherwise("Strongly Negative")
    )


def sentiment_bucket(score: Column) -> Column:
    return F.when(score > 0.3, "positive").when(score < -0.3, "negative").otherwise("neutral")


def toxicity_level(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low")


def trend_label(score: Column) -> Column:
    return F.when(score > 0.3, "rising").when(score < -0.3, "falling").otherwise("stable")


def velocity_status(change: Column, recent: Column, previous: Column) -> Column:
    """Status word of an alert from its size, its sign and both averages."""
    size = F.abs(change)
    came_from_below = previous < -0.3
    large = F.when(
        change > 0, F.when(came_from_below, "Strong Recovery").otherwise("Strong Improvement")
    ).otherwise(F.when(recent < -0.7, "Crisis Alert").otherwise("Major Decline"))
    medium = F.when(change > 0, F.when(came_from_below, "Recovery").otherwise("Improving")).otherwise(
        F.when(recent > -0.3, "Declining").otherwise("Turned Negative")
    )
    return F.when(size > 50, large).when(size > 30, medium).otherwise("Stable")


def velocity_phrase(change: Column, recent: Column, previous: Column) -> Column:
    """Plain-language direction of a sentiment change."""
    up = (
        F.when((previous < -0.3) & (recent > -0.3), "recovering from negative territory")
        .when(recent > 0.3, "sentiment strongly positive")
        .otherwise("sentiment improving")
    )
    down = (
        F.when((previous > -0.3) & (recent < -0.3), "turned negative")
        .when(recent < -0.7, "sentiment crisis")
        .otherwise("sentiment declining")
    )
    return F.when(change > 0, up).otherwise(down)


def trajectory(count: Column, highest: Column) -> Column:
    return (
        F.when(count > highest * 0.8, "High").when(count > highest * 0.5, "Moderate").otherwise("Emerging")
    )


def completeness_band(percent: Column) -> Column:
    return F.when(percent >= 90, "good").when(percent >= 50, "partial").otherwise("low")
