from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hearsay.plans import analytics as an
from hearsay.plans import brief as br
from hearsay.plans import discovery as di
from hearsay.plans import quality as qa
from hearsay.plans.facts import stage_facts
from hearsay.schemas import COMMENTS, DISCOVERED, ENTITIES, POSTS, SIGNALS
from hearsay.streaming.jobs import velocity_from_hours
from hearsay.tables import Tables

NOW = datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def tables(spark):
    """Two entities with 40 comments each, one every four hours back: one rises, one falls."""
    comments, signals = [], []
    for i in range(40):
        for who, sign in (("up", 1), ("down", -1)):
            cid = f"{who}{i}"
            comments.append((cid, f"p{i % 2}", "a", f"{who} says the WIN of {i}", NOW - timedelta(hours=4 * i), 10 * i, 0, None, "direct", None))
            signals.append((cid, cid, who, "sentiment", "x", sign * (-0.5 + (40 - i) * 0.025), 1 + i / 10, 0.9, "m", NOW))
    entities = [("up", "Up Entity", None, "person", True, ["rising"], 1), ("down", "Down Entity", None, "show", True, [], 2), ("none", "No Data", None, "brand", True, [], 3)]
    return Tables(
        posts=spark.createDataFrame([(f"p{i}", p, f"x{i}", f"u{i}", c, None, NOW, None) for i, (p, c) in enumerate([("instagram", "all about rising stars"), ("tiktok", None)])], POSTS),
        comments=spark.createDataFrame(comments, COMMENTS),
        monitored_entities=spark.createDataFrame(entities, ENTITIES),
        extracted_signals=spark.createDataFrame(signals, SIGNALS),
        discovered_entities=spark.createDataFrame([("The Win", "EVENT", NOW, NOW, 80, [], False, None, None), ("up entity", "PERSON", NOW, NOW, 50, [], False, None, None), ("video", "X", NOW, NOW, 99, [], False, None, None)], DISCOVERED),
    )


def by_id(df):
    return {r["entity_id"]: r for r in df.collect()}


def test_top_entities(tables):
    got = by_id(an.top_entities(tables, NOW - timedelta(days=30), NOW))
    assert got["up"].mention_count == got["down"].mention_count == 40 and "none" not in got
    assert got["up"].avg_sentiment == pytest.approx(0.0125) and got["up"].total_likes == 7800
    expected = sum((-0.5 + (40 - i) * 0.025) * (1 + i / 10) for i in range(40)) / sum(1 + i / 10 for i in range(40))
    assert got["up"].weighted_sentiment == pytest.approx(expected)


def test_velocity(tables):
    got = by_id(an.velocity(tables, NOW))
    assert got["up"].direction == "up" and got["up"].alert and got["up"].recent_sample_size == 19
    # The row exactly on the boundary counts on both sides.
    assert got["up"].previous_sample_size == 19
    assert got["none"].error == "Insufficient data" and got["none"].alert is None and got["none"].recent_sample_size == 0


def test_window_halves(tables):
    got = by_id(an.window_velocity(tables, NOW - timedelta(hours=156), NOW))
    assert got["up"].trending == "up" and got["none"].error
    few = by_id(an.window_velocity(tables, NOW - timedelta(hours=12), NOW))
    assert few["up"].error


@pytest.mark.parametrize("start, end", [(NOW, NOW - timedelta(days=1)), (NOW + timedelta(days=9), NOW + timedelta(days=10)), (NOW - timedelta(days=9000), NOW - timedelta(days=8000))])
def test_windows_without_rows(tables, start, end):
    assert an.top_entities(tables, start, end).count() == 0
    assert an.score_distribution(tables, start, end).first().positive_pct == 0.0
    assert an.comment_count(tables, start, end).first()[0] == 0
    assert an.post_distribution(tables, start, end).first().total_posts == 0


def test_zero_length_window_is_inclusive(tables):
    assert an.comment_count(tables, NOW, NOW).first()[0] == 2


def test_platform_filter_matches_unfiltered_total(tables):
    start = NOW - timedelta(days=30)
    whole = by_id(an.top_entities(tables, start, NOW))
    both = by_id(an.top_entities(tables, start, NOW, ["instagram", "tiktok"]))
    half = by_id(an.top_entities(tables, start, NOW, ["tiktok"]))
    assert both["up"].mention_count == whole["up"].mention_count and half["up"].mention_count == 20
    assert both["up"].weighted_sentiment == pytest.approx(whole["up"].weighted_sentiment)


def test_top_posts(tables):
    first, second = an.top_posts(tables, NOW - timedelta(days=30), NOW).collect()
    assert (first.post_id, first.top_entity, first.caption) == ("p0", "Up Entity", "all about rising stars")
    # Without a caption match the entity with most signals, ties by name.
    assert (second.post_id, second.top_entity, second.caption) == ("p1", "Down Entity", "")


def test_dynamic_entities(tables, rows):
    got = rows(di.dynamic_entities(tables, NOW - timedelta(days=30), NOW, limit=10), "entity_name", "mention_count", "is_monitored")
    assert got == [("Down Entity", 40, True), ("The Win", 80, False), ("Up Entity", 40, True)]


def test_staged_facts_give_the_same_results(tables, rows):
    start = NOW - timedelta(days=30)
    staged = stage_facts(tables, start, NOW)

    def totals(t):
        return rows(an.top_entities(t, start, NOW), "entity_id", "mention_count", F.round("weighted_sentiment", 9))

    assert totals(staged) == totals(tables)
    assert rows(an.velocity(staged, NOW)) == rows(an.velocity(tables, NOW))


def test_brief(tables):
    import json

    start = NOW - timedelta(days=7)
    sections = br.build_brief(tables, start, NOW)
    assert set(sections) == set(br.TITLES)
    text = br.brief_document(sections, start, NOW).first().brief
    brief = json.loads(text)
    assert brief["platforms"] == ["all"] and brief["timeframe"]["start"].startswith("2024-02-23")
    assert brief["risk_signals"]["items"] == []
    (line,) = brief["storylines"]["items"]
    assert line["storyline"] == "Win" and line["trajectory"] == "High"
    assert {c["category"] for c in brief["what_changed"]["items"]} == {"Top Riser", "Top Faller"}
    assert brief["topline_summary"]["items"][0]["velocity_alerts_count"] == 2
    assert all(set(brief[name]) == {"title", "items", "summary"} for name in br.TITLES)
    assert brief["what_changed"]["summary"] == "1 risers, 1 fallers, 0 new negative trends, 0 new positive narratives"
    assert brief["risk_signals"]["summary"] == "Risk signal detection not yet implemented"
    assert set(brief["metadata"]) == {"generated_at", "platforms", "focus_entities"}


def test_a_brief_is_the_same_staged_or_not_and_sees_nothing_later(tables):
    import json

    start, as_of = NOW - timedelta(days=7), NOW - timedelta(days=2)

    def document(stage):
        sections = br.build_brief(tables, start, as_of, stage=stage)
        text = br.brief_document(sections, start, as_of, ["tiktok"], ["e1"], as_of).first().brief
        # Sums of doubles depend on the order of rows in their last digits.
        return json.loads(text, parse_float=lambda x: round(float(x), 9) + 0.0)

    staged = document(True)
    assert staged == document(False)
    assert staged["metadata"]["generated_at"].startswith("2024-") and staged["metadata"]["focus_entities"] == ["e1"]


def test_items_of_a_section_keep_their_ranking(spark):
    topics = spark.createDataFrame([("alpha", 1), ("zeta", 9), ("beta", 9)], "topic string, mentions long")
    alerts = spark.createDataFrame([("c1", 0.7, 5), ("c2", 0.9, None), ("c3", 0.9, 1)], "comment_id string, toxicity double, likes long")
    import json

    shown = {r.section: json.loads(r["items"]) for r in br.brief_rows({"topic_clusters": topics, "toxicity_alerts": alerts}).collect()}
    assert [i["topic"] for i in shown["topic_clusters"]] == ["beta", "zeta", "alpha"]
    assert [i["comment_id"] for i in shown["toxicity_alerts"]] == ["c3", "c2", "c1"]


def test_metric_percentiles(spark):
    values = spark.createDataFrame([("t", "timing", float(i), NOW + timedelta(seconds=i)) for i in range(1200)], "metric string, kind string, value double, at timestamp")
    r = qa.metric_summary(values, kept=1000).first()
    assert (r["count"], r["min"], r["max"], r.p50, r.p95, r.p99) == (1000, 200.0, 1199.0, 700.0, 1150.0, 1190.0)
    rows = {r.metric: r for r in qa.metric_summary(values.unionByName(values).unionByName(values.filter("value < 2").withColumn("metric", F.lit("few")))).collect()}
    r = rows["t"]
    assert (r["count"], r["min"], r["max"], r.p50, r.p95, r.p99) == (2400, 0.0, 1199.0, 600.0, 1140.0, 1188.0)
    assert (rows["few"].p50, rows["few"].p99, rows["few"]["mean"]) == (1.0, 1.0, 0.5)


def test_hourly_velocity_skips_gaps(spark):
    hours = [("e", NOW + timedelta(hours=h), 0.5 if h < 10 else -0.5, 1) for h in [*range(10), *range(80, 90)]]
    hourly = spark.createDataFrame(hours, "entity_id string, hour timestamp, sum_score double, n long")
    got = velocity_from_hours(hourly, 72, 5)
    last = got.orderBy(F.desc("as_of")).first()
    assert (last.recent_count, last.previous_count, last.percent_change, last.direction) == (10, 10, -200.0, "down")
