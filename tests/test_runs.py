"""Whole enrichment runs: repeated, interrupted, and from two live streams."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hearsay.operators import run as runs
from hearsay.streaming.jobs import response_stream
from hearsay.tables import read_tables

DAY = datetime(2024, 3, 1)
COMMENTS = "comment_id string, post_id string, text string, created_at timestamp, likes long"


def comment(cid, text, minutes=0):
    return (cid, "p1", text, DAY + timedelta(minutes=minutes), 100)


@pytest.fixture(scope="module")
def posts(spark):
    return spark.createDataFrame([("p1", "about Ryan Reynolds"), ("p2", None)], "post_id string, caption string")


def response(**fields):
    return json.dumps(fields)


def now():
    return F.timestamp_seconds(F.lit(0))


def store(spark, root):
    t = read_tables(spark, root, ["extracted_signals", "discovered_entities", "review_queue"])
    frames = (t.extracted_signals, t.discovered_entities, t.review_queue, runs.read_ledger(spark, root))
    return [sorted(map(repr, f.collect())) for f in frames]


@pytest.fixture
def batch(spark):
    comments = spark.createDataFrame([
        comment("c1", "Taylor Swift met Jane Doe"), comment("c2", "he is great"), comment("c3", "nothing"), comment("c4", None),
        ("c5", None, "", None, None),
    ], COMMENTS)
    responses = spark.createDataFrame([
        ("c1", response(entity_scores={"Tay": 0.8, "Ryan Gosling": -0.4}, entity_confidence={"Ryan Gosling": 0.5}, other_entities=["Jane Doe", "Bob Roe"], topics=["tour"])),
        ("c2", response(stance="oppose")), ("c3", None), ("zz", response(stance="oppose")),
    ], "comment_id string, raw_json string")
    return comments, responses


def enrich(batch, catalog, posts, root, name):
    found = runs.enrich(*batch, catalog, posts, root, name, now(), "m").collect()
    return {r.kind: r["count"] for r in found}


def test_a_repeated_run_changes_nothing(spark, rows, batch, catalog, posts, tmp_path):
    root = str(tmp_path)
    runs.create_store(spark, root)
    counts = enrich(batch, catalog, posts, root, "one")
    first = store(spark, root)
    assert counts == {"comments_processed": 5, "signals_created": len(first[0]), "entities_discovered": 2, "queued_for_review": 1}
    stored = read_tables(spark, root, ["extracted_signals", "discovered_entities"])
    sentiment = rows(stored.extracted_signals.filter("signal_type = 'sentiment'"), "comment_id", "entity_id", "numeric_value")
    # The score by name, and the stance for the entity that a pronoun means.
    assert ("c1", "e4", 0.8) in sentiment and ("c2", "e2", -0.5) in sentiment
    # Jane Doe is found by the response and by the annotator: one count.
    assert rows(stored.discovered_entities, "name", "mention_count") == [("Bob Roe", 1), ("Jane Doe", 1)]
    assert enrich(batch, catalog, posts, root, "one") == counts and store(spark, root) == first
    assert enrich(batch, catalog, posts, root, "two") == counts and store(spark, root) == first


def test_an_interrupted_run_is_finished_by_its_name(spark, batch, catalog, posts, tmp_path, monkeypatch):
    whole, broken = str(tmp_path / "whole"), str(tmp_path / "broken")
    for root in (whole, broken):
        runs.create_store(spark, root)
    counts = enrich(batch, catalog, posts, whole, "one")
    write = runs.write_table

    def lost(df, root, name):
        if name == "review_queue":
            raise OSError("lost")
        write(df, root, name)

    monkeypatch.setattr(runs, "write_table", lost)
    with pytest.raises(OSError):
        enrich(batch, catalog, posts, broken, "one")
    monkeypatch.setattr(runs, "write_table", write)
    # The tally was replaced before the loss: it does not count again.
    assert enrich(batch, catalog, posts, broken, "one") == counts
    assert store(spark, broken) == store(spark, whole)


def test_an_empty_run(spark, batch, catalog, posts, tmp_path):
    root = str(tmp_path)
    runs.create_store(spark, root)
    none = [df.filter("false") for df in batch]
    assert set(enrich(none, catalog, posts, root, "none").values()) == {0}
    assert store(spark, root) == [[], [], [], []]


def test_responses_meet_live_comments(spark, catalog, posts, tmp_path):
    """In time, late, absent and twice; a second start goes on from the checkpoint."""
    root, progress, said, answered = (str(tmp_path / n) for n in ("store", "progress", "said", "answered"))
    runs.create_store(spark, root)
    kind = "comment_id string, raw_json string, responded_at timestamp"

    def deliver(comments, answers):
        spark.createDataFrame(comments, COMMENTS).coalesce(1).write.mode("append").parquet(said)
        spark.createDataFrame([(c, r, DAY + timedelta(minutes=m)) for c, r, m in answers], kind).coalesce(1).write.mode("append").parquet(answered)
        response_stream(
            spark.readStream.schema(COMMENTS).parquet(said), spark.readStream.schema(kind).parquet(answered),
            catalog, posts, root, progress, now(), "m",
        ).awaitTermination()

    def emotions():
        signals = read_tables(spark, root, ["extracted_signals"]).extracted_signals.filter("signal_type = 'emotion' AND entity_id IS NULL")
        return {r.comment_id: r.value for r in signals.collect()}

    joy, anger = response(emotion="joy"), response(emotion="anger")
    deliver(
        [comment("in time", "a"), comment("late", "b"), comment("absent", "c"), comment("open", "d", 180), comment("in time", "a")],
        [("in time", joy, 30), ("in time", joy, 30), ("late", joy, 90), ("clock", joy, 240)],
    )
    assert emotions() == {"in time": "joy", "late": "neutral", "absent": "neutral"}
    # The state of the open comment is taken up; the late answer of before stays without effect.
    deliver([comment("next", "e", 400)], [("open", anger, 235), ("next", joy, 410)])
    assert emotions() == {"in time": "joy", "late": "neutral", "absent": "neutral", "open": "anger", "next": "joy"}
    assert len(store(spark, root)[0]) == 10
