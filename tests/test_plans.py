"""The physical plans that the operators rely on at scale."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hearsay.operators import matching as ma
from hearsay.operators import merge as mg
from hearsay.plans import analytics as an
from hearsay.schemas import COMMENTS, POSTS, SIGNALS
from hearsay.session import scratch_path
from hearsay.tables import Tables, read_tables, write_table


@pytest.fixture(scope="module")
def stored(spark):
    root = scratch_path(spark, "plan")
    write_table(spark.createDataFrame([], POSTS), root, "posts")
    # One row each: an empty folder shows no partition columns.
    day = datetime(2024, 1, 9)
    write_table(spark.createDataFrame([("c", "p", "a", "t", day, 1, 0, None, "direct", None)], COMMENTS), root, "comments")
    signals = spark.createDataFrame([("s", "c", "0", "sentiment", "v", 0.5, 1.0, 1.0, "m", day)], SIGNALS)
    signals = signals.withColumn("comment_date", F.lit("2024-01-09").cast("date"))
    write_table(signals, root, "extracted_signals")
    t = read_tables(spark, root, ["posts", "comments", "extracted_signals"])
    # Shuffle joins are what large inputs get.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    entities = spark.range(3).select(F.col("id").cast("string").alias("entity_id"), F.lit("n").alias("name"), F.lit("person").alias("entity_type"), "id")
    yield t.with_(monitored_entities=entities.withColumnRenamed("id", "load_order"))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.enabled")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_prune_partitions_and_columns(stored):
    text = plan(an.entity_totals(stored, "2024-01-08 00:00:00", "2024-01-20 00:00:00"))
    scans = [line for line in text.splitlines() if "FileScan" in line]
    assert any("created_date" in s and "PartitionFilters: [isnotnull(created_date#" in s for s in scans)
    assert any("signal_type" in s and "comment_date" in s and "PartitionFilters" in s for s in scans)
    # Neither texts nor raw JSON are read for a ranking.
    assert not any("text:" in s or "raw_data" in s for s in scans)


def test_distinct_count_reuses_the_join_partitioning(stored):
    text = plan(an.entity_totals(stored, "2024-01-08 00:00:00", "2024-01-20 00:00:00"))
    # Two sides of the fact join, the totals, the catalog side and at most the join with it.
    assert text.count("Exchange hashpartitioning(comment_id") == 2
    assert "Exchange hashpartitioning(entity_id" in text and "Expand" not in text


def test_top_per_entity_is_cut_before_the_shuffle(stored):
    assert plan(an.top_comments(stored, 3)).count("WindowGroupLimit") == 2


def test_few_texts_are_chosen_before_texts_are_moved(spark, stored):
    said = spark.createDataFrame([("p", "said"), ("q", "other")], "doc string, text string")
    comments = stored.comments.drop("text").join(said, F.col("post_id") == F.col("doc")).drop("doc")
    t = stored.with_(comments=comments)
    quotes = an.top_comments(t, 3, spark.createDataFrame([("0",)], "entity_id string"), stage=True)
    for df in (an.toxicity_alerts(t, "2024-01-12 00:00:00"), quotes):
        # The side of the texts is filtered by the posts of the kept comments below its exchange.
        below = plan(df).split("Exchange hashpartitioning(doc")[1].split("Exchange")[0]
        assert "array_contains" in below and "doc" in below
    assert [(r["comment_id"], r["text"]) for r in quotes.collect()] == [("c", "said")]
    # A comment without a post keeps its text.
    homeless = stored.with_(comments=stored.comments.withColumn("post_id", F.lit(None).cast("string")))
    assert [r["text"] for r in an.top_comments(homeless, 3, stage=True).collect()] == ["t"]


def test_no_cross_joins(spark, stored, catalog):
    comments = spark.createDataFrame([("1", "1", "t")], "comment_id string, post_id string, text string")
    posts = spark.createDataFrame([("1", "c")], "post_id string, caption string")
    text = plan(ma.catalog_mentions(comments, catalog, posts))
    assert "NestedLoop" not in text and "Cartesian" not in text
    for df in (an.velocity(stored, "2024-01-08"), an.top_posts(stored, "2024-01-01", "2024-01-08")):
        assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)


def test_matching_in_place_moves_no_comments(spark, stored, catalog):
    comments = spark.createDataFrame([("1", "1", "t")], "comment_id string, post_id string, text string")
    main = plan(ma.mention_arrays(comments, catalog)).split("Subquery")[0]
    assert "Exchange" not in main and "Join" not in main


def test_merges_combine_before_the_shuffle(spark):
    from hearsay.schemas import RAW_COMMENT

    text = plan(mg.fold_posts(mg.post_records(spark.createDataFrame([], RAW_COMMENT))))
    assert "partial_max_by" in text and "partial_min_by" in text


def test_words_of_storylines_end_at_marks_and_not_at_raised_digits(spark):
    from hearsay.plans.storylines import storyline_counts

    said = ["win", "win\u0301 win", "win\u200d", "win\u00b2", "wins, win_", "new show", "new-show", "new  show", "(win) -win- win"]
    frame = spark.createDataFrame([(t,) for t in said], "text string")
    counts = storyline_counts(frame, ["win", "new show", "wins?"], min_hits=0)
    assert {r["storyline"]: r["mention_count"] for r in counts.collect()} == {"win": 7, "new show": 1, "wins?": 8}
