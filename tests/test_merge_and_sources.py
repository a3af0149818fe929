import os

import pytest
from pyspark.sql import functions as F

from hearsay.operators import idmatch as im
from hearsay.operators import merge as mg
from hearsay.schemas import COMMENTS, DISCOVERED, POSTS, RAW_COMMENT, REVIEW_QUEUE, SIGNALS
from hearsay.session import scratch_path
from hearsay.sources import comments as cs
from hearsay.sources import posts as ps
from hearsay.sources import read_source, register_source
from hearsay.tables import overwrite_partitions, read_tables, write_table


def raw(spark, *records):
    """(seq, post, caption, author, text, time, likes, has metadata)"""
    rows = [("instagram", p, f"u{s}", c, f"s{s}", a, t, _ts(at), likes, f"raw{s}", meta, s) for s, p, c, a, t, at, likes, meta in records]
    return spark.createDataFrame(rows, RAW_COMMENT)


def _ts(text):
    from datetime import datetime

    return datetime.fromisoformat(text)


BATCH = [
    (1, "P1", None, "ann", "hi", "2024-01-01 10:00:00", 42, False),
    (2, "P1", "cap", "bob", "yo", "2024-01-01 11:00:00", 1, False),
    (3, "P1", "", "ann", "hi", "2024-01-01 10:00:00", 100, False),
    (4, "P2", "two", "cat", "so", "2024-01-02 09:00:00", 5, True),
]


def merged(spark, posts, comments, records):
    return mg.merge_posts(posts, mg.post_records(records)), mg.merge_comments(comments, records)


def test_reingest_changes_nothing(spark, rows):
    records = raw(spark, *BATCH)
    p1, c1 = merged(spark, spark.createDataFrame([], POSTS), spark.createDataFrame([], COMMENTS), records)
    assert dict(rows(mg.ingest_stats(p1, c1))) == {"posts_created": 2, "posts_updated": 2, "comments_created": 3, "comments_updated": 1}
    stored = p1.drop("action", "n_records"), c1.drop("action", "n_records")
    p2, c2 = merged(spark, *stored, records)
    assert dict(rows(mg.ingest_stats(p2, c2))) == {"posts_created": 0, "posts_updated": 4, "comments_created": 0, "comments_updated": 4}
    assert rows(p2.drop("action", "n_records")) == rows(stored[0])
    assert rows(c2.drop("action", "n_records")) == rows(stored[1])
    assert rows(c2, "author_name", "likes") == [("ann", 100), ("bob", 1), ("cat", 5)]
    assert rows(p2, "external_id", "url", "caption", "subject_line", "raw_data") == [("P1", "u1", "cap", "s1", "raw3"), ("P2", "u4", "two", "s4", "raw4")]


def test_fold_does_not_depend_on_row_order(spark, rows):
    def fold(records):
        posts, comments = merged(spark, spark.createDataFrame([], POSTS), spark.createDataFrame([], COMMENTS), raw(spark, *records))
        return rows(posts), rows(comments)

    assert fold(BATCH) == fold(BATCH[::-1])


def test_post_time_needs_metadata(spark, rows):
    old = mg.merge_posts(spark.createDataFrame([], POSTS), mg.post_records(raw(spark, BATCH[0]))).drop("action", "n_records")
    plain = mg.merge_posts(old, mg.post_records(raw(spark, (9, "P1", "new", "z", "z", "2024-02-01 00:00:00", 0, False))))
    known = mg.merge_posts(old, mg.post_records(raw(spark, (9, "P1", "", "z", "z", "2024-02-01 00:00:00", 0, True))))
    assert rows(plain, "caption", F.to_date("posted_at").cast("string")) == [("new", "2024-01-01")]
    assert rows(known, "caption", F.to_date("posted_at").cast("string")) == [(None, "2024-02-01")]


def test_only_touched_days_are_rewritten(spark, rows):
    root = scratch_path(spark, "tables")
    for name, schema in (("posts", POSTS), ("comments", COMMENTS)):
        write_table(spark.createDataFrame([], schema), root, name)

    def load(records):
        stored = read_tables(spark, root, ["posts", "comments"])
        mg.apply_posts(root, stored.posts, mg.post_records(records))
        mg.apply_comments(root, stored.comments, records)

    load(raw(spark, *BATCH))
    day = os.path.join(root, "comments", "created_date=2024-01-01")
    before = sorted(os.listdir(day))
    load(raw(spark, (7, "P2", None, "cat", "so", "2024-01-02 09:00:00", 77, False)))
    assert sorted(os.listdir(day)) == before
    stored = read_tables(spark, root, ["posts", "comments"])
    assert rows(stored.comments, "author_name", "likes") == [("ann", 100), ("bob", 1), ("cat", 77)]
    assert stored.posts.count() == 2


def signals(spark, *items):
    from hearsay.operators.enrich import finish_signals

    df = spark.createDataFrame([(*i, 1.0, 0.8) for i in items], "comment_id string, entity_id string, signal_type string, value string, numeric_value double, weight_score double, confidence double")
    return finish_signals(df, F.timestamp_seconds(F.lit(0)), F.lit("m"))


def test_signal_merge_treats_missing_entity_as_a_value(spark, rows):
    first = signals(spark, ("c", None, "sentiment", "a", 0.1), ("c", "e", "sentiment", "b", 0.2), ("c", None, "topic", "t1", None))
    second = signals(spark, ("c", None, "sentiment", "z", 0.9), ("c", None, "topic", "t2", None))
    once = mg.merge_signals(spark.createDataFrame([], SIGNALS), first)
    twice = mg.merge_signals(mg.merge_signals(once, second), second)
    assert rows(twice, "entity_id", "signal_type", "value") == [("e", "sentiment", "b"), (None, "sentiment", "z"), (None, "topic", "t1"), (None, "topic", "t2")]


def test_discovered_rerun_adds_nothing(spark, rows):
    mentions = spark.createDataFrame(
        [(f"c{i}", "Jane", "PERSON", _ts(f"2024-01-{i + 1:02d} 00:00:00"), f"text {i}") for i in range(12)],
        "comment_id string, name string, entity_type string, created_at timestamp, text string")
    once = mg.merge_discovered(spark.createDataFrame([], DISCOVERED), mentions)
    again = mg.merge_discovered(once, mentions, counted=mentions)
    assert rows(again) == rows(once)
    (name, count, samples), = rows(once, "name", "mention_count", "sample_mentions")
    assert (name, count) == ("Jane", 12) and samples == [f"text {i}" for i in range(10)]


def test_review_merge_opens_a_new_item_after_review(spark, rows):
    def queue(*items):
        fill = {"reviewed": 3, "reason": 2, "entity_mention": 1, "comment_id": 0}
        return spark.createDataFrame([tuple(i[fill[f.name]] if f.name in fill else None for f in REVIEW_QUEUE.fields) for i in items], REVIEW_QUEUE)

    old = queue(("c1", "Ryan", "old", False), ("c2", "Ryan", "old", True))
    new = queue(("c1", "Ryan", "new", False), ("c2", "Ryan", "new", False)).select("comment_id", "entity_mention", "reason", "reviewed")
    assert rows(mg.merge_reviews(old, new), "comment_id", "reason", "reviewed") == [("c1", "new", False), ("c2", "new", False), ("c2", "old", True)]


def test_one_decision_on_a_mention_queued_again_gives_one_signal(spark, rows):
    fill = {"review_id": "r1", "comment_id": "c1", "entity_mention": "Ryan", "reviewed": False}
    new = spark.createDataFrame([tuple(fill.get(f.name) for f in REVIEW_QUEUE.fields)], REVIEW_QUEUE)
    likes = spark.createDataFrame([("c1", 1.0)], "comment_id string, weight_score double")

    def decide(queue, review_id, entity):
        decisions = spark.createDataFrame(
            [(review_id, "assign", entity, 0.5, "ann")], "review_id string, decision string, assigned_entity_id string, score double, reviewed_by string")
        return mg.review_decisions(queue, decisions, likes, F.timestamp_seconds(F.lit(0)))

    first, signals = decide(mg.merge_reviews(spark.createDataFrame([], REVIEW_QUEUE), new), "r1", "e1")
    assert signals.count() == 1
    queued = mg.merge_reviews(first, new)
    assert rows(queued, "review_id", "reviewed") == [("r1", True), ("r1-1", False)]
    assert decide(queued, "r1", "e2")[1].count() == 0
    second, signals = decide(queued, "r1-1", "e2")
    assert rows(signals, "entity_id") == [("e2",)]
    assert rows(second, "review_id", "assigned_entity_id") == [("r1", "e1"), ("r1-1", "e2")]


def test_requests_are_found_wherever_the_url_holds_them(spark, rows):
    requests = spark.createDataFrame([(1, "i.com/p/AB"), (2, "https://i.com/p/ABC"), (3, "https://i.com/3773"), (4, "i.com/p/AB")], "ord int, url string")
    items = spark.createDataFrame(
        [("a", "https://i.com/p/ABCD/", None, ""), ("b", "", "https://i.com/p/Z", "3773"), ("c", None, None, None), ("d", "https://i.com/P/AB", None, "9"), ("a", "https://i.com/p/ABCD/", None, "")],
        "pk string, post_url string, url string, media_id string")
    got = rows(im.assign_requests(items, requests), "pk", "request_url")
    assert got == [("a", "i.com/p/AB"), ("a", "i.com/p/AB"), ("b", "https://i.com/3773"), ("c", "i.com/p/AB"), ("d", "i.com/p/AB")]


# ----------------------------------------------------------------- sources


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_vendor_layout_with_bom_and_lines(spark, rows, tmp_path):
    path = write(tmp_path, "v.csv", '﻿Post URL,Username,Comment,Timestamp,Likes\nhttps://i.com/p/A1/,ann,"two\nlines, ""quoted""",2024-01-01 10:00:00,3\n')
    got = rows(read_source(spark, "vendor", path), "external_post_id", "comment_author", "comment_text", "like_count", "post_caption")
    assert got == [("A1", "ann", 'two\nlines, "quoted"', 3, None)]


def test_malformed_exports_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="missing columns: Comment, Timestamp"):
        cs.read_vendor_comments(spark, write(tmp_path, "m.csv", "Post URL,Username\nx,y\n"))
    with pytest.raises(ValueError, match="unknown layout"):
        cs.read_comments(spark, write(tmp_path, "u.csv", "a,b\n1,2\n"))
    with pytest.raises(ValueError, match="unknown source"):
        read_source(spark, "nowhere", "x")
    register_source("broken", lambda s, p: s.range(1))
    with pytest.raises(ValueError, match="lacks columns"):
        read_source(spark, "broken", "x")


def test_layout_is_chosen_by_columns(spark, rows, tmp_path):
    simple = write(tmp_path, "s.csv", "shortCode,url,caption,ownerUsername,text,timestamp,likesCount\nS1,https://i.com/p/S1/,cap,ann,hi,2024-01-01T10:00:00Z,4\n")
    dataset = write(tmp_path, "d.csv", "media_id,text,user/username,created_at,comment_like_count\n377,yo,,1704103200,2\n")
    assert rows(cs.read_comments(spark, simple), "external_post_id", "like_count") == [("S1", 4)]
    assert rows(cs.read_comments(spark, dataset), "external_post_id", "comment_author", "post_url", F.unix_seconds("comment_timestamp")) == [
        ("377", "unknown", "https://www.instagram.com/p/377/", 1704103200)]


def test_rounded_ids(spark, rows, tmp_path):
    posts = write(tmp_path, "p.csv", "id,shortCode,url,caption,timestamp,likesCount\n3773020515456922670,C1,https://i.com/p/C1/,cap,1704067200,\n,X,,,,\n")
    meta = write(tmp_path, "m.csv", (
        "Post_Metadata/al:ios:url,Post_Metadata/shortcode,description,likes,comments,original_url\n"
        "instagram://media?id=3773020515456922671,C1,better,46k,7,\ninstagram://media?id=4000000000000000000,C9,new one,1.2m,,https://i.com/p/C9/\n,,no id,,,\n"))
    comments = write(tmp_path, "c.csv", (
        "media_id,text,user/username,created_at,comment_like_count,pk\n3773020515456922000,a,ann,1704103200,1,9\n"
        "4000000000000000000,b,bob,soon,2,8\n9999999999999999999,c,cat,1704103200,3,7\n"))
    index, metadata = ps.read_post_index(spark, posts), ps.read_metadata_index(spark, meta)
    assert rows(im.enrich_posts(index, metadata), "id", "description", "likes_count", "from_metadata") == [
        ("3773020515456922670", "better", 46000, False), ("4000000000000000000", "new one", 1200000, True)]
    run_ts = F.lit("2024-03-01 00:00:00").cast("timestamp")
    got = cs.read_merged_comments(spark, [comments, comments + ".missing"], index, metadata, run_ts)
    assert rows(got, "comment_author", "external_post_id", "post_caption", F.to_date("comment_timestamp").cast("string")) == [
        ("ann", "C1", "better", "2024-01-01"), ("bob", "C9", "new one", "2024-03-01")]


def test_partition_overwrite_is_repeatable(spark, rows):
    root = scratch_path(spark, "tables")
    df = spark.createDataFrame([("c1", "p", "a", "t", _ts("2024-01-01 00:00:00"), 1, 0, None, "direct", None)], COMMENTS)
    for _ in range(2):
        overwrite_partitions(df, root, "comments")
    assert read_tables(spark, root, ["comments"]).comments.count() == 1


def test_comments_without_a_time_survive_a_later_batch(spark):
    """The partition of the missing day is merged, not replaced."""
    root = scratch_path(spark, "null-day")
    write_table(spark.createDataFrame([], POSTS), root, "posts")
    write_table(spark.createDataFrame([], COMMENTS), root, "comments")
    for author in ("ann", "bob"):
        row = ("instagram", "P1", "u", None, "s", author, "hi", None, 1, "raw", False, 1)
        stored = read_tables(spark, root, ["comments"])
        mg.apply_comments(root, stored.comments, spark.createDataFrame([row], RAW_COMMENT))
    kept = read_tables(spark, root, ["comments"]).comments
    assert sorted(r.author_name for r in kept.collect()) == ["ann", "bob"]


def test_a_repeated_signal_is_inserted_once(spark):
    row = ("s1", "c1", None, "topic", "x", None, 1.0, 1.0, "m", _ts("2024-01-01 00:00:00"))
    names = ["signal_id", "comment_id", "entity_id", "signal_type", "value", "numeric_value", "weight_score", "confidence", "source_model", "created_at"]
    kind = SIGNALS
    if set(names) <= {f.name for f in SIGNALS.fields}:
        from pyspark.sql.types import StructType

        kind = StructType([SIGNALS[n] for n in names])
    new = spark.createDataFrame([row, row], kind)
    assert mg.merge_signals(spark.createDataFrame([], kind), new).count() == 1


def test_discovered_names_are_written_back(spark):
    """A merge is written over the table that it reads; counting the same mentions again changes nothing."""
    root = scratch_path(spark, "names")
    write_table(spark.createDataFrame([], DISCOVERED), root, "discovered_entities")
    kind = "comment_id string, name string, entity_type string, created_at timestamp, text string"
    first = [("c1", "Ann", "PERSON", _ts("2024-01-01 00:00:00"), "one"), ("c2", "Ann", "PERSON", _ts("2024-01-02 00:00:00"), "two")]
    runs = [(first, []), (first + [("c3", "Bob", "PERSON", _ts("2024-01-03 00:00:00"), "three")], first)]
    for mentions, counted in runs:
        old = read_tables(spark, root, ["discovered_entities"]).discovered_entities
        both = mg.merge_discovered(old, spark.createDataFrame(mentions, kind), counted=spark.createDataFrame(counted, kind))
        mg.replace_table(root, "discovered_entities", both)
    stored = read_tables(spark, root, ["discovered_entities"]).discovered_entities
    assert sorted((r.name, r.mention_count, r.sample_mentions) for r in stored.collect()) == [("Ann", 2, ["one", "two"]), ("Bob", 1, ["three"])]


def test_records_of_many_files_keep_their_order(spark):
    """Rows are numbered by file name and place in the file; larger files do not come first."""
    from hearsay.sources.csvfiles import read_strings

    path = scratch_path(spark, "files")
    df = spark.range(40).select(F.col("id").cast("string").alias("n"), F.repeat(F.lit("x"), (F.col("id") % 7 * 50).cast("int")).alias("fill"))
    df.repartitionByRange(6, F.col("n").cast("int")).sortWithinPartitions(F.col("n").cast("int")).write.option("header", True).csv(path)
    got = read_strings(spark, path).orderBy("seq").collect()
    assert [int(r.n) for r in got] == list(range(40))
    assert len({r.seq for r in got}) == 40


def test_merged_comments_meet_their_posts_in_one_join(spark, tmp_path):
    """Ids and posts are joined among themselves first: the texts of comments move once."""
    from hearsay.sources.comments import read_merged_comments

    raw = spark.createDataFrame([("37730205154569226", "a"), ("37730205154569200", "b"), ("9", "c")], "media_id string, text string")
    raw.write.option("header", True).csv(f"{tmp_path}/raw")
    posts = spark.createDataFrame(
        [("37730205154569226", "C1", "u", "caption", 5, 0)], "id string, shortcode string, url string, caption string, likes_count long, seq long")
    merged = read_merged_comments(spark, [f"{tmp_path}/raw"], posts)
    assert sorted(tuple(r) for r in merged.select("comment_text", "match_tier", "post_caption").collect()) == [
        ("a", "exact", "caption"), ("b", "prefix", "caption")]
    lines = merged._jdf.queryExecution().optimizedPlan().toString().split("\n")
    top = next(i for i, line in enumerate(lines) if "Join" in line)
    column = lines[top + 1].index(":")
    left = []
    for line in lines[top + 1:]:
        if line[column:column + 1] != ":":
            break
        left.append(line)
    # One join: of the lines with the listing of the files.
    assert sum("Join" in line for line in left) == 1


def test_urls_and_short_captions_meet_the_comments_where_they_are(spark, monkeypatch, tmp_path):
    """While the posts are few, no text of a comment is shuffled for them; beyond that the result is the same."""
    from hearsay import sinks, sizing

    raw = spark.createDataFrame([("37730205154569226", "a"), ("37730205154569200", "b"), ("9", "c"), (None, "d")], "media_id string, text string")
    raw.write.option("header", True).csv(f"{tmp_path}/raw")
    urls = spark.createDataFrame([("9", "https://www.instagram.com/p/C9/"), ("8", "x"), ("37730205154569200", "")], "media_id string, post_url string")
    posts = spark.createDataFrame(
        [("37730205154569226", "C1", "u", "y" * 300, 5, 0)], "id string, shortcode string, url string, caption string, likes_count long, seq long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most in (sizing.BESIDE_BYTES, 0):
            monkeypatch.setattr(sizing.beside, "__defaults__", (most,))
            named = cs.read_raw_comments(spark, f"{tmp_path}/raw", urls)
            merged = sinks.merged_records_view(cs.read_merged_comments(spark, [f"{tmp_path}/raw"], posts, caption_length=sinks.CAPTION_LENGTH))
            assert sorted(map(repr, (tuple(r) for r in named.select("comment_text", "post_url").collect()))) == sorted(map(repr, [
                ("a", "https://www.instagram.com/p/37730205154569226/"), ("b", "https://www.instagram.com/p/37730205154569200/"),
                ("c", "https://www.instagram.com/p/C9/"), ("d", None)]))
            assert sorted(tuple(r) for r in merged.select("comment_text", "post_caption").collect()) == [("a", "y" * 200), ("b", "y" * 200)]
            for df in (named, merged):
                plan = df._jdf.queryExecution().executedPlan().toString()
                assert ("SortMergeJoin" in plan) == (most == 0)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_an_index_moves_its_posts_only_where_they_are_wanted(spark):
    """Who takes the key and the order of the last rows leaves the rest behind."""
    posts = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("b", None, 3), ("c", "x", None)], "id string, caption string, seq long")
    last = im.keep_last(posts, "id")
    assert sorted(map(repr, (tuple(r) for r in last.collect()))) == sorted(map(repr, [("a", "new", 2), ("b", None, 3), ("c", None, None)]))
    assert "max_by" in last._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" not in last.select("id", "seq")._jdf.queryExecution().optimizedPlan().toString()


def test_samples_of_names_are_cut_before_they_move(spark):
    kind = "comment_id string, name string, entity_type string, created_at timestamp, text string"
    mentions = spark.createDataFrame([(f"c{i}", "Ann", "PERSON", _ts("2024-01-01 00:00:00"), f"{i}" * 500) for i in range(3)], kind)
    both = mg.merge_discovered(spark.createDataFrame([], DISCOVERED), mentions, counted=mentions.limit(1))
    assert [[len(x) for x in r.sample_mentions] for r in both.collect()] == [[200, 200]]
    lines = both._jdf.queryExecution().optimizedPlan().toString().split("\n")
    anti = [at for at, line in enumerate(lines) if "LeftAnti" in line]
    # Below the join that drops counted mentions, not above it.
    assert anti and any("substring" in line for line in lines[anti[-1]:]) and not any("substring" in line for line in lines[:anti[0]])
