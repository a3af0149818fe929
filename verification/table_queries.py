"""Sources, merges, id matching and streams (families A, B, E, H, J, K).

Exports are written by Spark from the test tables, then read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from hearsay import sinks
from hearsay.operators import idmatch as im
from hearsay.operators import merge as mg
from hearsay.operators.enrich import finish_signals
from hearsay.schemas import COMMENTS, DISCOVERED, ENTITIES, POST_TRACKER, POSTS, REVIEW_QUEUE, SIGNALS
from hearsay.session import scratch_path
from hearsay.sources import comments as cs
from hearsay.sources import posts as ps
from hearsay.sources import read_source, register_source
from hearsay.sources.catalog import read_entity_seed
from hearsay.streaming import jobs
from hearsay.tables import read_tables, write_table
from verification.core import VIEWS, Context, query
from verification.text_queries import RULE_SIGNALS_SQL

RUN = "2024-02-01 00:00:00"

VIEWS.update({
    "exports": """
        SELECT t.comment_id, concat('https://www.instagram.com/p/C', CAST(t.post_id AS VARCHAR(20)), '/') AS url,
          concat('C', CAST(t.post_id AS VARCHAR(20))) AS code, p.caption, t.author_name, t.text,
          substr(CAST(t.created_at AS VARCHAR(40)), 1, 19) AS said, t.likes, 1704067200 + t.comment_id AS epoch,
          CAST(3773020515456922670 + t.post_id * 7919 AS VARCHAR(20)) AS media_id
        FROM tcomments t JOIN tposts p ON p.post_id = t.post_id""",
    "post_rows": """
        SELECT doc_id, CAST(3773020515456922670 + doc_id * 7919 AS VARCHAR(20)) AS id, concat('C', CAST(doc_id AS VARCHAR(20))) AS code,
          text, lang, source, n_chars, 1704067200 + doc_id * 60 AS epoch FROM documents""",
    # Records of one ingest: an author repeats comments within a day.
    "records": """
        SELECT event_id, CASE WHEN event_type IN ('view', 'click', 'signup') THEN 0 ELSE 1 END AS batch, 'instagram' AS platform,
          concat('D', CAST(user_id % 50 AS VARCHAR(20))) AS code, concat('https://www.instagram.com/p/D', CAST(user_id % 50 AS VARCHAR(20)), '?r=', CAST(event_id AS VARCHAR(20))) AS url,
          CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE concat('caption ', CAST(event_id AS VARCHAR(20))) END AS caption,
          concat('subject ', CAST(event_id AS VARCHAR(20))) AS subject, concat('user_', CAST(user_id AS VARCHAR(20))) AS author,
          concat('says ', event_type) AS text, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS said,
          CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS likes, concat('raw ', CAST(event_id AS VARCHAR(20))) AS raw,
          event_id % 9 = 0 AS meta FROM events""",
    "media_ids": """
        SELECT e.comment_id AS event_id, CASE e.comment_id % 3 WHEN 0 THEN p.id WHEN 1 THEN concat(substr(p.id, 1, 16), '000') ELSE concat('9', substr(p.id, 2)) END AS media_id
        FROM comments e JOIN post_rows p ON p.doc_id = e.post_id""",
})


def run_ts():
    return F.lit(RUN).cast("timestamp")


def export_csv(c: Context, df, name: str, compression: str = "none", by: tuple[str, ...] = ()) -> str:
    """Write a test export, one below each value of ``by``; values may span lines. Compressed files are read whole by a task each."""
    path = scratch_path(c.spark, name)
    writer = df.write.options(compression=compression, header=True, escape='"', quoteAll=True)
    # lz4 in its slower form takes as much room as gzip, in less time.
    writer.option("io.compression.codec.lz4.use.lz4hc", "true").partitionBy(*by).csv(path)
    return path


def records(df):
    """The stable columns of raw comment records."""
    return df.select(
        "platform", "external_post_id", "post_url", "post_caption", "comment_author", "comment_text",
        F.unix_micros("comment_timestamp").alias("at_us"), "like_count")


def _record_sql(**columns: str) -> str:
    parts = {
        "platform": "'instagram'", "external_post_id": "code", "post_url": "url", "post_caption": "caption",
        "comment_author": "author_name", "comment_text": "text", "at_us": "epoch_us(CAST(said AS TIMESTAMP))", "like_count": "likes", **columns}
    return "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in parts.items()) + " FROM exports"


@query("a1_vendor_comments", _record_sql())
def _(c):
    rows = c.view("exports").select(
        F.col("url").alias("Post URL"), F.col("caption").alias("Caption"), F.lit("none").alias("Subject"),
        F.col("author_name").alias("Username"), F.col("text").alias("Comment"), F.col("said").alias("Timestamp"), F.col("likes").alias("Likes"))
    return records(cs.read_vendor_comments(c.spark, export_csv(c, rows, "vendor", "lz4")))


def _simple_rows(c):
    return c.view("exports").select(
        F.col("code").alias("shortCode"), "url", "caption", F.col("author_name").alias("ownerUsername"), "text",
        F.concat(F.replace("said", F.lit(" "), F.lit("T")), F.lit("Z")).alias("timestamp"), F.col("likes").alias("likesCount"))


@query("a2_simple_comments", _record_sql())
def _(c):
    return records(cs.read_simple_comments(c.spark, export_csv(c, _simple_rows(c), "simple", "lz4")))


def _raw_rows(c):
    return c.view("exports").select(
        "media_id", "text", F.when(F.col("comment_id") % 5 == 0, "").otherwise(F.col("author_name")).alias("user/username"),
        F.col("epoch").alias("created_at_utc"), F.lit(0).alias("comment_like_count"), F.col("likes").alias("like_count"),
        F.col("comment_id").alias("pk"), F.lit("True").alias("user/is_verified"))


_RAW_AUTHOR = "CASE WHEN comment_id % 5 = 0 THEN 'unknown' ELSE author_name END"


@query("a3_raw_comments", _record_sql(
    external_post_id="CASE WHEN likes >= 0 THEN code END", post_caption="CAST(NULL AS VARCHAR)", comment_author=_RAW_AUTHOR, at_us="epoch * 1000000"))
def _(c):
    path = export_csv(c, _raw_rows(c), "raw", "lz4")
    urls = c.view("exports").select("media_id", F.col("url").alias("post_url")).distinct()
    return records(cs.read_raw_comments(c.spark, path, urls))


@query("e10_constructed_urls", _record_sql(
    external_post_id="media_id", post_url="concat('https://www.instagram.com/p/', media_id, '/')", post_caption="CAST(NULL AS VARCHAR)",
    comment_author=_RAW_AUTHOR, at_us="epoch * 1000000"))
def _(c):
    return records(cs.read_raw_comments(c.spark, export_csv(c, _raw_rows(c), "raw", "lz4")))


@query("a4_layout_by_columns", _record_sql())
def _(c):
    return records(cs.read_comments(c.spark, export_csv(c, _simple_rows(c), "simple", "lz4")))


_POST_UPDATE = """SELECT platform, external_post_id, post_url, post_caption, at_us FROM (
    SELECT 'instagram' AS platform, unnest([code, id]) AS external_post_id, url AS post_url, text AS post_caption, epoch * 1000000 AS at_us
    FROM (SELECT *, concat('https://www.instagram.com/p/', code, '/') AS url FROM post_rows) p) u"""


def _post_rows(c, rows=None):
    return (c.view("post_rows") if rows is None else rows).select(
        "id", F.col("code").alias("shortCode"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("https://www.instagram.com/p/"), "code", F.lit("/"))).alias("url"),
        F.col("text").alias("caption"), F.col("epoch").alias("timestamp"), F.col("n_chars").alias("likesCount"),
        F.lit("12").alias("commentsCount"), F.col("lang").alias("type"), F.col("source").alias("ownerUsername"))


def _updates(df):
    return df.select("platform", "external_post_id", "post_url", "post_caption", F.unix_micros("posted_at").alias("at_us"))


@query("a5_post_updates", _POST_UPDATE)
def _(c):
    return _updates(ps.read_post_updates(c.spark, export_csv(c, _post_rows(c), "posts"), run_ts()))


def _in_files(df, files=5):
    """Rows by id over several part files, so that their order is the order of the files."""
    return df.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id")


def _metadata_rows(c):
    return _in_files(c.view("post_rows")).select(
        F.concat(F.lit("instagram://media?id="), F.when(F.col("doc_id") % 3 == 0, F.col("id")).otherwise(F.concat(F.substring("id", 1, 17), F.lit("77")))).alias("Post_Metadata/al:ios:url"),
        F.col("code").alias("Post_Metadata/shortcode"), F.col("text").alias("Post_Metadata/caption"), F.lit("").alias("Post_Metadata/og:url"),
        F.concat(F.lit("https://www.instagram.com/p/"), "code", F.lit("/")).alias("original_url"),
        F.concat(F.lit("about "), "source").alias("description"), F.col("epoch").cast("string").alias("upload_date"),
        F.concat(F.col("doc_id").cast("string"), F.lit("k")).alias("likes"), F.lit("7").alias("comments"), F.col("source").alias("author_username"))


@query("a6_metadata_updates", """SELECT 'instagram' AS platform, code AS external_post_id, concat('https://www.instagram.com/p/', code) AS post_url,
    text AS post_caption, epoch * 1000000 AS at_us, doc_id * 1000 AS likes_count FROM post_rows""")
def _(c):
    updates = ps.read_metadata_updates(c.spark, export_csv(c, _metadata_rows(c), "metadata"), run_ts())
    likes = F.get_json_object("raw", "$.post_metadata.likes_count").cast("bigint")
    return _updates(updates.withColumn("n", likes)).withColumn("k", F.lit(0)).drop("k").join(
        updates.select("external_post_id", likes.alias("likes_count")), "external_post_id")


@query("a7_dataset_scan", "SELECT file, count(*) AS rows, count(DISTINCT media_id) AS posts FROM (SELECT *, unnest([0, 1]) AS file FROM exports) e GROUP BY file")
def _(c):
    # One job writes both exports, so their texts are joined once.
    both = _raw_rows(c).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    path = export_csv(c, both, "raw", "lz4", by=("copy",))
    paths = [f"{path}/copy={i}" for i in range(2)]
    scan = cs.scan_dataset_comments(c.spark, [paths[0], paths[0] + "-missing", paths[1]])
    file = F.floor(F.col("seq") / (1 << 51)).cast("int").alias("file")
    return scan.groupBy(file).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("media_id").alias("posts"))


@query("a8_post_index", """SELECT id, code AS shortcode, text AS caption, n_chars AS likes_count, epoch * 1000000 AS at_us FROM post_rows""")
def _(c):
    rows = _post_rows(c)
    doubled = rows.withColumn("caption", F.lit("older")).unionByName(rows).unionByName(rows.withColumn("id", F.lit("")))
    index = ps.read_post_index(c.spark, export_csv(c, doubled, "posts"))
    return index.select("id", "shortcode", "caption", "likes_count", F.unix_micros("posted_at").alias("at_us"))


@query("a9_feed_items", _record_sql(external_post_id="code", post_caption="'shared'", comment_author=_RAW_AUTHOR, at_us="epoch * 1000000"))
def _(c):
    items = c.view("exports").select(
        F.col("comment_id").cast("string").alias("pk"), "text", F.col("epoch").cast("double").alias("created_at"),
        F.col("likes").alias("comment_like_count"), "media_id", F.col("url").alias("post_url"),
        F.when(F.col("comment_id") % 5 != 0, F.struct(F.col("author_name").alias("username"), F.lit("x").alias("full_name"))).alias("user"))
    path = scratch_path(c.spark, "feed")
    items.write.options(**{"compression": "lz4", "io.compression.codec.lz4.use.lz4hc": "true"}).json(path)
    feed = cs.read_feed(c.spark, path).withColumn("request_url", F.col("post_url"))
    return records(cs.feed_records(feed, caption=F.lit("shared")))


@query("a10_entity_seed", """SELECT name, entity_type, list_aggregate(aliases, 'string_agg', '|') AS aliases FROM (
    SELECT n_name AS name, 'brand' AS entity_type, ['known'] AS aliases FROM nation
    UNION ALL SELECT DISTINCT p_brand, 'person', [lower(p_brand), 'x'] FROM part) e""")
def _(c):
    seeds = c.raw("part").select(F.col("p_brand").alias("name")).distinct().union(c.raw("nation").select("n_name"))
    seeds = seeds.select("name", F.col("name").alias("canonical_name"), F.lit("PERSON").alias("entity_type"), F.array(F.lower("name"), F.lit("x")).alias("aliases"))
    path = scratch_path(c.spark, "seed")
    # One JSON array, as the seed file is.
    seeds.agg(F.to_json(F.collect_list(F.struct("*")))).write.text(path)
    known = c.raw("nation").select(
        F.col("n_nationkey").cast("string").alias("entity_id"), F.col("n_name").alias("name"), F.lit("brand").alias("entity_type"), F.array(F.lit("known")).alias("aliases"))
    grown = mg.seed_entities(known, read_entity_seed(c.spark, path))
    return grown.select("name", "entity_type", F.array_join("aliases", "|").alias("aliases"))


@query("a10_repeated_names", """SELECT name, entity_type, aliases FROM (SELECT p_brand AS name, 'brand' AS entity_type, lower(p_type) AS aliases,
    row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part) p WHERE rn = 1 AND name <> 'Brand#11'
  UNION ALL SELECT 'Brand#11', 'known', ''""")
def _(c):
    # A name many times in one seed file: the first counts, and none that the catalog holds.
    seeds = c.raw("part").select(
        F.lit("e").alias("entity_id"), F.col("p_brand").alias("name"), F.lit("brand").alias("entity_type"),
        F.array(F.lower("p_type")).alias("aliases"), F.col("p_partkey").alias("load_order"))
    known = c.spark.createDataFrame([("k", "Brand#11", "known", [], 0)], seeds.schema)
    grown = mg.seed_entities(known, seeds.repartition(7))
    return grown.select("name", "entity_type", F.array_join("aliases", "|").alias("aliases"))


@query("a11_stored_tables", "SELECT count(*) AS comments, CAST(sum(likes) AS BIGINT) AS likes, count(DISTINCT CAST(created_at AS DATE)) AS days FROM comments")
def _(c):
    root = scratch_path(c.spark, "tables")
    write_table(_as_comments(c.view("comments")), root, "comments")
    stored = read_tables(c.spark, root, ["comments"]).comments
    return stored.agg(F.count(F.lit(1)).alias("comments"), F.sum("likes").alias("likes"), F.countDistinct("created_date").alias("days"))


def _as_comments(df):
    columns = {"comment_id": F.col("comment_id").cast("string"), "post_id": F.col("post_id").cast("string"), "author_name": F.col("author_name"),
               "created_at": F.col("created_at"), "likes": F.col("likes")}
    return df.select(*[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in COMMENTS.fields])


# ------------------------------------------------------------------ merges


def _raw(c, batch: int | None = None):
    r = c.view("records")
    if batch is not None:
        r = r.filter(F.col("batch") == batch)
    return r.select(
        "platform", F.col("code").alias("external_post_id"), F.col("url").alias("post_url"), F.col("caption").alias("post_caption"),
        F.col("subject").alias("post_subject"), F.col("author").alias("comment_author"), F.col("text").alias("comment_text"),
        F.col("said").alias("comment_timestamp"), F.col("likes").alias("like_count"), "raw", F.col("meta").alias("has_post_metadata"),
        F.col("event_id").alias("seq"))


def _merged(c):
    """Two batches merged into empty tables, one after the other."""
    posts, comments = c.spark.createDataFrame([], POSTS), c.spark.createDataFrame([], COMMENTS)
    for batch in (0, 1):
        posts = mg.merge_posts(posts, mg.post_records(_raw(c, batch)))
        comments = mg.merge_comments(comments, _raw(c, batch))
        if batch == 0:
            posts, comments = posts.drop("action", "n_records"), comments.drop("action", "n_records")
    return posts, comments


@query("b1_post_upsert", """
  WITH r AS (SELECT *, batch * 1000000000 + event_id AS o FROM records)
  SELECT code AS external_id, arg_min(url, o) AS url, coalesce(arg_max(caption, o) FILTER (WHERE caption <> ''), arg_min_null(caption, o)) AS caption,
    arg_min(subject, o) AS subject_line, epoch_us(coalesce(arg_max(said, o) FILTER (WHERE meta), arg_min(said, o))) AS posted_at, arg_max(raw, o) AS raw_data
  FROM r GROUP BY code""")
def _(c):
    posts, _comments = _merged(c)
    return posts.select("external_id", "url", "caption", "subject_line", F.unix_micros("posted_at").alias("posted_at"), "raw_data")


@query("b2_comment_upsert", """SELECT code, author AS author_name, text, epoch_us(said) AS created_at, arg_max(likes, batch * 1000000000 + event_id) AS likes
  FROM records GROUP BY code, author, text, said""")
def _(c):
    posts, comments = _merged(c)
    codes = posts.select("post_id", F.col("external_id").alias("code"))
    return comments.join(codes, "post_id").select("code", "author_name", "text", F.unix_micros("created_at").alias("created_at"), "likes")


@query("b3_ingest_stats", """
  WITH b AS (SELECT * FROM records WHERE batch = 1), old AS (SELECT * FROM records WHERE batch = 0),
  p AS (SELECT count(DISTINCT code) FILTER (WHERE code NOT IN (SELECT code FROM old)) AS created, count(*) AS n FROM b),
  k AS (SELECT count(*) AS created FROM (SELECT DISTINCT code, author, text, said FROM b EXCEPT SELECT code, author, text, said FROM old) x)
  SELECT 'posts_created' AS stat, created AS count FROM p UNION ALL SELECT 'posts_updated', n - created FROM p
  UNION ALL SELECT 'comments_created', created FROM k UNION ALL SELECT 'comments_updated', p.n - k.created FROM p, k""")
def _(c):
    return mg.ingest_stats(*_merged(c))


def _model_signals(c, shift: float):
    rows = c.view("signals").withColumn("confidence", F.lit(0.5) + F.lit(shift)).withColumn("numeric_value", F.col("numeric_value") + F.lit(shift))
    return finish_signals(rows, run_ts(), F.lit("m"))


@query("b4_signal_upsert", """SELECT comment_id, entity_id, signal_type, value, CASE WHEN weight_score > 1.3 THEN numeric_value + 0.25 ELSE numeric_value END AS numeric_value,
    CASE WHEN weight_score > 1.3 THEN 0.75::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM signals WHERE weight_score > 1.3 OR signal_type <> 'topic'""")
def _(c):
    old = _model_signals(c, 0.0).filter("signal_type <> 'topic'")
    new = _model_signals(c, 0.25).filter("weight_score > 1.3")
    return mg.merge_signals(old, new).select("comment_id", "entity_id", "signal_type", "value", "numeric_value", "confidence")


@query("b4_repeated_signals", """SELECT comment_id, entity_id, signal_type, value, numeric_value + 0.25 AS numeric_value, 0.75::DOUBLE AS confidence FROM signals""")
def _(c):
    # Each signal comes three times in one batch; the last one counts, wherever it stands.
    turns = [_model_signals(c, x).withColumn("nth", F.lit(n)) for n, x in ((2, 0.25), (0, 0.75), (1, 0.5))]
    new = turns[0].unionByName(turns[1]).unionByName(turns[2]).withColumn("confidence", F.lit(1.0) - F.col("nth") / 8)
    old = _model_signals(c, 0.0)
    return mg.merge_signals(old, new, "nth").select("comment_id", "entity_id", "signal_type", "value", "numeric_value", "confidence")


@query("b5_discovered_merge", """
  WITH m AS (SELECT name, comment_id, created_at, substr(text, 1, 200) AS sample, CASE WHEN likes < 50 THEN 0 ELSE 1 END AS batch
    FROM source_mentions),
  s AS (SELECT *, row_number() OVER (PARTITION BY name, batch ORDER BY created_at, comment_id) AS rn FROM m),
  l AS (SELECT name, list(sample ORDER BY batch, created_at, comment_id) AS samples FROM s WHERE rn <= 10 GROUP BY name)
  SELECT m.name, count(*) AS mention_count, epoch_us(coalesce(min(created_at) FILTER (WHERE batch = 0), min(created_at))) AS first_seen,
    epoch_us(max(created_at)) AS last_seen, md5(list_aggregate(any_value(l.samples)[1:10], 'string_agg', '|')) AS samples
  FROM m JOIN l ON l.name = m.name GROUP BY m.name""")
def _(c):
    mentions = c.view("source_mentions").drop("said_id").withColumn("entity_type", F.lit("ORG"))
    empty = c.spark.createDataFrame([], DISCOVERED)
    first = mentions.filter("likes < 50")
    old = mg.merge_discovered(empty, first)
    # The second run sees all mentions again; those already counted change nothing.
    both = mg.merge_discovered(old, mentions, counted=first)
    return both.select("name", "mention_count", F.unix_micros("first_seen_at").alias("first_seen"), F.unix_micros("last_seen_at").alias("last_seen"),
                       F.md5(F.array_join("sample_mentions", "|")).alias("samples"))


def _queue(c):
    rows = c.sql("SELECT event_id, user_id, event_type, props, x FROM (SELECT e.*, s.x FROM events e JOIN scored s ON s.event_id = e.event_id) q")
    columns = {
        "review_id": F.concat(F.lit("r"), F.col("event_id").cast("string")), "comment_id": F.col("event_id").cast("string"),
        "entity_mention": F.concat(F.lit("name "), (F.col("user_id") % 5).cast("string")), "confidence": F.col("x"),
        "possible_entities": F.array(F.lit("a")), "reason": F.lit("old"), "reviewed": F.col("event_type") == "click"}
    return rows.select(*[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in REVIEW_QUEUE.fields])


@query("b6_review_merge", """
  SELECT CAST(event_id AS VARCHAR) AS comment_id, reviewed, reason, count(*) AS n FROM (
    SELECT event_id, event_type = 'click' AS reviewed, CASE WHEN event_type = 'click' THEN 'old' ELSE 'new' END AS reason FROM events
    UNION ALL SELECT event_id, false, 'new' FROM events WHERE event_type = 'click') q GROUP BY 1, 2, 3""")
def _(c):
    old = _queue(c)
    new = old.select("review_id", "comment_id", "entity_mention", "confidence", "possible_entities", F.lit("new").alias("reason"), F.lit(False).alias("reviewed"))
    return mg.merge_reviews(old, new).groupBy("comment_id", "reviewed", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("b7_csv_export", "SELECT doc_id, text, lang FROM documents")
def _(c):
    path = scratch_path(c.spark, "export")
    sinks.export_csv(c.raw("documents").select("doc_id", "text", "lang"), path)
    back = c.spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return back.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "lang")


@query("b9_tracker_merge", """SELECT code AS url, epoch_us(max(said)) AS last_scraped, arg_max(comment_count, said) AS comment_count FROM (
    SELECT code, said, max(likes) AS comment_count FROM records GROUP BY code, said) v GROUP BY code""")
def _(c):
    visits = c.view("records").groupBy(F.col("code").alias("url"), F.col("said").alias("last_scraped")).agg(F.max("likes").alias("comment_count"))
    old = mg.merge_tracker(c.spark.createDataFrame([], POST_TRACKER), visits.filter("last_scraped < '2024-01-15'"))
    return mg.merge_tracker(old, visits).select("url", F.unix_micros("last_scraped").alias("last_scraped"), "comment_count")


@query("b10_promote_entities", """SELECT source AS name, n >= 10 AND lower(source) <> 'src3' AS reviewed, CASE WHEN n >= 10 AND source <> 'src3' THEN 'added_to_monitored' END AS action_taken,
    source IN (SELECT source FROM documents GROUP BY source HAVING count(*) >= 10) OR source = 'src3' AS in_catalog FROM (SELECT source, count(*) AS n FROM documents GROUP BY source) d""")
def _(c):
    counts = c.raw("documents").groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("mention_count"))
    fill = {"name": F.col("name"), "mention_count": F.col("mention_count"), "reviewed": F.lit(False)}
    found = counts.select(*[fill.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in DISCOVERED.fields])
    row = {"entity_id": F.col("name"), "name": F.col("name"), "canonical_name": F.col("name"), "entity_type": F.lit("person")}
    named = counts.filter("mention_count >= 10").select(*[row.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ENTITIES.fields])
    catalog = named.limit(0).unionByName(counts.filter("name = 'src3'").select(*[row.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ENTITIES.fields]))
    grown, marked = mg.promote_entity(catalog, found, named, run_ts())
    return marked.join(grown.select("name", F.lit(True).alias("k")), "name", "left").select(
        "name", "reviewed", "action_taken", F.coalesce("k", F.lit(False)).alias("in_catalog"))


@query("b11_review_decisions", """SELECT comment_id, entity_id, value, numeric_value, weight_score FROM (
    SELECT CAST(event_id AS VARCHAR) AS comment_id, CAST(user_id % 25 AS VARCHAR) AS entity_id, x AS numeric_value, CAST(128 + k AS DOUBLE) / 128 AS weight_score,
      CASE WHEN x >= 0.7 THEN 'Strongly Positive' WHEN x >= 0.3 THEN 'Positive' WHEN x > -0.3 THEN 'Neutral' WHEN x > -0.7 THEN 'Negative' ELSE 'Strongly Negative' END AS value
    FROM scored WHERE user_id % 3 = 0 AND event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click')) d""")
def _(c):
    decisions = c.sql("SELECT event_id, user_id, x FROM scored").select(
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("review_id"),
        F.when(F.col("user_id") % 3 == 0, "assign").when(F.col("user_id") % 3 == 1, "ignore").otherwise("new_entity").alias("decision"),
        (F.col("user_id") % 25).cast("string").alias("assigned_entity_id"), F.col("x").alias("score"), F.lit("someone").alias("reviewed_by"))
    weights = c.view("signals").select(F.col("comment_id").cast("string").alias("comment_id"), "weight_score")
    _queue_after, signals = mg.review_decisions(_queue(c), decisions, weights, run_ts())
    return signals.select("comment_id", "entity_id", "value", "numeric_value", "weight_score")


# ------------------------------------------------------------- id matching

_MATCH = """
  WITH px AS (SELECT substr(id, 1, 15) AS pre, arg_max(id, doc_id) AS id FROM post_rows GROUP BY 1),
  m AS (SELECT event_id, m.media_id, coalesce(e.id, px.id) AS matched_id,
      CASE WHEN e.id IS NOT NULL THEN 'exact' WHEN px.id IS NOT NULL THEN 'prefix' ELSE 'none' END AS match_tier
    FROM media_ids m LEFT JOIN post_rows e ON e.id = m.media_id LEFT JOIN px ON px.pre = substr(m.media_id, 1, 15))"""


def _index(c):
    return c.view("post_rows").select("id", F.col("doc_id").alias("seq"))


@query("e2_rounded_ids", _MATCH + " SELECT * FROM m")
def _(c):
    return im.match_rounded(c.view("media_ids"), "media_id", _index(c))


@query("f21_match_stats", _MATCH + """ SELECT count(*) AS total_comments, count(CASE WHEN match_tier <> 'none' THEN 1 END) AS matched_comments,
    count(CASE WHEN match_tier = 'exact' THEN 1 END) AS exact_matches, count(CASE WHEN match_tier = 'prefix' THEN 1 END) AS prefix_matches,
    round_even(CAST(count(CASE WHEN match_tier <> 'none' THEN 1 END) AS DOUBLE) / count(*) * 100, 1) AS match_rate FROM m""")
def _(c):
    return im.match_stats(im.match_rounded(c.view("media_ids"), "media_id", _index(c)))


def _posts_and_metadata(c):
    # Posts of odd length have ids and codes that no metadata row names.
    known = F.col("n_chars") % 2 == 0
    rows = _in_files(c.view("post_rows").withColumns({
        "id": F.when(known, F.col("id")).otherwise(F.concat(F.lit("9"), F.substring("id", 2, 30))),
        "code": F.when(known, F.col("code")).otherwise(F.concat(F.lit("X"), "code"))}))
    index = ps.read_post_index(c.spark, export_csv(c, _post_rows(c, rows).withColumn(
        "likesCount", F.when(F.col("likesCount") % 4 == 0, F.col("likesCount"))), "posts"))
    return index, ps.read_metadata_index(c.spark, export_csv(c, _metadata_rows(c), "metadata"))


@query("e3_metadata_enrichment", """
  WITH p AS (SELECT * EXCLUDE (id, code), CASE WHEN n_chars % 2 = 0 THEN id ELSE concat('9', substr(id, 2)) END AS id,
    CASE WHEN n_chars % 2 = 0 THEN code ELSE concat('X', code) END AS code, CASE WHEN n_chars % 4 = 0 THEN n_chars END AS lc FROM post_rows),
  md AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN id ELSE concat(substr(id, 1, 17), '77') END AS mid FROM post_rows),
  px AS (SELECT substr(id, 1, 15) AS pre, arg_max(id, doc_id) AS id FROM p GROUP BY 1),
  f AS (SELECT md.*, coalesce(e.id, px.id, s.id) AS hit FROM md LEFT JOIN p e ON e.id = md.mid LEFT JOIN px ON px.pre = substr(md.mid, 1, 15) LEFT JOIN p s ON s.code = md.code),
  h AS (SELECT hit, arg_max(source, doc_id) AS src, arg_min(doc_id, doc_id) * 1000 AS lk FROM f WHERE hit IS NOT NULL GROUP BY hit)
  SELECT p.id, p.code AS shortcode, CASE WHEN h.hit IS NOT NULL THEN concat('about ', h.src) ELSE '' END AS description, coalesce(p.lc, h.lk) AS likes_count,
    h.hit IS NOT NULL AS has_metadata, false AS from_metadata FROM p LEFT JOIN h ON h.hit = p.id
  UNION ALL SELECT mid, arg_max(code, doc_id), concat('about ', arg_max(source, doc_id)), max(doc_id) * 1000, true, true FROM f WHERE hit IS NULL GROUP BY mid""")
def _(c):
    return im.enrich_posts(*_posts_and_metadata(c)).select("id", "shortcode", "description", "likes_count", "has_metadata", "from_metadata")


@query("e11_requested_urls", """
  WITH req AS (SELECT doc_id AS ord, concat('https://www.instagram.com/p/', id, '/') AS url, id FROM post_rows WHERE n_chars > 0)
  SELECT e.event_id AS pk, coalesce(r.url, (SELECT arg_min(url, ord) FROM req)) AS request_url FROM events e
  LEFT JOIN req r ON r.ord = e.event_id % (SELECT count(*) FROM documents) AND e.event_id % 3 <> 2""")
def _(c):
    requests = c.view("post_rows").select(F.col("doc_id").alias("ord"), F.concat(F.lit("https://www.instagram.com/p/"), "id", F.lit("/")).alias("url"))
    n = c.raw("documents").agg(F.count(F.lit(1)).alias("n")).scalar()
    keyed = c.raw("events").withColumn("_n", n).withColumn("ord", F.col("event_id") % F.col("_n"))
    joined = keyed.join(c.view("post_rows").select(F.col("doc_id").alias("ord"), "id"), "ord")
    kind = F.col("event_id") % 3
    items = joined.select(
        F.col("event_id").alias("pk"), F.when(kind == 0, F.concat(F.lit("https://www.instagram.com/p/"), "id", F.lit("/?x=1"))).alias("post_url"),
        F.lit(None).cast("string").alias("url"), F.when(kind == 1, F.col("id")).otherwise("").alias("media_id"))
    return im.assign_requests(items, requests).select("pk", "request_url")


@query("e12_due_for_refresh", """SELECT p.code FROM post_rows p LEFT JOIN (SELECT code, max(said) AS seen FROM records GROUP BY code) t
    ON concat('D', substr(p.code, 2)) = t.code WHERE t.seen IS NULL OR t.seen < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL '24' HOUR""")
def _(c):
    tracker = c.view("records").groupBy(F.col("code").alias("url")).agg(F.max("said").alias("last_scraped"))
    posts = c.view("post_rows").select("code", F.concat(F.lit("D"), F.expr("substr(code, 2)")).alias("url"))
    return im.due_for_refresh(posts, tracker, F.lit("2024-01-30 12:00:00").cast("timestamp")).select("code")


@query("g9_recently_visited", "SELECT code AS url, epoch_us(max(said)) AS last_scraped FROM records GROUP BY code ORDER BY max(said) DESC, code LIMIT 10")
def _(c):
    tracker = c.view("records").groupBy(F.col("code").alias("url")).agg(F.max("said").alias("last_scraped"))
    return im.recently_visited(tracker).select("url", F.unix_micros("last_scraped").alias("last_scraped"))


@query("f20_shared_urls", """SELECT source AS url, n AS n_posts, code AS external_id
  FROM (SELECT source, code, count(*) OVER (PARTITION BY source) AS n FROM post_rows) p WHERE n > 1""")
def _(c):
    posts = c.view("post_rows").select(F.col("source").alias("url"), F.col("code").alias("external_id"))
    return im.shared_urls(posts)


@query("f20_id_kinds", """SELECT count(*) AS total_posts, count(CASE WHEN x NOT LIKE '37%' THEN 1 END) AS shortcode_posts, count(CASE WHEN x LIKE '37%' THEN 1 END) AS numeric_posts
  FROM (SELECT unnest(CASE WHEN doc_id % 4 = 0 THEN [code, id] ELSE [code] END) AS x FROM post_rows) p""")
def _(c):
    ids = F.when(F.col("doc_id") % 4 == 0, F.array("code", "id")).otherwise(F.array("code"))
    return im.id_kinds(c.view("post_rows").select(F.explode(ids).alias("external_id")))


@query("h2_expected_ids", """SELECT id, 'missing' AS status FROM (SELECT code AS id FROM post_rows EXCEPT SELECT code FROM exports) a
  UNION ALL SELECT id, 'extra' FROM (SELECT code AS id FROM records EXCEPT SELECT code FROM post_rows) b""")
def _(c):
    expected = c.view("post_rows").select(F.col("code").alias("external_id"))
    present = c.view("exports").select(F.col("code").alias("external_id")).union(c.view("records").select("code"))
    return im.expected_against_present(expected, present)


@query("e2_merged_comments", """
  WITH px AS (SELECT substr(id, 1, 15) AS pre, arg_max(id, doc_id) AS id FROM post_rows GROUP BY 1)
  SELECT e.text AS comment_text, CAST(0 AS BIGINT) AS like_count, p.code AS external_post_id, p.text AS post_caption, p.n_chars AS post_likes, 'exact' AS match_tier
  FROM exports e JOIN post_rows p ON p.id = e.media_id""")
def _(c):
    index = ps.read_post_index(c.spark, export_csv(c, _post_rows(c), "posts", "lz4"))
    merged = cs.read_merged_comments(c.spark, [export_csv(c, _raw_rows(c), "raw", "lz4")], index, run_ts=run_ts())
    return merged.select("comment_text", "like_count", "external_post_id", "post_caption", "post_likes", "match_tier")


@query("b7_merged_records_view", """SELECT e.text AS comment_text, substr(p.text, 1, 200) AS post_caption, CAST(0 AS BIGINT) AS comment_likes
  FROM exports e JOIN post_rows p ON p.id = e.media_id""")
def _(c):
    index = ps.read_post_index(c.spark, export_csv(c, _post_rows(c), "posts", "lz4"))
    merged = cs.read_merged_comments(c.spark, [export_csv(c, _raw_rows(c), "raw", "lz4")], index, run_ts=run_ts(), caption_length=sinks.CAPTION_LENGTH)
    return sinks.merged_records_view(merged).select("comment_text", "post_caption", "comment_likes")


@query("k2_named_source", _record_sql())
def _(c):
    register_source("test_simple", cs.read_simple_comments)
    return records(read_source(c.spark, "test_simple", export_csv(c, _simple_rows(c), "simple", "lz4")))


# ----------------------------------------------------------------- streams


def _stream(c: Context, table: str):
    # A pattern, which may name one file or a folder of them; a stream takes no plain path of a file.
    return c.spark.readStream.schema(c.raw(table).schema).parquet(f"{c.sf_dir}/{table}.parque[t]")


def _fact_stream(c: Context):
    """Events as a stream of signals with their comment's time and likes."""
    kind = (F.when(F.col("event_type") == "signup", "emotion").when(F.col("event_type") == "error", "toxicity")
            .when((F.col("event_type") == "purchase") & (F.col("event_id") % 2 == 0), "stance")
            .when(F.col("event_type") == "purchase", "topic").otherwise("sentiment"))
    x = (F.round(F.col("value") * 100).cast("bigint") % 201 - 100).cast("double") / 128
    return _stream(c, "events").select(
        F.col("event_id").alias("comment_id"), F.when(F.col("user_id") % 7 != 0, F.col("user_id") % 25).alias("entity_id"),
        kind.alias("signal_type"), F.when(kind == "sentiment", x).when(kind == "toxicity", F.abs(x)).alias("numeric_value"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("likes"), F.col("ts").cast("timestamp").alias("created_at"))


def _collected(c: Context, stream, name: str):
    out = scratch_path(c.spark, name)
    jobs.append_batches(stream, out, scratch_path(c.spark, "progress")).awaitTermination()
    return c.spark.read.schema(stream.schema).parquet(out)


@query("j1_ingest_stream", """SELECT code, author AS author_name, text, epoch_us(said) AS created_at, arg_max(likes, event_id) AS likes
  FROM records GROUP BY code, author, text, said""")
def _(c):
    root = scratch_path(c.spark, "live")
    write_table(c.spark.createDataFrame([], POSTS), root, "posts")
    write_table(c.spark.createDataFrame([], COMMENTS), root, "comments")
    e = _stream(c, "events")
    code = F.concat(F.lit("D"), (F.col("user_id") % 50).cast("string"))
    live = e.select(
        F.lit("instagram").alias("platform"), code.alias("external_post_id"), code.alias("post_url"), F.lit(None).cast("string").alias("post_caption"),
        F.lit(None).cast("string").alias("post_subject"), F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("comment_author"),
        F.concat(F.lit("says "), "event_type").alias("comment_text"), F.to_date("ts").cast("timestamp").alias("comment_timestamp"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("like_count"), F.lit("{}").alias("raw"), F.lit(False).alias("has_post_metadata"),
        F.col("event_id").alias("seq"))
    jobs.ingest_stream(live, root, scratch_path(c.spark, "progress")).awaitTermination()
    stored = read_tables(c.spark, root, ["posts", "comments"])
    codes = stored.posts.select("post_id", F.col("external_id").alias("code"))
    return stored.comments.join(codes, "post_id").select("code", "author_name", "text", F.unix_micros("created_at").alias("created_at"), "likes")


@query("j2_enrich_stream", RULE_SIGNALS_SQL)
def _(c):
    from hearsay.plans.quality import signal_breakdown
    from hearsay.tables import Tables

    root = scratch_path(c.spark, "live")
    empty = c.spark.createDataFrame([], SIGNALS).withColumn("comment_date", F.lit(None).cast("date"))
    write_table(empty, root, "extracted_signals")
    replies = _stream(c, "conversations").filter("turn > 0").select(
        (F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("comment_id"), F.col("conv_id").alias("post_id"), "text",
        ((F.col("conv_id") * 7 + F.col("turn")) % 500).alias("likes"), F.lit(RUN).cast("timestamp").alias("created_at"))
    catalog = c.catalog().withColumn("entity_id", F.col("entity_id").cast("string"))
    jobs.enrich_stream(replies, catalog, c.view("tposts"), root, scratch_path(c.spark, "progress"), run_ts()).awaitTermination()
    return read_tables(c.spark, root, ["extracted_signals"]).extracted_signals.select(
        F.col("comment_id").cast("bigint").alias("comment_id"), F.col("entity_id").cast("bigint").alias("entity_id"), "value", "numeric_value",
        F.round("confidence", 6).alias("confidence"))


_CLOSED = "(SELECT max(created_at) FROM all_facts WHERE signal_type = 'sentiment' AND entity_id IS NOT NULL)"


@query("j3_live_velocity", f"""
  WITH h AS (SELECT entity_id, date_trunc('hour', created_at) AS hour, sum(numeric_value) AS s, count(*) AS n FROM all_facts
      WHERE signal_type = 'sentiment' AND entity_id IS NOT NULL AND date_trunc('hour', created_at) + INTERVAL '1' HOUR <= {_CLOSED} - INTERVAL '1' HOUR GROUP BY 1, 2),
  v AS (SELECT a.entity_id, a.hour, sum(CASE WHEN b.hour > a.hour - INTERVAL '72' HOUR THEN b.s END) / sum(CASE WHEN b.hour > a.hour - INTERVAL '72' HOUR THEN b.n END) AS r,
      CAST(sum(CASE WHEN b.hour > a.hour - INTERVAL '72' HOUR THEN b.n END) AS BIGINT) AS rn,
      sum(CASE WHEN b.hour <= a.hour - INTERVAL '72' HOUR THEN b.s END) / sum(CASE WHEN b.hour <= a.hour - INTERVAL '72' HOUR THEN b.n END) AS p,
      CAST(coalesce(sum(CASE WHEN b.hour <= a.hour - INTERVAL '72' HOUR THEN b.n END), 0) AS BIGINT) AS pn
    FROM h a JOIN h b ON a.entity_id = b.entity_id AND b.hour <= a.hour AND b.hour > a.hour - INTERVAL '144' HOUR GROUP BY a.entity_id, a.hour),
  ch AS (SELECT *, CASE WHEN p = 0 THEN 0 ELSE (r - p) / abs(p) * 100 END AS c FROM v WHERE rn >= 10 AND pn >= 10)
  SELECT entity_id, epoch_us(hour + INTERVAL '1' HOUR) AS as_of, round_even(r, 3) AS recent_sentiment, round_even(p, 3) AS previous_sentiment,
    round_even(c, 1) AS percent_change, rn AS recent_count, pn AS previous_count, abs(c) > 30 AS alert, CASE WHEN c > 0 THEN 'up' ELSE 'down' END AS direction FROM ch""")
def _(c):
    return _live_velocity(c).filter("hour_count > 0").drop("hour_count")


def _live_velocity(c: Context):
    from hearsay.streaming.velocity import ROCKSDB, STATE_STORE, live_velocity_stream

    before = c.spark.conf.get(STATE_STORE)
    c.spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        return _collected(c, live_velocity_stream(_fact_stream(c)), "velocity").withColumn("as_of", F.unix_micros("as_of"))
    finally:
        c.spark.conf.set(STATE_STORE, before)


@query("j3_hourly_velocity", f"""
  WITH h AS (SELECT entity_id, date_trunc('hour', created_at) AS hour, sum(numeric_value) AS s, count(*) AS n FROM all_facts
      WHERE signal_type = 'sentiment' AND entity_id IS NOT NULL AND date_trunc('hour', created_at) + INTERVAL '1' HOUR <= {_CLOSED} - INTERVAL '1' HOUR GROUP BY 1, 2),
  every AS (SELECT entity_id, unnest(generate_series(lo, {_CLOSED} - INTERVAL '2' HOUR, INTERVAL '1' HOUR)) AS hour FROM (SELECT entity_id, min(hour) AS lo FROM h GROUP BY 1)),
  v AS (SELECT a.entity_id, a.hour, sum(CASE WHEN b.hour > a.hour - INTERVAL '72' HOUR THEN b.s END) / sum(CASE WHEN b.hour > a.hour - INTERVAL '72' HOUR THEN b.n END) AS r,
      CAST(coalesce(sum(CASE WHEN b.hour > a.hour - INTERVAL '72' HOUR THEN b.n END), 0) AS BIGINT) AS rn,
      sum(CASE WHEN b.hour <= a.hour - INTERVAL '72' HOUR THEN b.s END) / sum(CASE WHEN b.hour <= a.hour - INTERVAL '72' HOUR THEN b.n END) AS p,
      CAST(coalesce(sum(CASE WHEN b.hour <= a.hour - INTERVAL '72' HOUR THEN b.n END), 0) AS BIGINT) AS pn,
      CAST(coalesce(sum(CASE WHEN b.hour = a.hour THEN b.n END), 0) AS BIGINT) AS hn
    FROM every a JOIN h b ON a.entity_id = b.entity_id AND b.hour <= a.hour AND b.hour > a.hour - INTERVAL '144' HOUR GROUP BY a.entity_id, a.hour),
  ch AS (SELECT *, CASE WHEN p = 0 THEN 0 ELSE (r - p) / abs(p) * 100 END AS c FROM v WHERE rn >= 10 AND pn >= 10)
  SELECT entity_id, epoch_us(hour + INTERVAL '1' HOUR) AS as_of, round_even(r, 3) AS recent_sentiment, round_even(p, 3) AS previous_sentiment,
    round_even(c, 1) AS percent_change, rn AS recent_count, pn AS previous_count, abs(c) > 30 AS alert, CASE WHEN c > 0 THEN 'up' ELSE 'down' END AS direction,
    hn AS hour_count FROM ch""")
def _(c):
    return _live_velocity(c)


@query("j4_toxicity_stream", "SELECT comment_id, likes, numeric_value AS toxicity FROM all_facts WHERE signal_type = 'toxicity' AND numeric_value >= 0.7")
def _(c):
    return _collected(c, jobs.toxicity_stream(_fact_stream(c)), "toxic").select("comment_id", "likes", "toxicity")


@query("j5_daily_history_stream", f"""SELECT entity_id, CAST(created_at AS DATE) AS date, avg(numeric_value) AS avg_sentiment, count(DISTINCT comment_id) AS mention_count,
    CAST(sum(likes) AS BIGINT) AS total_likes FROM all_facts WHERE signal_type = 'sentiment' AND entity_id IS NOT NULL
    AND date_trunc('day', created_at) + INTERVAL '1' DAY <= {_CLOSED} - INTERVAL '1' DAY GROUP BY 1, 2""")
def _(c):
    return _collected(c, jobs.daily_history_stream(_fact_stream(c)), "daily")
