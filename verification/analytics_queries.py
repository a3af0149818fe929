"""Aggregations, rankings and report lists (families F, G, H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearsay.plans import analytics as an
from hearsay.plans import quality as qa
from hearsay.plans.facts import signal_facts
from verification.core import AS_OF, END, START, query, rounded

_WSENT = """CASE WHEN sum(weight_score) > 0 THEN sum(numeric_value * weight_score) / sum(weight_score)
    ELSE avg(numeric_value) END"""

_TOTALS = f"""SELECT e.entity_id, e.name AS entity_name, e.entity_type,
    count(DISTINCT f.comment_id) AS mention_count, avg(f.numeric_value) AS avg_sentiment,
    CAST(sum(f.likes) AS BIGINT) AS total_likes, {_WSENT} AS weighted_sentiment
  FROM facts f JOIN entities e ON f.entity_id = e.entity_id JOIN posts p ON f.post_id = p.post_id
  WHERE f.signal_type = 'sentiment' AND f.numeric_value IS NOT NULL %s
  GROUP BY e.entity_id, e.name, e.entity_type"""


@query("f1_top_entities", _TOTALS % "" + " ORDER BY mention_count DESC, entity_id LIMIT 20")
def _(c):
    return an.top_entities(c.tables(), START, END)


@query(
    "f1_top_entities_by_platform",
    _TOTALS % "AND p.platform IN ('youtube', 'tiktok')" + " ORDER BY mention_count DESC, entity_id LIMIT 20",
)
def _(c):
    top = an.top_entities(c.tables(), START, END, ["youtube", "tiktok"])
    return top


@query(
    "g11_top_entities_by_type",
    f"SELECT * FROM ({_TOTALS % ''}) t WHERE entity_type IN ('person', 'brand') ORDER BY mention_count DESC, entity_id LIMIT 10",
)
def _(c):
    top = an.top_entities(c.tables(), START, END, limit=10, entity_types=["person", "brand"])
    return top


def _velocity_sql(as_of: str, hours: int) -> str:
    return f"""
  WITH sides AS (
    SELECT entity_id,
      avg(CASE WHEN created_at >= TIMESTAMP '{as_of}' - INTERVAL '{hours}' HOUR THEN numeric_value END) AS r,
      count(CASE WHEN created_at >= TIMESTAMP '{as_of}' - INTERVAL '{hours}' HOUR THEN 1 END) AS rn,
      avg(CASE WHEN created_at <= TIMESTAMP '{as_of}' - INTERVAL '{hours}' HOUR THEN numeric_value END) AS p,
      count(CASE WHEN created_at <= TIMESTAMP '{as_of}' - INTERVAL '{hours}' HOUR THEN 1 END) AS pn
    FROM all_facts WHERE signal_type = 'sentiment' AND entity_id IS NOT NULL AND numeric_value IS NOT NULL
      AND created_at BETWEEN TIMESTAMP '{as_of}' - INTERVAL '{2 * hours}' HOUR AND TIMESTAMP '{as_of}'
    GROUP BY entity_id),
  changed AS (
    SELECT e.entity_id, e.name, coalesce(rn, 0) AS rn, coalesce(pn, 0) AS pn, r, p,
      CASE WHEN coalesce(rn, 0) >= 10 AND coalesce(pn, 0) >= 10
        THEN CASE WHEN p = 0 THEN 0 ELSE (r - p) / abs(p) * 100 END END AS ch
    FROM entities e LEFT JOIN sides s ON e.entity_id = s.entity_id)
  SELECT entity_id, name AS entity_name, CAST({hours} AS INTEGER) AS window_hours,
    CASE WHEN ch IS NOT NULL THEN round_even(r, 3) END AS recent_sentiment,
    CASE WHEN ch IS NOT NULL THEN round_even(p, 3) END AS previous_sentiment,
    round_even(ch, 1) AS percent_change, rn AS recent_sample_size, pn AS previous_sample_size,
    abs(ch) > 30 AS alert, CASE WHEN ch IS NOT NULL THEN CASE WHEN ch > 0 THEN 'up' ELSE 'down' END END AS direction,
    CASE WHEN ch IS NULL THEN 'Insufficient data' END AS error
  FROM changed"""


@query("f2_velocity", _velocity_sql(AS_OF, 72))
def _(c):
    return an.velocity(c.tables(), AS_OF)


@query("f2_velocity_daily", _velocity_sql("2024-01-20 00:00:00", 24))
def _(c):
    return an.velocity(c.tables(), "2024-01-20 00:00:00", 24)


# The middle of the report window.
_MIDDLE = "2024-01-16 18:00:00"


@query("f3_window_velocity", f"""
  WITH sides AS (
    SELECT entity_id,
      avg(CASE WHEN created_at <= TIMESTAMP '{_MIDDLE}' THEN numeric_value END) AS a,
      count(CASE WHEN created_at <= TIMESTAMP '{_MIDDLE}' THEN 1 END) AS an,
      avg(CASE WHEN created_at >= TIMESTAMP '{_MIDDLE}' THEN numeric_value END) AS b,
      count(CASE WHEN created_at >= TIMESTAMP '{_MIDDLE}' THEN 1 END) AS bn
    FROM facts WHERE signal_type = 'sentiment' AND entity_id IS NOT NULL AND numeric_value IS NOT NULL GROUP BY entity_id),
  changed AS (SELECT e.entity_id, e.name, a, b, CASE WHEN an >= 5 AND bn >= 5
      THEN CASE WHEN a = 0 THEN 0 ELSE (b - a) / abs(a) * 100 END END AS ch
    FROM entities e LEFT JOIN sides s ON e.entity_id = s.entity_id)
  SELECT entity_id, name AS entity_name, '2024-01-08 to 2024-01-25' AS brief_window,
    CASE WHEN ch IS NOT NULL THEN round_even(a, 3) END AS first_half_sentiment,
    CASE WHEN ch IS NOT NULL THEN round_even(b, 3) END AS second_half_sentiment, round_even(ch, 1) AS percent_change,
    CASE WHEN ch IS NOT NULL THEN CASE WHEN ch > 0 THEN 'up' ELSE 'down' END END AS trending,
    CASE WHEN ch IS NULL THEN 'Insufficient data for brief window' END AS error FROM changed""")
def _(c):
    return an.window_velocity(c.tables(), START, END)


def _since(days: int) -> str:
    return f"created_at > TIMESTAMP '{AS_OF}' - INTERVAL '{days}' DAY"


@query("f4_emotion_distribution", f"""SELECT entity_id, value AS emotion, count(*) AS count FROM all_facts
  WHERE signal_type = 'emotion' AND entity_id IS NOT NULL AND {_since(7)} GROUP BY entity_id, value""")
def _(c):
    return an.emotion_distribution(c.tables(), AS_OF, 7)


@query("f5_top_topics", f"""SELECT value AS topic, count(*) AS mentions FROM all_facts
  WHERE signal_type = 'topic' AND {_since(14)} GROUP BY value ORDER BY mentions DESC, topic LIMIT 10""")
def _(c):
    return an.top_topics(c.tables(), AS_OF, 14, 10)


@query("f6_stance_breakdown", f"""SELECT e.entity_id,
    count(CASE WHEN value = 'support' THEN 1 END) AS support, count(CASE WHEN value = 'oppose' THEN 1 END) AS oppose,
    count(CASE WHEN value = 'neutral' THEN 1 END) AS neutral
  FROM entities e LEFT JOIN (SELECT * FROM all_facts WHERE signal_type = 'stance' AND {_since(7)}) f
    ON e.entity_id = f.entity_id GROUP BY e.entity_id""")
def _(c):
    return an.stance_breakdown(c.tables(), AS_OF, 7)


@query("f7_sentiment_history", f"""SELECT entity_id, CAST(created_at AS DATE) AS date,
    avg(numeric_value) AS avg_sentiment, count(DISTINCT comment_id) AS mention_count,
    CAST(sum(likes) AS BIGINT) AS total_likes
  FROM all_facts WHERE signal_type = 'sentiment' AND entity_id IS NOT NULL AND numeric_value IS NOT NULL AND {_since(30)}
  GROUP BY entity_id, CAST(created_at AS DATE)""")
def _(c):
    return an.sentiment_history(c.tables(), AS_OF, 30)


@query("f8_comment_count", f"""SELECT count(*) AS comment_count FROM comments
  WHERE created_at BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'""")
def _(c):
    return an.comment_count(c.tables(), START, END)


@query("f9_entity_comparison", """SELECT e.name AS entity_name, count(DISTINCT f.comment_id) AS mention_count,
    avg(numeric_value) AS avg_sentiment, min(numeric_value) AS min_sentiment, max(numeric_value) AS max_sentiment,
    round(stddev_samp(numeric_value), 6) AS sentiment_stddev, CAST(sum(likes) AS BIGINT) AS total_likes
  FROM facts f JOIN entities e ON f.entity_id = e.entity_id
  WHERE f.entity_id IN (1, 3, 5, 8, 13) AND signal_type = 'sentiment' AND numeric_value IS NOT NULL GROUP BY e.name""")
def _(c):
    return rounded(an.entity_comparison(c.tables(), [1, 3, 5, 8, 13], START, END), "sentiment_stddev")


@query("f10_label_distribution", """SELECT value AS sentiment_label, count(*) AS count FROM facts
  WHERE signal_type = 'sentiment' GROUP BY value""")
def _(c):
    return an.label_distribution(c.tables(), START, END)


@query("f10_label_distribution_entity", """SELECT value AS sentiment_label, count(*) AS count FROM facts
  WHERE signal_type = 'sentiment' AND entity_id = 3 GROUP BY value""")
def _(c):
    return an.label_distribution(c.tables(), START, END, 3)


def _top_posts_sql(platform: str, limit: int) -> str:
    return f"""
  WITH vol AS (SELECT c.post_id, count(*) AS comment_count, CAST(sum(c.likes) AS BIGINT) AS total_likes
    FROM comments c JOIN posts p ON c.post_id = p.post_id
    WHERE c.created_at BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' {platform}
    GROUP BY c.post_id ORDER BY comment_count DESC, c.post_id LIMIT {limit}),
  sc AS (SELECT post_id, avg(numeric_value) AS a FROM facts WHERE signal_type = 'sentiment' GROUP BY post_id),
  ent AS (SELECT post_id, name, row_number() OVER (PARTITION BY post_id ORDER BY n DESC, name) AS rn FROM (
    SELECT f.post_id, e.name, count(*) AS n FROM facts f JOIN entities e ON f.entity_id = e.entity_id
    WHERE signal_type = 'sentiment' GROUP BY f.post_id, e.name) x),
  cap AS (SELECT p.post_id, e.name, row_number() OVER (PARTITION BY p.post_id ORDER BY e.load_order) AS rn
    FROM posts p JOIN entities e ON contains(lower(p.caption), lower(e.name)))
  SELECT row_number() OVER (ORDER BY v.comment_count DESC, v.post_id) AS rank, v.post_id, p.platform, p.url,
    CASE WHEN length(p.caption) > 100 THEN concat(substr(p.caption, 1, 100), '...') ELSE p.caption END AS caption,
    v.comment_count, v.total_likes, round_even(coalesce(sc.a, 0), 2) AS avg_sentiment, coalesce(cap.name, ent.name) AS top_entity
  FROM vol v JOIN posts p ON v.post_id = p.post_id LEFT JOIN sc ON v.post_id = sc.post_id
  LEFT JOIN ent ON ent.post_id = v.post_id AND ent.rn = 1 LEFT JOIN cap ON cap.post_id = v.post_id AND cap.rn = 1"""


@query("f11_top_posts", _top_posts_sql("", 10))
def _(c):
    return an.top_posts(c.tables(), START, END, 10).withColumn("rank", F.col("rank").cast("bigint"))


@query("g8_ranked_posts_of_platform", _top_posts_sql("AND p.platform = 'youtube'", 25))
def _(c):
    return an.top_posts(c.tables(), START, END, 25, "youtube").withColumn("rank", F.col("rank").cast("bigint"))


@query("f12_post_distribution", """
  WITH sc AS (SELECT post_id, avg(numeric_value) AS a, count(*) AS n FROM facts WHERE signal_type = 'sentiment'
    GROUP BY post_id HAVING count(*) >= 5),
  hi AS (SELECT * FROM sc ORDER BY a DESC, post_id LIMIT 1), lo AS (SELECT * FROM sc ORDER BY a, post_id LIMIT 1),
  tot AS (SELECT count(CASE WHEN a > 0.3 THEN 1 END) AS positive_posts,
    count(CASE WHEN a BETWEEN -0.3 AND 0.3 THEN 1 END) AS neutral_posts,
    count(CASE WHEN a < -0.3 THEN 1 END) AS negative_posts, count(*) AS total_posts FROM sc)
  SELECT tot.*, hi.post_id AS most_positive_post_id, round_even(hi.a, 2) AS most_positive_avg_sentiment,
    hi.n AS most_positive_comment_count, lo.post_id AS most_negative_post_id,
    round_even(lo.a, 2) AS most_negative_avg_sentiment, lo.n AS most_negative_comment_count,
    hp.url AS most_positive_url, substr(hp.caption, 1, 100) AS most_positive_caption,
    lp.url AS most_negative_url, substr(lp.caption, 1, 100) AS most_negative_caption
  FROM tot, hi, lo, posts hp, posts lp WHERE hp.post_id = hi.post_id AND lp.post_id = lo.post_id""")
def _(c):
    return an.post_distribution(c.tables(), START, END)


_PLATFORMS = """SELECT p.platform, count(DISTINCT f.comment_id) AS comment_count,
    avg(numeric_value) AS avg_sentiment, CAST(sum(likes) AS BIGINT) AS total_likes
  FROM facts f JOIN posts p ON f.post_id = p.post_id
  WHERE signal_type = 'sentiment' AND numeric_value IS NOT NULL %s GROUP BY p.platform"""


@query("f14_platform_breakdown", _PLATFORMS % "")
def _(c):
    return an.platform_breakdown(c.tables(), START, END)


@query("f14_platform_breakdown_filtered", _PLATFORMS % "AND p.platform IN ('youtube', 'instagram')")
def _(c):
    return an.platform_breakdown(c.tables(), START, END, ["youtube", "instagram"])


def _distribution_sql(condition: str) -> str:
    return f"""
  WITH n AS (SELECT count(CASE WHEN numeric_value > 0.3 THEN 1 END) AS positive,
      count(CASE WHEN numeric_value < -0.3 THEN 1 END) AS negative,
      count(CASE WHEN numeric_value BETWEEN -0.3 AND 0.3 THEN 1 END) AS neutral
    FROM facts f JOIN posts p ON f.post_id = p.post_id WHERE signal_type = 'sentiment' {condition})
  SELECT positive, negative, neutral, positive + negative + neutral AS total,
    round_even(CAST(positive AS DOUBLE) / (positive + negative + neutral) * 100, 1) AS positive_pct,
    round_even(CAST(negative AS DOUBLE) / (positive + negative + neutral) * 100, 1) AS negative_pct,
    round_even(CAST(neutral AS DOUBLE) / (positive + negative + neutral) * 100, 1) AS neutral_pct FROM n"""


@query("f15_score_distribution", _distribution_sql(""))
def _(c):
    return an.score_distribution(c.tables(), START, END)


@query("f15_score_distribution_platform", _distribution_sql("AND p.platform = 'tiktok'"))
def _(c):
    return an.score_distribution(c.tables(), START, END, ["tiktok"])


@query("f16_platform_deltas", """
  WITH top AS (SELECT entity_id, count(DISTINCT comment_id) AS m FROM facts
    WHERE signal_type = 'sentiment' AND entity_id IS NOT NULL GROUP BY entity_id ORDER BY m DESC, entity_id LIMIT 5),
  sp AS (SELECT f.entity_id, p.platform, avg(numeric_value) AS s FROM facts f JOIN posts p ON f.post_id = p.post_id
    JOIN top ON top.entity_id = f.entity_id WHERE signal_type = 'sentiment' GROUP BY f.entity_id, p.platform),
  rk AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY s DESC, platform) AS hi,
    row_number() OVER (PARTITION BY entity_id ORDER BY s, platform) AS lo,
    count(*) OVER (PARTITION BY entity_id) AS n FROM sp)
  SELECT b.entity_id, e.name AS entity_name, b.platform AS best_platform, b.s AS best_sentiment,
    w.platform AS worst_platform, w.s AS worst_sentiment, b.s - w.s AS delta
  FROM rk b JOIN rk w ON b.entity_id = w.entity_id AND b.hi = 1 AND w.lo = 1 AND b.n >= 2
  JOIN entities e ON e.entity_id = b.entity_id""")
def _(c):
    t = c.tables()
    top = an.top_entities(t, START, END, limit=5)
    return an.platform_deltas(t, START, END, top)


@query("f18_table_counts", """SELECT 'posts' AS "table", count(*) AS count FROM posts
  UNION ALL SELECT 'comments', count(*) FROM comments UNION ALL SELECT 'monitored_entities', count(*) FROM entities
  UNION ALL SELECT 'extracted_signals', count(*) FROM signals
  UNION ALL SELECT 'enriched_comments', count(DISTINCT comment_id) FROM signals""")
def _(c):
    return qa.table_counts(c.tables())


@query("f19_signal_breakdown", "SELECT signal_type, count(*) AS count FROM signals GROUP BY signal_type")
def _(c):
    return qa.signal_breakdown(c.tables())


@query("c28_completeness", """
  WITH n AS (SELECT (SELECT count(*) FROM events) AS total_comments,
    (SELECT count(DISTINCT comment_id) FROM signals WHERE signal_type IN ('sentiment', 'toxicity')) AS enriched_comments)
  SELECT total_comments, enriched_comments, total_comments - enriched_comments AS pending_comments,
    round_even(enriched_comments * CAST(100 AS DOUBLE) / total_comments, 1) AS percent,
    CASE WHEN enriched_comments * 100.0 / total_comments >= 90 THEN 'good'
         WHEN enriched_comments * 100.0 / total_comments >= 50 THEN 'partial' ELSE 'low' END AS band FROM n""")
def _(c):
    t = c.tables()
    some = t.extracted_signals.filter(F.col("signal_type").isin("sentiment", "toxicity"))
    return qa.completeness(t.with_(extracted_signals=some))


@query("f22_metric_summary", """
  WITH k AS (SELECT event_type AS metric, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i,
    count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
  SELECT metric, max(n) AS count, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max,
    max(CASE WHEN i = floor(n * 0.50) + 1 THEN value END) AS p50,
    max(CASE WHEN i = floor(n * 0.95) + 1 THEN value END) AS p95,
    max(CASE WHEN i = floor(n * 0.99) + 1 THEN value END) AS p99 FROM k GROUP BY metric""")
def _(c):
    events = c.raw("events").select(F.col("event_type").alias("metric"), "value", F.col("ts").alias("at"))
    return rounded(qa.metric_summary(events), "mean")


@query("f23_counters", """SELECT event_type AS metric, CAST(sum(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)) AS BIGINT) AS total
  FROM events GROUP BY event_type""")
def _(c):
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    return qa.counters(c.raw("events").select(F.col("event_type").alias("metric"), k.alias("value")))


@query("f23_latest_values", """SELECT metric, value FROM (SELECT event_type AS metric, value,
    row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, value DESC) AS rn FROM events) m WHERE rn <= 1000""")
def _(c):
    events = c.raw("events").select(F.col("event_type").alias("metric"), "value", F.col("ts").alias("at"))
    return qa.latest_values(events).select("metric", "value")


@query("f24_overview", f"""
  WITH t AS ({_TOTALS % ''} ORDER BY mention_count DESC, entity_id LIMIT 20)
  SELECT count(*) AS entities, round(avg(avg_sentiment), 6) AS avg_sentiment, CAST(sum(total_likes) AS BIGINT) AS total_likes,
    (SELECT entity_name FROM t ORDER BY mention_count DESC, entity_id LIMIT 1) AS top_entity FROM t""")
def _(c):
    return qa.overview(c.tables(), START, END).withColumn("avg_sentiment", F.round("avg_sentiment", 6))


@query("f24_history_summary", f"""
  WITH h AS (SELECT entity_id, CAST(created_at AS DATE) AS d, avg(numeric_value) AS a, count(DISTINCT comment_id) AS m, sum(likes) AS l
    FROM all_facts WHERE signal_type = 'sentiment' AND entity_id IS NOT NULL AND {_since(30)} GROUP BY 1, 2)
  SELECT entity_id, round(avg(a), 6) AS avg_sentiment, CAST(sum(m) AS BIGINT) AS total_mentions, CAST(sum(l) AS BIGINT) AS total_likes
  FROM h GROUP BY entity_id""")
def _(c):
    return rounded(qa.history_summary(an.sentiment_history(c.tables(), AS_OF, 30)), "avg_sentiment")


@query("f26_quadrants", f"""
  WITH t AS ({_TOTALS % ''}), m AS (SELECT median(mention_count) AS med FROM t)
  SELECT entity_name, mention_count, CAST(med AS DOUBLE) AS median_mentions,
    concat(CASE WHEN mention_count >= med THEN 'High Volume' ELSE 'Low Volume' END, ' ',
      CASE WHEN avg_sentiment >= 0 THEN 'Positive' ELSE 'Negative' END) AS quadrant FROM t, m""")
def _(c):
    return qa.quadrants(an.entity_totals(c.tables(), START, END)).select(
        "entity_name", "mention_count", "median_mentions", "quadrant")


@query("f27_trend_feed", """
  WITH top AS (SELECT entity_id, count(DISTINCT comment_id) AS m FROM facts
    WHERE signal_type = 'sentiment' AND entity_id IS NOT NULL GROUP BY entity_id ORDER BY m DESC, entity_id LIMIT 7)
  SELECT f.entity_id, e.name AS entity_name, CAST(created_at AS DATE) AS date, avg(numeric_value) AS avg_sentiment
  FROM facts f JOIN top ON top.entity_id = f.entity_id JOIN entities e ON e.entity_id = f.entity_id
  WHERE signal_type = 'sentiment' GROUP BY f.entity_id, e.name, CAST(created_at AS DATE)""")
def _(c):
    return an.trend_feed(c.tables(), START, END)


@query("f29_freshness", """SELECT (SELECT count(*) FROM comments) AS comments,
    (SELECT epoch_us(max(created_at)) FROM comments) AS latest_comment,
    (SELECT count(*) FROM posts) AS posts, (SELECT count(*) FROM signals) AS signals""")
def _(c):
    return qa.freshness(c.tables()).withColumn("latest_comment", F.unix_micros("latest_comment"))


@query("g1_toxicity_alerts", f"""SELECT f.comment_id, substr(c.text, 1, 200) AS text, c.author_name AS author, c.likes,
    f.numeric_value AS toxicity, p.url AS post_url
  FROM all_facts f JOIN comment_texts c ON f.comment_id = c.comment_id JOIN posts p ON c.post_id = p.post_id
  WHERE f.signal_type = 'toxicity' AND f.numeric_value >= 0.7 AND f.{_since(7)}
  ORDER BY f.numeric_value DESC, c.likes DESC, f.comment_id LIMIT 50""")
def _(c):
    return an.toxicity_alerts(c.tables(text=True), AS_OF)


@query("g2_top_comments", """SELECT entity_id, rank, comment_id, text, likes, us AS created_at FROM (
    SELECT f.entity_id, row_number() OVER (PARTITION BY f.entity_id ORDER BY c.likes DESC, c.created_at DESC, c.comment_id) AS rank,
      c.comment_id, c.text, c.likes, epoch_us(c.created_at) AS us
    FROM all_facts f JOIN comment_texts c ON f.comment_id = c.comment_id
    WHERE f.signal_type = 'sentiment' AND f.entity_id IS NOT NULL AND f.numeric_value IS NOT NULL) x WHERE rank <= 3""")
def _(c):
    out = an.top_comments(c.tables(text=True), 3)
    return out.withColumn("created_at", F.unix_micros("created_at")).withColumn("rank", F.col("rank").cast("bigint"))


@query("g3_entity_comments", """SELECT entity_id, rank, comment_id, author_name, text, likes, us AS created_at, caption FROM (
    SELECT f.entity_id, row_number() OVER (PARTITION BY f.entity_id ORDER BY c.likes DESC, c.created_at DESC, c.comment_id) AS rank,
      c.comment_id, c.author_name, c.text, c.likes, epoch_us(c.created_at) AS us, p.caption
    FROM (SELECT DISTINCT entity_id, comment_id FROM signals WHERE signal_type = 'sentiment' AND entity_id IS NOT NULL) f
    JOIN comment_texts c ON f.comment_id = c.comment_id JOIN posts p ON p.post_id = c.post_id) x WHERE rank <= 10""")
def _(c):
    out = an.entity_comments(c.tables(text=True), 10)
    return out.withColumn("created_at", F.unix_micros("created_at")).withColumn("rank", F.col("rank").cast("bigint"))


@query("g4_discovered_list", """SELECT source AS name, lang AS entity_type, n AS mention_count FROM (
    SELECT source, min(lang) AS lang, count(*) AS n, (count(*) % 2 = 1) AS reviewed FROM documents GROUP BY source) d
  WHERE n >= 5 AND NOT reviewed ORDER BY n DESC, source LIMIT 50""")
def _(c):
    found = c.raw("documents").groupBy(F.col("source").alias("name")).agg(
        F.min("lang").alias("entity_type"), F.count(F.lit(1)).alias("mention_count")
    ).withColumn("reviewed", F.col("mention_count") % 2 == 1).select(
        "*", F.lit(None).cast("timestamp").alias("first_seen_at"), F.lit(None).cast("timestamp").alias("last_seen_at"),
        F.array().cast("array<string>").alias("sample_mentions"))
    return an.discovered_list(c.tables().with_(discovered_entities=found)).select("name", "entity_type", "mention_count")


@query("e14_name_suggestions", """SELECT DISTINCT c_name AS name FROM customer WHERE contains(lower(c_name), 'r#0000000')
  ORDER BY name LIMIT 5""")
def _(c):
    people = c.raw("customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name"))
    return an.name_suggestions(c.tables().with_(monitored_entities=people), "R#0000000")


@query("e1_signal_join", """SELECT signal_type, count(*) AS n, CAST(sum(likes) AS BIGINT) AS likes, count(DISTINCT post_id) AS posts
  FROM facts GROUP BY signal_type""")
def _(c):
    t = c.tables()
    out = None
    for kind in ("sentiment", "emotion", "toxicity", "stance", "topic"):
        facts = signal_facts(t, kind, START, END, scored=False)
        row = facts.agg(F.count(F.lit(1)).alias("n"), F.sum("likes").alias("likes"), F.countDistinct("post_id").alias("posts"))
        row = row.select(F.lit(kind).alias("signal_type"), "n", "likes", "posts")
        out = row if out is None else out.unionByName(row)
    return out
