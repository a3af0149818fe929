"""Column functions (family C) over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearsay import fixed_values as fv
from hearsay.functions import labels as lab
from hearsay.functions import numbers as num
from hearsay.functions import sentences as say
from hearsay.functions import text as tx
from hearsay.plans import analytics as an
from verification.core import END, START, VIEWS, query

VIEWS.update({
    "urls": """
        SELECT url FROM pages UNION ALL SELECT url FROM posts
        UNION ALL SELECT concat('https://instagram.com/p/E', CAST(doc_id AS VARCHAR(20)), '?igsh=1') FROM documents
        UNION ALL SELECT concat('https://instagram.com/F', CAST(doc_id AS VARCHAR(20)), '/p//') FROM documents
        UNION ALL SELECT concat('instagram://media?id=', CAST(doc_id AS VARCHAR(20))) FROM documents""",
    "stamps": """
        SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(1704067200 + event_id * 60 AS VARCHAR(20))
          WHEN 1 THEN concat(substr(CAST(ts AS VARCHAR(40)), 1, 10), 'T', substr(CAST(ts AS VARCHAR(40)), 12, 8), 'Z')
          WHEN 2 THEN substr(CAST(ts AS VARCHAR(40)), 1, 19) WHEN 3 THEN 'no time' ELSE '' END AS t FROM events""",
    "counts": """
        SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN concat(CAST(o_custkey AS VARCHAR(20)), 'k')
          WHEN 1 THEN concat('1.', CAST(o_custkey % 10 AS VARCHAR(20)), 'm') WHEN 2 THEN CAST(o_custkey AS VARCHAR(20))
          WHEN 3 THEN 'many' WHEN 4 THEN '' WHEN 5 THEN concat(' ', CAST(o_custkey AS VARCHAR(20)), '.5K ')
          WHEN 6 THEN concat(CAST(o_custkey AS VARCHAR(20)), '.0') ELSE NULL END AS t FROM orders""",
    "pairs": """
        SELECT event_id, x AS recent, CAST((c * 37 + k) % 101 AS DOUBLE) / CAST(128 AS DOUBLE) AS previous,
          CAST(c * 3 AS DOUBLE) / CAST(4 AS DOUBLE) AS change, c, k FROM scored""",
    "names": """
        SELECT p_name AS name FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT upper(lang) FROM documents
        UNION ALL SELECT CASE event_id % 16 WHEN 0 THEN 'OMG' WHEN 1 THEN '■■ Person' WHEN 2 THEN '😀😀' WHEN 3 THEN ' Link In Bio '
          WHEN 4 THEN concat('A', CAST(user_id AS VARCHAR(20))) WHEN 5 THEN 'The' WHEN 6 THEN '12345' WHEN 7 THEN 'x'
          WHEN 8 THEN '★ Star' WHEN 9 THEN '東京 Tower' WHEN 10 THEN 'Vanity Fair' WHEN 11 THEN 'Beyoncé'
          WHEN 12 THEN 'Getty Images' WHEN 13 THEN '▪▪▪' WHEN 14 THEN '' ELSE concat('Person ', CAST(user_id AS VARCHAR(20))) END
        FROM events""",
})


def listed(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_URL = "rtrim(url, '/')"


@query("c1_post_id_from_url", f"""SELECT url, CASE WHEN regexp_extract({_URL}, '/p/([^/?]+)', 1) <> ''
  THEN regexp_extract({_URL}, '/p/([^/?]+)', 1) ELSE string_split({_URL}, '/')[-1] END AS post_id FROM urls""")
def _(c):
    return c.view("urls").select("url", tx.post_id_from_url(F.col("url")).alias("post_id"))


@query("c2_post_id_from_last_segment", f"""SELECT url, CASE WHEN string_split({_URL}, '/')[-1] = 'p'
  THEN string_split({_URL}, '/')[-2] ELSE string_split({_URL}, '/')[-1] END AS post_id FROM urls""")
def _(c):
    return c.view("urls").select("url", tx.post_id_from_last_segment(F.col("url")).alias("post_id"))


@query("c3_parse_timestamp", """SELECT event_id, CASE WHEN regexp_full_match(t, '[0-9]+') THEN CAST(t AS BIGINT) * 1000000
    ELSE epoch_us(try_cast(replace(replace(t, 'T', ' '), 'Z', '') AS TIMESTAMP)) END AS parsed,
  coalesce(CASE WHEN regexp_full_match(t, '[0-9]+') THEN CAST(t AS BIGINT) * 1000000 END, 0) AS epoch_or_default FROM stamps""")
def _(c):
    t = F.col("t")
    zero = F.timestamp_seconds(F.lit(0))
    return c.view("stamps").select(
        "event_id", F.unix_micros(num.parse_timestamp(t)).alias("parsed"),
        F.unix_micros(num.parse_epoch(t, zero)).alias("epoch_or_default"))


_COUNT = """CASE WHEN contains(lower(t), 'k') THEN CAST(trunc(try_cast(replace(lower(trim(t)), 'k', '') AS DOUBLE) * 1000) AS BIGINT)
    WHEN contains(lower(t), 'm') AND lower(t) <> 'many' THEN CAST(trunc(try_cast(replace(lower(trim(t)), 'm', '') AS DOUBLE) * 1000000) AS BIGINT)
    WHEN lower(t) <> 'many' THEN %s END"""


@query("c4_human_count", f"""SELECT o_orderkey,
    coalesce({_COUNT % "CAST(trunc(try_cast(t AS DOUBLE)) AS BIGINT)"}, 0) AS lenient,
    {_COUNT % "CASE WHEN regexp_full_match(t, '[0-9]+') THEN CAST(t AS BIGINT) END"} AS strict FROM counts""")
def _(c):
    t = F.col("t")
    return c.view("counts").select(
        "o_orderkey", num.human_count(t).alias("lenient"), num.human_count(t, strict=True).alias("strict"))


@query("c5_safe_int", "SELECT o_orderkey, CASE WHEN regexp_full_match(t, '[0-9]+') THEN CAST(t AS BIGINT) END AS n FROM counts")
def _(c):
    return c.view("counts").select("o_orderkey", num.safe_int(F.col("t")).alias("n"))


@query("c6_first_non_empty", """SELECT o_orderkey, coalesce(nullif(t, ''), nullif(o, ''), 'unknown') AS first
  FROM (SELECT o_orderkey, t, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('order ', CAST(o_orderkey AS VARCHAR(20))) END AS o FROM counts) x""")
def _(c):
    other = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("order "), F.col("o_orderkey").cast("string")))
    first = F.coalesce(tx.first_non_empty(F.col("t"), other), F.lit("unknown"))
    return c.view("counts").select("o_orderkey", first.alias("first"))


@query("c7_raw_row_json", """SELECT p_partkey, to_json(struct_pack(p_partkey := p_partkey, p_name := p_name, p_brand := p_brand,
    size := nullif(p_size, 11)))::VARCHAR AS raw FROM part""")
def _(c):
    part = c.raw("part").withColumn("size", F.nullif("p_size", F.lit(11)))
    return part.select("p_partkey", tx.raw_row_json("p_partkey", "p_name", "p_brand", "size").alias("raw"))


@query("c8_rounded_id_prefix", """SELECT event_id, substr(concat('3773020515', CAST(1000000000 + event_id * 7919 AS VARCHAR(20))), 1, 15) AS prefix FROM events""")
def _(c):
    long_id = F.concat(F.lit("3773020515"), (F.lit(1000000000) + F.col("event_id") * 7919).cast("string"))
    return c.raw("events").select("event_id", tx.rounded_id_prefix(long_id).alias("prefix"))


@query("c9_app_link_media_id", "SELECT url, nullif(regexp_extract(url, 'id=(\\d+)', 1), '') AS media_id FROM urls")
def _(c):
    return c.view("urls").select("url", tx.app_link_media_id(F.col("url")).alias("media_id"))


@query("c10_like_weight", "SELECT comment_id, CAST(1.0 AS DOUBLE) + CAST(likes AS DOUBLE) / CAST(100 AS DOUBLE) AS weight FROM comments")
def _(c):
    return c.view("comments").select("comment_id", num.like_weight(F.col("likes")).alias("weight"))


def _levels(op: str) -> str:
    return f"""CASE WHEN x {op} 0.7 THEN 'Strongly Positive' WHEN x {op} 0.3 THEN 'Positive' WHEN x > -0.3 THEN 'Neutral'
      WHEN x > -0.7 THEN 'Negative' ELSE 'Strongly Negative' END"""


@query("c11_sentiment_label", f"""SELECT event_id, {_levels('>=')} AS label, {_levels('>')} AS strict_label
  FROM (SELECT event_id, CAST(c AS DOUBLE) / CAST(100 AS DOUBLE) AS x FROM scored) s""")
def _(c):
    s = c.sql("SELECT event_id, CAST(c AS DOUBLE) / CAST(100 AS DOUBLE) AS x FROM scored")
    return s.select("event_id", lab.sentiment_label(F.col("x")).alias("label"),
                    lab.sentiment_label(F.col("x"), strict=True).alias("strict_label"))


@query("c12_sentiment_bucket", """SELECT event_id, CASE WHEN c > 30 THEN 'positive' WHEN c < -30 THEN 'negative' ELSE 'neutral' END AS bucket FROM scored""")
def _(c):
    s = c.sql("SELECT event_id, CAST(c AS DOUBLE) / CAST(100 AS DOUBLE) AS x FROM scored")
    return s.select("event_id", lab.sentiment_bucket(F.col("x")).alias("bucket"))


@query("c13_toxicity_level", """SELECT event_id, CASE WHEN abs(c) >= 70 THEN 'high' WHEN abs(c) >= 40 THEN 'medium' ELSE 'low' END AS level FROM scored""")
def _(c):
    s = c.sql("SELECT event_id, CAST(abs(c) AS DOUBLE) / CAST(100 AS DOUBLE) AS x FROM scored")
    return s.select("event_id", lab.toxicity_level(F.col("x")).alias("level"))


@query("c14_strip_hint", """SELECT p_partkey, trim(p_name) AS name FROM part""")
def _(c):
    hinted = F.concat(F.lit(" "), "p_name", F.lit(" (the "), "p_brand", F.lit(" one) (again)"))
    return c.raw("part").select("p_partkey", tx.strip_hint(hinted).alias("name"))


@query("c15_with_hint", """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'Justin X Baldoni (the director, not Justin Bieber)'
    WHEN p_size % 5 = 1 THEN 'Blake Lively (the actress, not Blake Shelton)' WHEN p_size % 5 = 2 THEN p_name
    ELSE concat(p_name, ' (aliases: ', p_brand, ', ', p_type, ', c)') END AS shown FROM part""")
def _(c):
    size = F.col("p_size") % 5
    name = F.when(size == 0, "Justin X Baldoni").when(size == 1, "Blake Lively").otherwise(F.col("p_name"))
    aliases = F.when(size == 2, F.array().cast("array<string>")).otherwise(
        F.array("p_brand", "p_type", F.lit("c"), F.lit("d")))
    return c.raw("part").select("p_partkey", tx.with_hint(name, aliases).alias("shown"))


@query("c16_truncation", """SELECT comment_id, substr(text, 1, 200) AS clipped,
    CASE WHEN length(text) > 100 THEN concat(substr(text, 1, 100), '...') ELSE text END AS preview,
    concat(format('{:,}', likes * 1000), ' likes · ', CASE WHEN length(q) > 160 THEN concat(substr(q, 1, 157), '...') ELSE q END) AS quote
  FROM (SELECT *, replace(trim(text, E' \\t\\n\\r'), E'\\n', ' ') AS q FROM tcomments) t""")
def _(c):
    text = F.col("text")
    return c.view("tcomments").select(
        "comment_id", tx.clip(text, 200).alias("clipped"), tx.caption_preview(text).alias("preview"),
        tx.quote_sample(text, F.col("likes") * 1000).alias("quote"))


@query("c17_display_text", """SELECT doc_id, regexp_replace(text, '\\p{C}', '', 'g') AS shown FROM documents""")
def _(c):
    return c.raw("documents").select("doc_id", tx.display_text(F.col("text")).alias("shown"))


_EMOJI = r"[\x{1F300}-\x{1F9FF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}\x{1F1E0}-\x{1F1FF}]+"
_WIDE = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]"


@query("c18_scored_name_filter", f"""SELECT name, length(name) >= 2 AND NOT regexp_matches(name, '[■□▪]')
    AND NOT regexp_full_match(trim(name), '{_EMOJI}') AND lower(name) NOT IN ({listed(fv.NOT_SCORED_NAMES)})
    AND length(regexp_replace(name, '\\P{{L}}', '', 'g')) * 2 >= length(name) AS keep FROM names""")
def _(c):
    return c.view("names").select("name", tx.is_scored_name(F.col("name")).alias("keep"))


@query("c19_discovered_name_filter", f"""SELECT name, NOT regexp_full_match(trim(name), '{_EMOJI}') AND length(trim(name)) >= 2
    AND regexp_matches(name, '[a-zA-Z]')
    AND lower(trim(name)) NOT IN ({listed(fv.FUNCTION_WORDS + fv.BOILERPLATE_NAMES + fv.BOILERPLATE_PHRASES)})
    AND NOT regexp_matches(name, '{_WIDE}') AND NOT regexp_matches(name, '[■□]') AS keep FROM names""")
def _(c):
    return c.view("names").select("name", tx.is_discovered_name(F.col("name")).alias("keep"))


@query("c20_report_blocklist", f"""SELECT name, lower(trim(name)) NOT IN ({listed(fv.REPORT_BLOCKLIST)})
    AND NOT regexp_matches(name, '[■□]') AND length(name) >= 2 AND regexp_matches(name, '\\p{{L}}') AS keep FROM names""")
def _(c):
    return c.view("names").select("name", tx.is_reported_name(F.col("name")).alias("keep"))


@query("c21_velocity_status", """SELECT event_id, CASE WHEN abs(change) > 50 THEN
      CASE WHEN change > 0 THEN CASE WHEN previous < -0.3 THEN 'Strong Recovery' ELSE 'Strong Improvement' END
           ELSE CASE WHEN recent < -0.7 THEN 'Crisis Alert' ELSE 'Major Decline' END END
    WHEN abs(change) > 30 THEN
      CASE WHEN change > 0 THEN CASE WHEN previous < -0.3 THEN 'Recovery' ELSE 'Improving' END
           ELSE CASE WHEN recent > -0.3 THEN 'Declining' ELSE 'Turned Negative' END END
    ELSE 'Stable' END AS status FROM pairs""")
def _(c):
    return c.view("pairs").select("event_id", lab.velocity_status(F.col("change"), F.col("recent"), F.col("previous")).alias("status"))


@query("c22_velocity_phrase", """SELECT event_id, CASE WHEN change > 0 THEN
      CASE WHEN previous < -0.3 AND recent > -0.3 THEN 'recovering from negative territory'
           WHEN recent > 0.3 THEN 'sentiment strongly positive' ELSE 'sentiment improving' END
    ELSE CASE WHEN previous > -0.3 AND recent < -0.3 THEN 'turned negative'
           WHEN recent < -0.7 THEN 'sentiment crisis' ELSE 'sentiment declining' END END AS phrase FROM pairs""")
def _(c):
    return c.view("pairs").select("event_id", lab.velocity_phrase(F.col("change"), F.col("recent"), F.col("previous")).alias("phrase"))


@query("c23_trend_label", "SELECT event_id, CASE WHEN recent > 0.3 THEN 'rising' WHEN recent < -0.3 THEN 'falling' ELSE 'stable' END AS trend FROM pairs")
def _(c):
    return c.view("pairs").select("event_id", lab.trend_label(F.col("recent")).alias("trend"))


@query("c24_trajectory", """SELECT p_brand, n, CASE WHEN n > m * 0.8 THEN 'High' WHEN n > m * 0.5 THEN 'Moderate' ELSE 'Emerging' END AS trajectory,
    round_even(n * CAST(100 AS DOUBLE) / m, 1) AS intensity
  FROM (SELECT p_brand, count(*) AS n, max(count(*)) OVER () AS m FROM part WHERE p_size < 40 GROUP BY p_brand) b""")
def _(c):
    counts = c.raw("part").filter("p_size < 40").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    highest = counts.agg(F.max("n").alias("m")).scalar()
    return counts.withColumn("m", highest).select(
        "p_brand", "n", lab.trajectory(F.col("n"), F.col("m")).alias("trajectory"),
        F.bround(F.col("n") * 100.0 / F.col("m"), 1).alias("intensity"))


@query("c26_percent_of", """SELECT status, n, round_even(CAST(n AS DOUBLE) / total * 100, 1) AS pct, CAST(0 AS DOUBLE) AS none
  FROM (SELECT o_orderstatus AS status, count(*) AS n, sum(count(*)) OVER () AS total FROM orders GROUP BY o_orderstatus) s""")
def _(c):
    orders = c.raw("orders")
    total = orders.agg(F.count(F.lit(1)).alias("t")).scalar()
    counts = orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n")).withColumn("t", total)
    return counts.select("status", "n", num.percent_of(F.col("n"), F.col("t")).alias("pct"),
                         num.percent_of(F.col("n"), F.lit(0)).alias("none"))


@query("c27_percent_change", """SELECT event_id, CASE WHEN previous = 0 THEN 0 ELSE (recent - previous) / abs(previous) * 100 END AS change FROM pairs""")
def _(c):
    return c.view("pairs").select("event_id", num.percent_change(F.col("previous"), F.col("recent")).alias("change"))


_BUCKET = "CASE WHEN s > 0.3 THEN 'positive' WHEN s < -0.3 THEN 'negative' ELSE 'neutral' END"


@query("c25_entity_sentences", f"""
  WITH t AS (SELECT e.name, count(DISTINCT comment_id) AS m, avg(numeric_value) AS s, CAST(sum(likes) AS BIGINT) * 50 AS l
    FROM facts f JOIN entities e ON e.entity_id = f.entity_id WHERE signal_type = 'sentiment' GROUP BY e.name)
  SELECT name, concat(name, ' dominated conversations with ', format('{{:,}}', m), ' mentions and ', {_BUCKET}, ' sentiment (', printf('%+.2f', s), ').') AS headline,
    concat(CASE WHEN s > 0.5 THEN concat('Strong positive sentiment (', printf('%+.2f', s), ') with ', format('{{:,}}', m), ' mentions')
      WHEN s < -0.5 THEN concat('Significant negative sentiment (', printf('%+.2f', s), ') across ', format('{{:,}}', m), ' mentions')
      ELSE concat('Neutral sentiment (', printf('%+.2f', s), ') with ', format('{{:,}}', m), ' mentions') END,
      CASE WHEN l > 50000 THEN concat(' • High engagement: ', format('{{:,}}', l), ' total likes') ELSE '' END) AS insight,
    concat(name, ' sentiment remains fragile (', printf('%+.2f', s), ') with high volume (', format('{{:,}}', m), ' mentions)') AS fragile
  FROM t""")
def _(c):
    t = an.entity_totals(c.tables(), START, END)
    name, m, s, likes = F.col("entity_name"), F.col("mention_count"), F.col("avg_sentiment"), F.col("total_likes") * 50
    return t.select(
        name.alias("name"), say.headline(name, m, s).alias("headline"),
        say.micro_insight(s, m, likes, F.lit(None).cast("double")).alias("insight"),
        say.fragile_risk(name, s, m).alias("fragile"))


@query("c25_alert_sentences", """SELECT event_id,
    concat('E', CAST(event_id AS VARCHAR(20)), ' experienced a ', printf('%+.1f', change), '% sentiment shift from ', printf('%.2f', previous), ' to ', printf('%.2f', recent), '.') AS alert,
    concat('E', CAST(event_id AS VARCHAR(20)), ' negativity ', CASE WHEN change < 0 THEN 'accelerating' ELSE 'improving' END, '; ', printf('%.1f', abs(change)), '% sentiment shift in 72hrs') AS risk,
    concat('E', CAST(event_id AS VARCHAR(20)), ' shows a critical sentiment shift (', printf('%+.1f', change), '%), indicating significant change in public perception.') AS critical
  FROM pairs""")
def _(c):
    name = F.concat(F.lit("E"), F.col("event_id").cast("string"))
    change, recent, previous = F.col("change"), F.col("recent"), F.col("previous")
    return c.view("pairs").select(
        "event_id", say.alert_text(name, change, previous, recent).alias("alert"),
        say.velocity_risk(name, change).alias("risk"), say.critical_shift(name, change).alias("critical"))


@query("c25_distribution_sentence", """
  WITH d AS (SELECT p.platform, count(CASE WHEN numeric_value > 0.3 THEN 1 END) AS pos, count(CASE WHEN numeric_value < -0.3 THEN 1 END) AS neg, count(*) AS n
    FROM facts f JOIN posts p ON p.post_id = f.post_id WHERE signal_type = 'sentiment' GROUP BY p.platform),
  q AS (SELECT platform, n, round_even(CAST(pos AS DOUBLE) / n * 100, 1) AS pp, round_even(CAST(neg AS DOUBLE) / n * 100, 1) AS np FROM d)
  SELECT platform, CASE WHEN pp > np * 1.5 THEN concat('Positive sentiment dominates with ', printf('%.1f', pp), '% of ', format('{:,}', n), ' comments, indicating overall favorable discourse.')
    WHEN np > pp * 1.5 THEN concat('Negative sentiment leads with ', printf('%.1f', np), '% of ', format('{:,}', n), ' comments, signaling significant criticism or concern.')
    ELSE concat('Sentiment is balanced: ', printf('%.1f', pp), '% positive, ', printf('%.1f', np), '% negative across ', format('{:,}', n), ' comments.') END AS sentence FROM q""")
def _(c):
    out = None
    for platform in ("instagram", "tiktok", "youtube"):
        d = an.score_distribution(c.tables(), START, END, [platform]).select(
            F.lit(platform).alias("platform"),
            say.distribution_explainer(F.col("positive_pct"), F.col("negative_pct"), F.col("total")).alias("sentence"))
        out = d if out is None else out.unionByName(d)
    return out


_CAPITAL = "concat(upper({0}[1]), {0}[2:])"
_LOWER_LEVEL = """CASE WHEN {0} >= 0.7 THEN 'strongly positive' WHEN {0} >= 0.3 THEN 'positive' WHEN {0} > -0.3 THEN 'neutral'
  WHEN {0} > -0.7 THEN 'negative' ELSE 'strongly negative' END"""


@query("c25_platform_sentences", f"""
  WITH s AS (SELECT f.entity_id, e.name, p.platform, avg(numeric_value) AS s FROM facts f JOIN entities e ON e.entity_id = f.entity_id
      JOIN posts p ON p.post_id = f.post_id WHERE signal_type = 'sentiment' GROUP BY 1, 2, 3),
  b AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY s DESC, platform) AS hi, row_number() OVER (PARTITION BY entity_id ORDER BY s, platform) AS lo FROM s),
  j AS (SELECT h.name, {_CAPITAL.format('h.platform')} AS bp, h.s AS bs, {_CAPITAL.format('l.platform')} AS wp, l.s AS ws FROM b h JOIN b l ON h.entity_id = l.entity_id AND h.hi = 1 AND l.lo = 1
    WHERE h.platform <> l.platform)
  SELECT name, CASE WHEN bs - ws > 0.3 THEN concat(name, ' shows ', bp, '-driven positivity (', printf('%+.2f', bs), ') while ', wp, ' is more negative (', printf('%+.2f', ws), ')')
      ELSE concat(name, ' sentiment is consistent across platforms (', bp, ': ', printf('%+.2f', bs), ', ', wp, ': ', printf('%+.2f', ws), ')') END AS contrast,
    CASE WHEN bs - ws > 0.2 THEN concat(bp, ' shows ', {_LOWER_LEVEL.format('bs')}, ' sentiment (', printf('%+.2f', bs), '), while ', wp, ' is ', {_LOWER_LEVEL.format('ws')}, ' (', printf('%+.2f', ws), '), indicating platform-specific discourse patterns.')
      ELSE concat('Platform sentiment is relatively consistent, with ', bp, ' slightly more positive.') END AS explainer FROM j""")
def _(c):
    t = c.tables()
    d = an.platform_deltas(t, START, END, an.top_entities(t, START, END, limit=25))
    best, bs, worst, ws = (F.col(n) for n in ("best_platform", "best_sentiment", "worst_platform", "worst_sentiment"))
    return d.select(
        F.col("entity_name").alias("name"), say.platform_contrast(F.col("entity_name"), best, bs, worst, ws).alias("contrast"),
        say.platform_explainer(best, bs, worst, ws).alias("explainer"))


@query("c25_discovery_sentences", """
  WITH d AS (SELECT lang, source AS name, count(*) AS n FROM documents GROUP BY 1, 2),
  g AS (SELECT lang, count(CASE WHEN n >= 12 THEN 1 END) AS high, arg_min(name, (-n, name)) AS top, max(n) AS m, list(name ORDER BY n DESC, name)[1:3] AS names FROM d GROUP BY lang)
  SELECT lang, CASE WHEN high > 0 THEN concat(CAST(high AS VARCHAR), ' entities show high relevance (20+ mentions) and should be considered for addition to the monitored list. Top candidate: ', top, ' (', CAST(m AS VARCHAR), ' mentions).')
      WHEN m >= 10 THEN concat(top, ' should probably be added as a monitored entity due to emerging relevance (', CAST(m AS VARCHAR), ' mentions).') END AS guidance,
    concat('Top entities show divergent sentiment patterns, with ', array_to_string(names, ', '), ' representing the highest-volume conversations.') AS trends FROM g""")
def _(c):
    counts = c.raw("documents").groupBy("lang", F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    by_lang = counts.groupBy("lang").agg(
        F.count_if(F.col("n") >= 12).alias("high"), F.max("n").alias("m"),
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "name"))).alias("ranked"))
    names = F.transform(F.slice("ranked", 1, 3), lambda x: x["name"])
    return by_lang.select(
        "lang", say.editorial_guidance(F.col("high"), F.get("ranked", F.lit(0))["name"], F.col("m")).alias("guidance"),
        say.trend_explainer(names).alias("trends"))
