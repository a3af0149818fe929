"""The period brief (families I, G5 to G7, F28) on the numeric side."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearsay import fixed_values as fv
from hearsay.plans import analytics as an
from hearsay.plans import brief as br
from hearsay.schemas import DISCOVERED
from verification.analytics_queries import _velocity_sql
from verification.core import END, START, query
from verification.function_queries import listed

_V = _velocity_sql(END, 72).strip()

# Ranking, alerts and platforms of the report window, as the brief sees them.
_BASE = f"""
  WITH vel AS ({_V}),
  tot AS (SELECT e.entity_id, e.name AS entity_name, count(DISTINCT f.comment_id) AS mention_count, avg(f.numeric_value) AS avg_sentiment,
      CAST(sum(f.likes) AS BIGINT) AS total_likes FROM facts f JOIN entities e ON f.entity_id = e.entity_id
    WHERE f.signal_type = 'sentiment' AND f.numeric_value IS NOT NULL GROUP BY e.entity_id, e.name),
  top AS (SELECT *, row_number() OVER (ORDER BY mention_count DESC, entity_id) AS rank FROM tot ORDER BY mention_count DESC, entity_id LIMIT 10),
  al AS (SELECT row_number() OVER (ORDER BY abs(percent_change) DESC, t.rank) AS alert_rank, v.*, t.rank AS top_rank FROM vel v JOIN top t ON t.entity_id = v.entity_id
    WHERE v.alert ORDER BY abs(percent_change) DESC, t.rank LIMIT 8),
  pl AS (SELECT p.platform, count(DISTINCT f.comment_id) AS comment_count, avg(numeric_value) AS avg_sentiment FROM facts f JOIN posts p ON f.post_id = p.post_id
    WHERE signal_type = 'sentiment' AND numeric_value IS NOT NULL GROUP BY p.platform),
  ta AS (SELECT t.*, a.alert_rank, a.percent_change, a.recent_sentiment, a.previous_sentiment FROM top t LEFT JOIN al a ON a.entity_id = t.entity_id)"""


def _base(c):
    t = c.tables(text=True).with_(discovered_entities=c.spark.createDataFrame([], DISCOVERED))
    top = br.ranked(br.dynamic_entities(t, START, END, 10, None, 10))
    return t, top, br.velocity_alerts(t, top, END)


def _big(df, *names):
    return df.select(*[F.col(n).cast("bigint").alias(n) if n in names else F.col(n) for n in df.columns])


@query("g5_velocity_alerts", _BASE + """ SELECT alert_rank, entity_name, percent_change, recent_sentiment, previous_sentiment, direction,
    concat(entity_name, ' experienced a ', printf('%+.1f', percent_change), '% sentiment shift from ', printf('%.2f', round_even(previous_sentiment, 2)), ' to ', printf('%.2f', round_even(recent_sentiment, 2)), '.') AS narrative FROM al""")
def _(c):
    _t, _top, alerts = _base(c)
    return _big(alerts.select("alert_rank", "entity_name", "percent_change", "recent_sentiment", "previous_sentiment", "direction", "narrative"), "alert_rank")


_G6 = """,
  e AS (
    SELECT 1 AS place, 'Top Riser' AS category, alert_rank AS o, entity_name, concat(printf('%+.1f', percent_change), '%') AS metric,
      concat('Sentiment: ', printf('%+.2f', round_even(recent_sentiment, 2))) AS detail, 3 AS keep FROM ta WHERE percent_change > 30
    UNION ALL SELECT 2, 'Top Faller', alert_rank, entity_name, concat(printf('%+.1f', percent_change), '%'), concat('Sentiment: ', printf('%+.2f', round_even(recent_sentiment, 2))), 3 FROM ta WHERE percent_change < -30
    UNION ALL SELECT 3, 'New Negative', rank, entity_name, printf('%+.2f', avg_sentiment), concat(mention_count, ' mentions'), 2 FROM ta WHERE avg_sentiment < -0.3 AND coalesce(abs(percent_change), 0) <= 30
    UNION ALL SELECT 4, 'New Positive', rank, entity_name, printf('%+.2f', avg_sentiment), concat(mention_count, ' mentions'), 2 FROM ta WHERE avg_sentiment > 0.5 AND coalesce(percent_change, 0) <= 30
    UNION ALL SELECT 5, 'Surprising Shift', alert_rank, entity_name, concat(printf('%+.1f', percent_change), '%'), concat(mention_count, ' mentions'), 2 FROM ta WHERE mention_count > 500 AND abs(percent_change) > 50),
  n AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY o) AS nth FROM e)
  SELECT CAST(place AS BIGINT) AS place, nth, category, entity_name AS entity, metric, detail FROM n WHERE nth <= keep"""


@query("g6_what_changed", _BASE + _G6)
def _(c):
    _t, top, alerts = _base(c)
    return _big(br.what_changed(top, alerts), "place", "nth")


_G7 = """,
  r AS (SELECT 0 AS place, alert_rank AS nth, concat(entity_name, ' negativity ', CASE WHEN percent_change < 0 THEN 'accelerating' ELSE 'improving' END, '; ', printf('%.1f', abs(percent_change)), '% sentiment shift in 72hrs') AS risk,
      'critical' AS severity, 'velocity' AS type FROM al WHERE abs(percent_change) > 50
    UNION ALL SELECT 1, rank, concat(entity_name, ' sentiment remains fragile (', printf('%+.2f', avg_sentiment), ') with high volume (', format('{:,}', mention_count), ' mentions)'), 'warning', 'fragile'
      FROM top WHERE avg_sentiment > -0.6 AND avg_sentiment < -0.3 AND mention_count > 200
    UNION ALL SELECT 2, 1, concat(upper(platform[1]), platform[2:], ' shows negative sentiment (', printf('%+.2f', avg_sentiment), ') across ', format('{:,}', comment_count), ' comments'), 'warning', 'platform'
      FROM (SELECT *, row_number() OVER (ORDER BY avg_sentiment, platform) AS rn, count(*) OVER () AS n FROM pl) w WHERE rn = 1 AND n >= 2 AND avg_sentiment < -0.2)
  SELECT CAST(place AS BIGINT) AS place, nth, risk, severity, type FROM r ORDER BY place, nth LIMIT 5"""


@query("g7_key_risks", _BASE + _G7)
def _(c):
    t, top, alerts = _base(c)
    return _big(br.key_risks(top, alerts, an.platform_breakdown(t, START, END)), "place", "nth")


@query("i1_topline", _BASE + f""" SELECT (SELECT count(*) FROM comments WHERE created_at BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}') AS total_comments,
    (SELECT count(*) FROM top) AS total_entities, (SELECT count(*) FROM al WHERE abs(percent_change) > 50) AS critical_alerts, (SELECT count(*) FROM al) AS velocity_alerts_count""")
def _(c):
    t, top, alerts = _base(c)
    return br.topline(t, START, END, top, alerts)


@query("i2_entity_comparison", _BASE + """ SELECT rank, entity_name, avg_sentiment AS current_sentiment, mention_count,
    CASE WHEN avg_sentiment > 0.3 THEN 'rising' WHEN avg_sentiment < -0.3 THEN 'falling' ELSE 'stable' END AS trend FROM top WHERE rank <= 5""")
def _(c):
    return _big(br.entity_comparison(_base(c)[1]), "rank")


_I3 = """,
  b AS (SELECT rank, entity_name, concat(CASE WHEN avg_sentiment > 0.5 THEN 'Strong positive' WHEN avg_sentiment < -0.5 THEN 'Significant negative' ELSE 'Neutral' END, ' sentiment (', printf('%+.2f', avg_sentiment), ')',
      CASE WHEN avg_sentiment < -0.5 THEN ' across ' ELSE ' with ' END, format('{:,}', mention_count), ' mentions') AS a,
    CASE WHEN abs(percent_change) > 30 THEN concat('Sentiment ', CASE WHEN percent_change > 0 THEN 'improved' ELSE 'declined' END, ' ', printf('%.1f', abs(percent_change)), '% in past 72hrs') END AS v,
    CASE WHEN total_likes > 50000 THEN concat('High engagement: ', format('{:,}', total_likes), ' total likes') END AS l FROM ta)
  SELECT rank, entity_name, concat_ws(' • ', a, coalesce(v, l)) AS insight FROM b"""


@query("i3_micro_insights", _BASE + _I3)
def _(c):
    _t, top, alerts = _base(c)
    return _big(br.micro_insights(top, alerts), "rank")


@query("i4_emotion_section", _BASE + f""" SELECT t.rank, t.entity_name, f.value AS emotion, count(*) AS count FROM all_facts f JOIN top t ON t.entity_id = f.entity_id
  WHERE t.rank <= 5 AND f.signal_type = 'emotion' AND f.created_at > TIMESTAMP '{END}' - INTERVAL '17' DAY GROUP BY 1, 2, 3""")
def _(c):
    t, top, _alerts = _base(c)
    section = br.emotion_section(t, top, END, br.window_days(START, END))
    return _big(section.select("rank", "entity_name", F.explode("emotions").alias("emotion", "count")), "rank")


@query("i5_topic_section", f"""SELECT value AS topic, count(*) AS mentions FROM all_facts WHERE signal_type = 'topic'
  AND created_at > TIMESTAMP '{END}' - INTERVAL '17' DAY GROUP BY value ORDER BY mentions DESC, topic LIMIT 10""")
def _(c):
    return an.top_topics(c.tables(), END, br.window_days(START, END), 10)


@query("i6_toxicity_section", f"""SELECT f.comment_id, f.likes, f.numeric_value AS toxicity FROM all_facts f WHERE f.signal_type = 'toxicity' AND f.numeric_value >= 0.7
  AND f.created_at > TIMESTAMP '{END}' - INTERVAL '17' DAY ORDER BY f.numeric_value DESC, f.likes DESC, f.comment_id LIMIT 10""")
def _(c):
    found = an.toxicity_alerts(c.tables(text=True), END, 0.7, br.window_days(START, END), 10)
    return found.select("comment_id", "likes", "toxicity")


@query("i7_stance_section", _BASE + f""" SELECT t.rank, t.entity_name, count(CASE WHEN value = 'support' THEN 1 END) AS support, count(CASE WHEN value = 'oppose' THEN 1 END) AS oppose,
    count(CASE WHEN value = 'neutral' THEN 1 END) AS neutral, count(*) AS total FROM all_facts f JOIN top t ON t.entity_id = f.entity_id
  WHERE t.rank <= 5 AND f.signal_type = 'stance' AND f.created_at > TIMESTAMP '{END}' - INTERVAL '17' DAY GROUP BY 1, 2""")
def _(c):
    t, top, _alerts = _base(c)
    return _big(br.stance_section(t, top, END, br.window_days(START, END)), "rank")


@query("i8_post_summary", """
  WITH sc AS (SELECT post_id, avg(numeric_value) AS a FROM facts WHERE signal_type = 'sentiment' GROUP BY post_id HAVING count(*) >= 5)
  SELECT concat('Top 10 posts by comment volume. Post sentiment distribution: ', count(CASE WHEN a > 0.3 THEN 1 END), ' positive, ', count(CASE WHEN a BETWEEN -0.3 AND 0.3 THEN 1 END),
    ' neutral, ', count(CASE WHEN a < -0.3 THEN 1 END), ' negative (out of ', count(*), ' posts with 5+ comments).') AS summary FROM sc""")
def _(c):
    t = c.tables()
    return br.post_section_summary(t, START, END, br.post_section(t, START, END))


@query("i9_narrative_context", _BASE + """,
  q AS (SELECT f.entity_id, row_number() OVER (PARTITION BY f.entity_id ORDER BY c.likes DESC, c.created_at DESC, c.comment_id) AS rn, c.likes,
      replace(trim(c.text, E' \\t\\n\\r'), E'\\n', ' ') AS line FROM all_facts f JOIN comment_texts c ON f.comment_id = c.comment_id
    WHERE f.signal_type = 'sentiment' AND f.entity_id IN (SELECT entity_id FROM top WHERE rank <= 3)),
  s AS (SELECT entity_id, list_aggregate(list(concat(format('{:,}', likes), ' likes · ', CASE WHEN length(line) > 160 THEN concat(substr(line, 1, 157), '...') ELSE line END) ORDER BY rn), 'string_agg', '|') AS quotes
    FROM q WHERE rn <= 3 AND line <> '' GROUP BY entity_id)
  SELECT ta.rank, entity_name AS name, mention_count AS mentions, avg_sentiment AS sentiment, percent_change AS velocity, coalesce(quotes, '') AS sample_comments
  FROM ta LEFT JOIN s ON s.entity_id = ta.entity_id WHERE ta.rank <= 3""")
def _(c):
    t, top, alerts = _base(c)
    return _big(br.narrative_context(t, top, alerts).withColumn("sample_comments", F.array_join("sample_comments", "|")), "rank")


@query("i9_narrative", _BASE + """ SELECT concat_ws(' ', concat(entity_name, ' dominated conversations with ', format('{:,}', mention_count), ' mentions and ',
    CASE WHEN avg_sentiment > 0.3 THEN 'positive' WHEN avg_sentiment < -0.3 THEN 'negative' ELSE 'neutral' END, ' sentiment.'),
    (SELECT concat(entity_name, ' shows a critical sentiment shift (', printf('%+.1f', percent_change), '%), indicating significant change in public perception.') FROM al WHERE alert_rank = 1)) AS narrative
  FROM top WHERE rank = 1""")
def _(c):
    _t, top, alerts = _base(c)
    return br.narrative(top, alerts)


@query("f28_big_numbers", _BASE + f""" SELECT CAST(1 AS BIGINT) AS place, format('{{:,}}', count(*)) AS number, 'Total Comments Analyzed' AS label FROM comments WHERE created_at BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'
  UNION ALL SELECT 2, format('{{:,}}', mention_count), concat('Mentions: ', entity_name, ' (', CASE WHEN avg_sentiment >= 0.7 THEN 'Strongly Positive' WHEN avg_sentiment >= 0.3 THEN 'Positive' WHEN avg_sentiment > -0.3 THEN 'Neutral'
    WHEN avg_sentiment > -0.7 THEN 'Negative' ELSE 'Strongly Negative' END, ')') FROM top WHERE rank = 1
  UNION ALL SELECT 3, concat(printf('%.1f', abs(percent_change)), '%'), concat('Sentiment Shift: ', entity_name) FROM (SELECT * FROM al WHERE abs(percent_change) > 50 ORDER BY alert_rank LIMIT 1) a
  UNION ALL SELECT 4, printf('%+.2f', avg_sentiment), concat('Top Platform: ', upper(platform[1]), platform[2:], ' Sentiment') FROM (SELECT * FROM pl ORDER BY avg_sentiment DESC, platform LIMIT 1) b""")
def _(c):
    t, top, alerts = _base(c)
    return _big(br.big_numbers(t, START, END, top, alerts, an.platform_breakdown(t, START, END)), "place")


# --- the whole brief, with discovered names in the ranking and storylines among the texts ---

_LINES = ["the of", "this", "retion", "und", "les", "thing"]
# A brief sees nothing later than the moment it is made for.
_LOOK_BACK = f"created_at > TIMESTAMP '{END}' - INTERVAL '17' DAY AND created_at <= TIMESTAMP '{END}'"
# What shows an item of a section: a text and a number, as named in the document and in the SQL.
_SHOWN = {
    "topline_summary": ("total_comments", "total_entities"),
    "top_entities": ("entity_name", "mention_count"),
    "velocity_alerts": ("entity_name", "percent_change"),
    "discovered_entities": ("name", "mention_count"),
    "platform_breakdown": ("platform", "comment_count"),
    "sentiment_distribution": ("positive", "negative_pct"),
    "contextual_narrative": ("name", "mentions"),
    "entity_comparison": ("entity_name", "current_sentiment"),
    "what_changed": ("entity", "nth"),
    "cross_platform_deltas": ("entity", "delta"),
    "key_risks": ("risk", "nth"),
    "entity_micro_insights": ("insight", "rank"),
    "emotion_analysis": ("entity_name", "total_emotion_signals"),
    "topic_clusters": ("topic", "mentions"),
    "toxicity_alerts": ("comment_id", "toxicity"),
    "stance_summary": ("entity_name", "total"),
    "post_performance": ("url", "comment_count"),
    "storylines": ("storyline", "mention_count"),
    "risk_signals": ("risk", "severity"),
}
# Per section: rows with the place of the item, its text and its number.
_ITEMS = {
    "topline_summary": "SELECT 1, (SELECT n FROM heard), (SELECT count(*) FROM top)",
    "top_entities": "SELECT rank, entity_name, mention_count FROM top",
    "velocity_alerts": "SELECT alert_rank, entity_name, percent_change FROM al",
    "discovered_entities": "SELECT row_number() OVER (ORDER BY mention_count DESC, name), name, mention_count FROM listed",
    "platform_breakdown": "SELECT row_number() OVER (ORDER BY platform), platform, comment_count FROM pl",
    "sentiment_distribution": "SELECT 1, positive, round_even(CAST(negative AS DOUBLE) / (positive + negative + neutral) * 100, 1) FROM dist",
    "contextual_narrative": "SELECT rank, entity_name, mention_count FROM top WHERE rank <= 3",
    "entity_comparison": "SELECT rank, entity_name, avg_sentiment FROM top WHERE rank <= 5",
    "what_changed": "SELECT row_number() OVER (ORDER BY place, nth), entity_name, nth FROM moved WHERE nth <= keep",
    "cross_platform_deltas": "SELECT row_number() OVER (ORDER BY rank), entity_name, delta FROM deltas",
    "key_risks": "SELECT row_number() OVER (ORDER BY place, nth), risk, nth FROM risks",
    "entity_micro_insights": "SELECT rank, concat_ws(' • ', a, coalesce(v, l)), rank FROM insights",
    "emotion_analysis": "SELECT row_number() OVER (ORDER BY rank), entity_name, n FROM felt WHERE signal_type = 'emotion'",
    "topic_clusters": "SELECT row_number() OVER (ORDER BY n DESC, topic), topic, n FROM topics",
    "toxicity_alerts": "SELECT nth, comment_id, numeric_value FROM toxic WHERE nth <= 10",
    "stance_summary": "SELECT row_number() OVER (ORDER BY rank), entity_name, n FROM felt WHERE signal_type = 'stance'",
    "post_performance": "SELECT row_number() OVER (ORDER BY v.n DESC, v.post_id), p.url, v.n FROM busy v JOIN posts p ON p.post_id = v.post_id",
    "storylines": "SELECT row_number() OVER (ORDER BY n DESC, line), array_to_string(list_transform(string_split(line, ' '), lambda w: concat(upper(w[1]), w[2:])), ' '), n FROM hits",
}
_N = "(SELECT count(*) FROM items WHERE section = '%s')"
_TOLD = {
    "top_entities": """(SELECT concat(entity_name, ' dominated conversations with ', format('{:,}', mention_count), ' mentions and ',
        CASE WHEN avg_sentiment > 0.3 THEN 'positive' WHEN avg_sentiment < -0.3 THEN 'negative' ELSE 'neutral' END, ' sentiment (', printf('%+.2f', round_even(avg_sentiment, 2)), ').') FROM top WHERE rank = 1)""",
    "velocity_alerts": f"concat({_N}, ' entities with significant sentiment shifts (30%%+ change in 72hrs)')",
    "discovered_entities": f"concat({_N}, ' new entities discovered by NLP (not yet in monitoring)')",
    "platform_breakdown": "'Comment volume and sentiment by platform'",
    "contextual_narrative": """(SELECT concat_ws(' ', concat(entity_name, ' dominated conversations with ', format('{:,}', mention_count), ' mentions and ',
        CASE WHEN avg_sentiment > 0.3 THEN 'positive' WHEN avg_sentiment < -0.3 THEN 'negative' ELSE 'neutral' END, ' sentiment.'),
        (SELECT concat(entity_name, ' shows a critical sentiment shift (', printf('%+.1f', percent_change), '%), indicating significant change in public perception.')
          FROM al WHERE alert_rank = 1)) FROM top WHERE rank = 1)""",
    "entity_comparison": "'Top entities ranked by mention volume and sentiment'",
    "what_changed": """(SELECT concat(count(CASE WHEN place = 1 THEN 1 END), ' risers, ', count(CASE WHEN place = 2 THEN 1 END), ' fallers, ',
        count(CASE WHEN place = 3 THEN 1 END), ' new negative trends, ', count(CASE WHEN place = 4 THEN 1 END), ' new positive narratives') FROM moved)""",
    "cross_platform_deltas": f"concat('Platform-specific sentiment analysis for ', {_N}, ' top entities')",
    "key_risks": f"concat({_N}, ' actionable risks identified')",
    "emotion_analysis": f"CASE WHEN {_N} = 0 THEN 'No emotion signals found' ELSE concat('Emotion analysis for top ', {_N}, ' entities') END",
    "topic_clusters": f"CASE WHEN {_N} = 0 THEN 'No topic signals found' ELSE concat({_N}, ' trending topics identified') END",
    "toxicity_alerts": "(SELECT CASE WHEN count(*) = 0 THEN 'No high-toxicity comments detected' ELSE concat(count(*), ' high-toxicity comments (threshold: 0.7)') END FROM toxic)",
    "stance_summary": f"CASE WHEN {_N} = 0 THEN 'No stance signals found' ELSE concat('Stance breakdown for top ', {_N}, ' entities') END",
    "post_performance": """(SELECT concat('Top ', (SELECT count(*) FROM busy), ' posts by comment volume. Post sentiment distribution: ', count(CASE WHEN a > 0.3 THEN 1 END), ' positive, ',
        count(CASE WHEN a BETWEEN -0.3 AND 0.3 THEN 1 END), ' neutral, ', count(CASE WHEN a < -0.3 THEN 1 END), ' negative (out of ', count(*), ' posts with 5+ comments).') FROM judged)""",
    "storylines": f"""CASE WHEN {_N} = 0 THEN 'No clear storylines detected in high-engagement comments'
        ELSE concat({_N}, ' storylines detected from ', (SELECT n FROM heard), ' high-engagement comments') END""",
    "risk_signals": "'Risk signal detection not yet implemented'",
}


def _told(name: str) -> str:
    text = _TOLD.get(name, "CAST(NULL AS VARCHAR)")
    return text.replace(_N, _N % name).replace("%%", "%")


def _brief_sql() -> str:
    ranking = f"""
  tot AS (SELECT e.entity_id, e.name AS entity_name, count(DISTINCT f.comment_id) AS mention_count, avg(f.numeric_value) AS avg_sentiment,
      CAST(sum(f.likes) AS BIGINT) AS total_likes, true AS is_monitored FROM facts f JOIN entities e ON f.entity_id = e.entity_id
    WHERE f.signal_type = 'sentiment' AND f.numeric_value IS NOT NULL GROUP BY e.entity_id, e.name),
  said AS (SELECT comment_id, likes, lower(text) AS t FROM comment_texts WHERE created_at BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'),
  cand AS (SELECT name FROM found_names WHERE mention_count >= 10 AND lower(name) NOT IN ({listed(fv.REPORT_BLOCKLIST)})
    AND regexp_matches(name, '\\p{{L}}') AND lower(name) NOT IN (SELECT lower(name) FROM entities)),
  men AS (SELECT n.name, s.comment_id, s.likes FROM said s JOIN cand n ON contains(s.t, lower(n.name))),
  vol AS (SELECT name, count(*) AS mention_count, CAST(sum(likes) AS BIGINT) AS total_likes FROM men GROUP BY name HAVING count(*) >= 10),
  sen AS (SELECT name, avg(numeric_value) AS a FROM men JOIN facts f ON f.comment_id = men.comment_id AND signal_type = 'sentiment' GROUP BY name),
  every AS (SELECT * FROM tot UNION ALL SELECT NULL, v.name, v.mention_count, round_even(coalesce(a, 0), 3), v.total_likes, false FROM vol v LEFT JOIN sen ON sen.name = v.name),
  top AS (SELECT *, row_number() OVER (ORDER BY mention_count DESC, is_monitored DESC, entity_id, entity_name) AS rank FROM every
    ORDER BY mention_count DESC, is_monitored DESC, entity_id, entity_name LIMIT 10),"""
    a, b = _BASE.index("  tot AS"), _BASE.index("  al AS")
    base = _BASE[:a] + ranking.lstrip("\n") + "\n" + _BASE[b:]
    changes = _G6[_G6.index("  e AS"):_G6.index("  n AS")]
    risks = _G7[_G7.index("  r AS"):_G7.index("  SELECT CAST(place")]
    insights = _I3[_I3.index("  b AS"):_I3.index("  SELECT rank")].replace("  b AS", "  insights AS", 1)
    lines = " UNION ALL ".join(f"SELECT {i} AS ord, '{w}' AS line" for i, w in enumerate(_LINES))
    count = "CAST(sum(len(regexp_extract_all(concat(' ', regexp_replace(t, '[^\\p{L}\\p{N}_]', '  ', 'g'), ' '), concat(' ', replace(line, ' ', '  '), ' ')))) AS BIGINT)"
    items = " UNION ALL ".join(
        f"SELECT '{name}' AS section, CAST(place_of AS BIGINT) - 1 AS position, CAST(label AS VARCHAR) AS label, CAST(amount AS DOUBLE) AS amount FROM ({sql}) x(place_of, label, amount)"
        for name, sql in _ITEMS.items())
    told = " UNION ALL ".join(f"SELECT '{name}' AS section, '{br.TITLES[name]}' AS title, {_told(name)} AS summary" for name in _SHOWN)
    return f"""{base},
{changes}
  moved AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY o) AS nth FROM e),
{risks.rstrip()},
  risks AS (SELECT * FROM r ORDER BY place, nth LIMIT 5),
{insights.rstrip()},
  heard AS (SELECT count(*) AS n FROM comments WHERE created_at BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'),
  listed AS (SELECT name, mention_count FROM found_names WHERE mention_count >= 10 ORDER BY mention_count DESC, name LIMIT 10),
  dist AS (SELECT count(CASE WHEN numeric_value > 0.3 THEN 1 END) AS positive, count(CASE WHEN numeric_value < -0.3 THEN 1 END) AS negative,
    count(CASE WHEN numeric_value BETWEEN -0.3 AND 0.3 THEN 1 END) AS neutral FROM facts WHERE signal_type = 'sentiment'),
  sp AS (SELECT top.rank, top.entity_name, p.platform, avg(numeric_value) AS s FROM facts f JOIN posts p ON f.post_id = p.post_id
    JOIN top ON top.entity_id = f.entity_id WHERE top.rank <= 5 AND signal_type = 'sentiment' GROUP BY 1, 2, 3),
  deltas AS (SELECT rank, entity_name, max(s) - min(s) AS delta FROM sp GROUP BY 1, 2 HAVING count(*) >= 2),
  felt AS (SELECT t.rank, t.entity_name, f.signal_type, count(*) AS n FROM all_facts f JOIN top t ON t.entity_id = f.entity_id
    WHERE t.rank <= 5 AND (f.signal_type = 'emotion' OR f.signal_type = 'stance' AND f.value IN ('support', 'oppose', 'neutral')) AND f.{_LOOK_BACK} GROUP BY 1, 2, 3),
  topics AS (SELECT value AS topic, count(*) AS n FROM all_facts WHERE signal_type = 'topic' AND {_LOOK_BACK} GROUP BY value ORDER BY n DESC, topic LIMIT 10),
  toxic AS (SELECT comment_id, numeric_value, row_number() OVER (ORDER BY numeric_value DESC, likes DESC NULLS LAST, comment_id) AS nth FROM all_facts
    WHERE signal_type = 'toxicity' AND numeric_value >= 0.7 AND {_LOOK_BACK} ORDER BY nth LIMIT 50),
  busy AS (SELECT post_id, count(*) AS n FROM comments WHERE created_at BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' GROUP BY post_id ORDER BY n DESC, post_id LIMIT 10),
  judged AS (SELECT post_id, avg(numeric_value) AS a FROM facts WHERE signal_type = 'sentiment' GROUP BY post_id HAVING count(*) >= 5),
  lines AS ({lines}),
  hits AS (SELECT ord, line, {count} AS n FROM said, lines GROUP BY ord, line HAVING {count} >= 3 ORDER BY n DESC, ord LIMIT 5),
  items AS ({items}),
  told AS ({told})
  SELECT told.section, title, summary, position, label, amount FROM told LEFT JOIN items ON items.section = told.section"""


def _sections(c):
    found = c.view("found_names").select(
        "*", F.lit(False).alias("reviewed"), F.lit(None).cast("timestamp").alias("first_seen_at"),
        F.lit(None).cast("timestamp").alias("last_seen_at"), F.array().cast("array<string>").alias("sample_mentions"))
    return br.build_brief(c.tables(text=True).with_(discovered_entities=found), START, END, storyline_names=_LINES)


@query("b8_brief_document", _brief_sql())
def _(c):
    """The brief as a single JSON document, read back item by item."""
    document = br.brief_document(_sections(c), START, END)
    section = "struct<title:string, summary:string, items:array<map<string, string>>>"
    body = F.from_json("brief", ", ".join(f"{name} {section}" for name in _SHOWN))
    parts = F.array(*[
        F.struct(F.lit(name).alias("section"), F.lit(label).alias("of"), F.lit(amount).alias("by"), F.col(f"b.{name}").alias("is"))
        for name, (label, amount) in _SHOWN.items()])
    rows = document.select(body.alias("b")).select(F.explode(parts).alias("p"))
    shown = rows.select("p.section", "p.is.title", "p.is.summary", "p.of", "p.by", F.posexplode_outer("p.is.items").alias("position", "item"))
    return shown.select(
        "section", "title", "summary", F.col("position").cast("bigint").alias("position"),
        F.col("item")[F.col("of")].alias("label"), F.col("item")[F.col("by")].cast("double").alias("amount"))


@query("b8_brief_sections", "SELECT section, title, count(position) AS n_items FROM (" + _brief_sql() + ") x GROUP BY section, title")
def _(c):
    return br.brief_rows(_sections(c)).select("section", "title", "n_items")
