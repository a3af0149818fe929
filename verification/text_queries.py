"""Scoring, matching, text search and response parsing (families D and E)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from hearsay import fixed_values as fv
from hearsay.operators import enrich as en
from hearsay.operators import matching as ma
from hearsay.operators import responses as rs
from hearsay.operators import scoring as sc
from hearsay.operators.textsearch import find_terms
from hearsay.plans import analytics as an
from hearsay.plans import discovery as di
from hearsay.plans import quality as qa
from hearsay.plans import storylines as st
from hearsay.plans.facts import window_comments
from hearsay.sizing import let, unnest
from verification.core import END, START, VIEWS, query, rounded
from verification.function_queries import listed

# Frequent words of the test language stand in for the lexicon, beside the real one.
POSITIVE = ["that", "with", "ate", "great", "this", "les"]
NEGATIVE = ["from", "trash", "und", "worthless", "best"]
LEXICON = {"positive": POSITIVE, "negative": NEGATIVE}


def _hits(words: list[str], text: str = "lower(text)") -> str:
    return " + ".join(f"CASE WHEN contains({text}, '{w}') THEN 1 ELSE 0 END" for w in words)


# Unicode words of a text; a token is one that consists of letters a-z and apostrophes.
_WORDS = "list_transform(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_'']+'), lambda w: trim(w, ''''))"
_TOKENS = f"list_filter({_WORDS}, lambda w: regexp_full_match(w, '[a-z'']+'))"

VIEWS.update({
    "lexicon_hits": f"""
        SELECT comment_id, text, {_hits(POSITIVE)} AS p, {_hits(NEGATIVE)} AS n FROM tcomments""",
    "polarity": """
        SELECT 'the' AS word, CAST(0.25 AS DOUBLE) AS polarity, CAST(0.5 AS DOUBLE) AS subjectivity
        UNION ALL SELECT 'of', -0.5, 0.25 UNION ALL SELECT 'der', 0.75, 1.0 UNION ALL SELECT 'que', -0.25, 0.125
        UNION ALL SELECT 'le', 0.5, 0.0 UNION ALL SELECT 'and', 1.0, 0.75""",
    # Names claimed by discovered mentions: words and phrases of the test language.
    "found_names": """
        SELECT 'Retion' AS name, 'PERSON' AS entity_type, CAST(40 AS BIGINT) AS mention_count
        UNION ALL SELECT 'the of', 'ORG', 30 UNION ALL SELECT 'Elle Les', 'PERSON', 25 UNION ALL SELECT 'UND DER', 'PERSON', 20
        UNION ALL SELECT '100%_', 'ORG', 19 UNION ALL SELECT 'video', 'ORG', 18 UNION ALL SELECT 'license', NULL, 15
        UNION ALL SELECT 'rare', 'PERSON', 3 UNION ALL SELECT 'thing', 'PERSON', 12""",
})


@query("d1_lexicon_hits", "SELECT comment_id, p AS positive, n AS negative FROM lexicon_hits")
def _(c):
    groups = {"positive": (POSITIVE, []), "negative": (NEGATIVE, [])}
    return sc.lexicon_hits(c.view("tcomments").select("comment_id", "text"), F.col("text"), groups).drop("text")


@query("d1_fixed_lexicon_hits", f"""SELECT comment_id, {_hits(fv.POSITIVE_WORDS)} + {_hits(fv.POSITIVE_EMOJIS, 'text')} AS positive,
    {_hits(fv.NEGATIVE_WORDS)} + {_hits(fv.NEGATIVE_EMOJIS, 'text')} AS negative FROM tcomments""")
def _(c):
    groups = {"positive": (fv.POSITIVE_WORDS, fv.POSITIVE_EMOJIS), "negative": (fv.NEGATIVE_WORDS, fv.NEGATIVE_EMOJIS)}
    return sc.lexicon_hits(c.view("tcomments").select("comment_id", "text"), F.col("text"), groups).drop("text")


@query("d1_lexicon_tokens", f"""SELECT comment_id, len(list_intersect({_TOKENS}, ['that', 'with', 'ate', 'great', 'this', 'les'])) AS positive FROM tcomments""")
def _(c):
    found = sc.lexicon_hits(c.view("tcomments"), F.col("text"), {"positive": (POSITIVE, [])}, "token")
    return found.select("comment_id", F.col("positive").cast("bigint").alias("positive"))


_RULES = """CASE WHEN p + n >= 2 THEN CAST(p - n AS DOUBLE) / (p + n) ELSE %s END AS score,
    CASE WHEN p + n >= 2 THEN least(0.8::DOUBLE, 0.5::DOUBLE + (p + n) * 0.1::DOUBLE) ELSE 0.3::DOUBLE + %s * 0.4::DOUBLE END AS confidence"""


@query("d2_rule_scores", f"SELECT comment_id, {_RULES % ('0', '0')} FROM lexicon_hits")
def _(c):
    scored = sc.rule_scores(c.view("tcomments"), lexicon=LEXICON)
    return scored.select("comment_id", "sentiment.score", "sentiment.confidence")


@query("d3_word_polarity", f"""
  WITH tok AS (SELECT comment_id, unnest({_TOKENS}) AS word FROM tcomments)
  SELECT comment_id, avg(polarity) AS polarity, avg(subjectivity) AS subjectivity FROM tok JOIN polarity USING (word) GROUP BY comment_id""")
def _(c):
    return sc.word_polarity(c.view("tcomments"), "comment_id", "text", c.view("polarity"))


@query("d3_rule_scores_with_fallback", f"""
  WITH tok AS (SELECT comment_id, unnest({_TOKENS}) AS word FROM tcomments),
  pol AS (SELECT comment_id, avg(polarity) AS polarity, avg(subjectivity) AS subjectivity FROM tok JOIN polarity USING (word) GROUP BY comment_id)
  SELECT h.comment_id, {_RULES % ('coalesce(polarity, 0)', 'coalesce(subjectivity, 0)')}
  FROM lexicon_hits h LEFT JOIN pol ON h.comment_id = pol.comment_id""")
def _(c):
    scored = sc.rule_scores(c.view("tcomments"), words=c.view("polarity"), lexicon=LEXICON)
    return scored.select("comment_id", "sentiment.score", "sentiment.confidence")


def _length_scorer(text):
    """A stand-in for an external scorer."""
    n = F.length(text)
    return F.struct(
        ((n % 21 - 10).cast("double") / 16).alias("score"), F.lit(0.9).alias("confidence"), F.lit("length").alias("source_model"))


@query("d4_hybrid_scores", f"""SELECT comment_id, CASE WHEN sure THEN score ELSE CAST(length(text) % 21 - 10 AS DOUBLE) / 16 END AS score,
    CASE WHEN sure THEN confidence ELSE 0.9::DOUBLE END AS confidence, CASE WHEN sure THEN 'rule_based' ELSE 'length' END AS source_model
  FROM (SELECT comment_id, text, score, confidence, NOT (confidence < 0.7::DOUBLE OR abs(score) < 0.2::DOUBLE) AS sure
    FROM (SELECT comment_id, text, {_RULES % ('0', '0')} FROM lexicon_hits) a) b""")
def _(c):
    sc.register_scorer("test_rules", lambda df, text: sc.rule_scores(df, text, lexicon=LEXICON))
    sc.register_column_scorer("length", _length_scorer)
    scored = sc.hybrid_scores(c.view("tcomments"), cheap="test_rules", expensive="length")
    return scored.select("comment_id", "sentiment.*")


@query("d5_named_scorer", "SELECT comment_id, CAST(length(text) % 21 - 10 AS DOUBLE) / 16 AS score, 'length' AS source_model FROM tcomments")
def _(c):
    sc.register_column_scorer("length", _length_scorer)
    return sc.score_texts(c.view("tcomments"), scorer="length").select("comment_id", "sentiment.score", "sentiment.source_model")


# --------------------------------------------------------------- matching


@query("d6_catalog_terms", """SELECT t.term, t.entity_id, t.confidence, count(r.comment_id) AS comments
  FROM terms t LEFT JOIN tcomments r ON contains(lower(r.text), t.term) GROUP BY t.term, t.entity_id, t.confidence""")
def _(c):
    terms = ma.catalog_terms(c.catalog())
    hits = find_terms(c.view("tcomments").select("comment_id", "text"), "text", terms).groupBy("term").agg(F.count(F.lit(1)).alias("comments"))
    return terms.join(hits, "term", "left").select("term", "entity_id", "confidence", F.coalesce("comments", F.lit(0)).alias("comments"))


_D7 = """SELECT comment_id, entity_id, term AS mention_text, confidence FROM (
    SELECT r.comment_id, t.entity_id, t.term, t.confidence, row_number() OVER (PARTITION BY r.comment_id, t.entity_id ORDER BY t.place) AS rn
    FROM %s r JOIN terms t ON contains(lower(r.text), t.term)) x WHERE rn = 1"""


@query("d7_catalog_match", _D7 % "tcomments")
def _(c):
    return ma.full_name_mentions(c.view("tcomments"), c.catalog())


# Every run of two and of three words of the conversations is a term: tens of thousands.
_RUNS = """
  w AS (SELECT conv_id, turn, string_split(regexp_replace(lower(text), '[ ]+', ' ', 'g'), ' ') AS ws FROM conversations WHERE text IS NOT NULL),
  runs AS (SELECT DISTINCT unnest(list_concat(
      list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]),
      list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) AS term FROM w)"""


@query("d7_many_terms", f"""
  WITH {_RUNS}
  SELECT c.conv_id, c.turn, count(*) AS terms, sum(length(t.term)) AS chars FROM conversations c JOIN runs t ON contains(lower(c.text), t.term)
  WHERE t.term <> '' GROUP BY c.conv_id, c.turn""")
def _(c):
    turns = c.view("conversations").select("conv_id", "turn", "text")
    words = F.split(F.regexp_replace(F.lower("text"), "[ ]+", " "), " ")

    def runs(ws, size):
        n = F.size(ws)
        return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.array_join(F.slice(ws, i, size), " "))).otherwise(F.array().cast("array<string>"))

    # Words are split once a text, not once a run.
    both = let(words, lambda ws: F.concat(runs(ws, 2), runs(ws, 3)))
    # No hit depends on the order of the terms.
    terms = unnest(turns, [], both, "term").distinct().withColumn("ord", F.lit(0))
    hits = find_terms(turns.select("conv_id", "turn", "text"), "text", terms)
    return hits.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("terms"), F.sum(F.char_length("term")).alias("chars"))


@query("d8_caption_context", """SELECT DISTINCT p.post_id, k.entity_id FROM posts p JOIN claims k ON contains(lower(p.caption), k.term)""")
def _(c):
    return ma.caption_context(c.catalog(), c.view("posts"))


_D11 = f"""
  WITH ctx AS (SELECT DISTINCT p.post_id, k.entity_id FROM tposts p JOIN claims k ON contains(lower(p.caption), k.term)),
  parts AS (SELECT entity_id, string_split(lower(name), ' ')[1] AS first,
      CASE WHEN contains(name, ' ') THEN string_split(lower(name), ' ')[-1] END AS last FROM catalog),
  uniq AS (SELECT *, count(*) OVER (PARTITION BY first) = 1 AS first_only, count(*) OVER (PARTITION BY last) = 1 AS last_only FROM parts),
  w AS (SELECT comment_id, post_id, {_TOKENS} AS words FROM replies),
  full_hits AS ({_D7 % 'replies'}),
  cand AS (SELECT w.comment_id, u.entity_id, u.first, u.last, list_contains(words, first) AS has_first,
      coalesce(list_contains(words, last), false) AS has_last, first_only, last_only, ctx.entity_id IS NOT NULL AS near,
      list_has_any(words, ['she', 'her', 'hers', 'he', 'him', 'his']) AS spoken
    FROM w CROSS JOIN uniq u LEFT JOIN ctx ON ctx.post_id = w.post_id AND ctx.entity_id = u.entity_id),
  partial AS (SELECT comment_id, entity_id,
      CASE WHEN has_first AND (first_only OR near) THEN first WHEN has_last AND (last_only OR near) THEN last
           WHEN near AND spoken THEN 'pronoun' END AS mention_text,
      CASE WHEN has_first AND (first_only OR near) THEN CASE WHEN near THEN 0.75::DOUBLE ELSE 0.65::DOUBLE END
           WHEN has_last AND (last_only OR near) THEN CASE WHEN near THEN 0.7::DOUBLE ELSE 0.6::DOUBLE END
           WHEN near AND spoken THEN 0.45::DOUBLE END AS confidence FROM cand)
  SELECT * FROM full_hits UNION ALL
  SELECT p.* FROM partial p WHERE confidence IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM full_hits f WHERE f.comment_id = p.comment_id AND f.entity_id = p.entity_id)"""


@query("d11_catalog_mentions", _D11)
def _(c):
    return ma.catalog_mentions(c.view("replies"), c.catalog(), c.view("tposts"))


@query("d11_catalog_mentions_joined", _D11)
def _(c):
    # As one array per comment, joined back to its comments.
    found = ma.mention_arrays(c.view("replies"), c.catalog(), c.view("tposts"))
    return c.view("replies").select("comment_id").join(found.select("comment_id", "mentions"), "comment_id").selectExpr("comment_id", "inline(mentions)")


@query("d9_partial_names", f"SELECT * FROM ({_D11}) m WHERE confidence BETWEEN 0.59 AND 0.76")
def _(c):
    found = ma.catalog_mentions(c.view("replies"), c.catalog(), c.view("tposts"))
    return found.filter(F.col("confidence").isin(
        fv.CONFIDENCE_FIRST_IN_CONTEXT, fv.CONFIDENCE_FIRST_UNIQUE, fv.CONFIDENCE_LAST_IN_CONTEXT, fv.CONFIDENCE_LAST_UNIQUE))


@query("d10_pronouns", f"SELECT comment_id, entity_id FROM ({_D11}) m WHERE mention_text = 'pronoun'")
def _(c):
    found = ma.catalog_mentions(c.view("replies"), c.catalog(), c.view("tposts"))
    return found.filter("mention_text = 'pronoun'").select("comment_id", "entity_id")


_CAPS = "regexp_extract_all(text, '\\p{Lu}[\\p{L}''’-]+(?:[ ]\\p{Lu}[\\p{L}''’-]+){1,}')"


@query("d12_discovered_mentions", f"""
  WITH hits AS ({_D7 % 'tcomments'}), ann AS (SELECT comment_id, unnest({_CAPS}) AS name FROM tcomments)
  SELECT comment_id, name, 'PERSON' AS entity_type, 0.7::DOUBLE AS confidence FROM ann
  WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.comment_id = ann.comment_id AND h.mention_text = lower(ann.name))""")
def _(c):
    comments = c.view("tcomments")
    return ma.new_mentions(ma.mine_mentions(comments), ma.full_name_mentions(comments, c.catalog()))


@query("d13_alias_resolution", """
  WITH owner AS (SELECT term, max_by(entity_id, place) AS entity_id FROM claims GROUP BY term),
  asked AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN ' OF THE ' WHEN 1 THEN 'Than' WHEN 2 THEN 'apache'
    WHEN 3 THEN 'nobody' WHEN 4 THEN 'thing thou' ELSE 'Und Die' END AS name FROM events)
  SELECT a.event_id, a.name, o.entity_id AS resolved_entity_id FROM asked a LEFT JOIN owner o ON o.term = lower(trim(a.name))""")
def _(c):
    asked = c.sql("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN ' OF THE ' WHEN 1 THEN 'Than' WHEN 2 THEN 'apache'
      WHEN 3 THEN 'nobody' WHEN 4 THEN 'thing thou' ELSE 'Und Die' END AS name FROM events""")
    return ma.resolve_names(asked, "name", c.catalog())


# -------------------------------------------------------------- responses

# Scores and labels the responses were built from; cut responses keep what a pattern still finds.
_PARTS = """
  WITH r AS (SELECT comment_id, raw_json, json_valid(raw_json) AS ok FROM responses),
  j AS (SELECT comment_id, ok, raw_json,
      CASE WHEN ok THEN raw_json->>'$.emotion' ELSE nullif(regexp_extract(raw_json, '"emotion"\\s*:\\s*"([^"]+)"', 1), '') END AS emotion,
      CASE WHEN ok THEN raw_json->>'$.stance' ELSE nullif(regexp_extract(raw_json, '"stance"\\s*:\\s*"([^"]+)"', 1), '') END AS stance,
      CASE WHEN ok THEN raw_json->>'$.toxicity' ELSE regexp_extract(raw_json, '"toxicity"\\s*:\\s*(\\d+\\.?\\d*)', 1) END AS toxicity,
      CASE WHEN ok THEN raw_json->>'$.sarcasm' ELSE regexp_extract(raw_json, '"sarcasm"\\s*:\\s*(true|false)', 1) END AS sarcasm,
      regexp_extract(raw_json, '"entity_scores"\\s*:\\s*\\{([^}]*)\\}', 1) AS scores,
      regexp_extract(raw_json, '"topics"\\s*:\\s*\\[([^\\]]*)\\]', 1) AS topics,
      regexp_extract(raw_json, '"other_entities"\\s*:\\s*\\[([^\\]]*)\\]', 1) AS others FROM r),
  s AS (SELECT comment_id, unnest(regexp_extract_all(scores, '"([^"]+)"\\s*:\\s*(-?\\d+\\.?\\d*)', 1)) AS raw_name,
      CAST(unnest(regexp_extract_all(scores, '"([^"]+)"\\s*:\\s*(-?\\d+\\.?\\d*)', 2)) AS DOUBLE) AS score FROM j),
  sc AS (SELECT s.comment_id, replace(raw_name, ' (hint)', '') AS name, score,
      coalesce(CASE WHEN ok THEN CAST(raw_json->'entity_confidence'->>replace(raw_name, ' (hint)', '') AS DOUBLE) END, 0.8) AS confidence
    FROM s JOIN j ON s.comment_id = j.comment_id WHERE score BETWEEN -1 AND 1),
  lab AS (SELECT comment_id, NOT ok AS recovered,
      CASE WHEN lower(emotion) IN ('anger', 'disgust', 'joy', 'disappointment', 'sarcasm', 'neutral') THEN lower(emotion) ELSE 'neutral' END AS emotion,
      CASE WHEN lower(stance) IN ('support', 'oppose', 'neutral') THEN lower(stance) ELSE 'neutral' END AS stance,
      coalesce(sarcasm = 'true', false) AS sarcasm, greatest(0::DOUBLE, least(1::DOUBLE, coalesce(try_cast(toxicity AS DOUBLE), 0))) AS toxicity,
      CASE WHEN ok THEN list_filter(json_extract_string(raw_json, '$.topics[*]'), lambda t: t <> '') ELSE regexp_extract_all(topics, '"([^"]+)"', 1) END AS topics,
      CASE WHEN ok THEN json_extract_string(raw_json, '$.other_entities[*]') ELSE regexp_extract_all(others, '"([^"]+)"', 1) END AS others FROM j)"""


def _analyses(c):
    return rs.parse_responses(c.view("responses"))


@query("d14_response_fields", _PARTS + """ SELECT comment_id, emotion, stance, sarcasm, toxicity,
    list_aggregate(topics, 'string_agg', '|') AS topics, list_aggregate(others, 'string_agg', '|') AS others FROM lab""")
def _(c):
    a = _analyses(c)
    return a.select(
        "comment_id", "analysis.emotion", "analysis.stance", "analysis.sarcasm", "analysis.toxicity",
        F.nullif(F.array_join("analysis.topics", "|"), F.lit("")).alias("topics"),
        F.nullif(F.array_join("analysis.other_entities", "|"), F.lit("")).alias("others"))


@query("d15_recovered_responses", _PARTS + """ SELECT recovered, count(*) AS n, count(CASE WHEN emotion <> 'neutral' THEN 1 END) AS with_emotion,
    count(CASE WHEN toxicity > 0 THEN 1 END) AS with_toxicity, count(CASE WHEN len(topics) > 0 THEN 1 END) AS with_topics FROM lab GROUP BY recovered""")
def _(c):
    a = _analyses(c)
    return a.groupBy("recovered").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("analysis.emotion") != "neutral").alias("with_emotion"),
        F.count_if(F.col("analysis.toxicity") > 0).alias("with_toxicity"), F.count_if(F.size("analysis.topics") > 0).alias("with_topics"))


@query("d16_validated_scores", _PARTS + " SELECT comment_id, name, score, confidence FROM sc")
def _(c):
    scores = _analyses(c).select("comment_id", F.explode_outer("analysis.entity_scores").alias("name", "score"), "analysis.entity_confidence").filter("name is not null")
    return scores.select("comment_id", "name", "score", F.try_element_at("entity_confidence", "name").alias("confidence"))


_LEVEL = """CASE WHEN {0} >= 0.7 THEN 'Strongly Positive' WHEN {0} >= 0.3 THEN 'Positive' WHEN {0} > -0.3 THEN 'Neutral'
  WHEN {0} > -0.7 THEN 'Negative' ELSE 'Strongly Negative' END"""

# Comments mention one entity when the number of likes allows; names resolve to nations.
_FANOUT = _PARTS + f""",
  co AS (SELECT comment_id, likes, CASE WHEN likes % 3 = 0 THEN likes % 25 END AS m, 1 + likes / 100::DOUBLE AS w FROM comments),
  nn AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name FROM nation),
  fan AS (
    SELECT sc.comment_id, nn.id AS entity_id, 'sentiment' AS signal_type, {_LEVEL.format('score')} AS value, score AS numeric_value, confidence
      FROM sc JOIN nn ON lower(n_name) = lower(name) WHERE confidence >= 0.7 AND length(regexp_replace(name, '\\P{{L}}', '', 'g')) * 2 >= length(name)
    UNION ALL SELECT lab.comment_id, m, 'sentiment', {_LEVEL.format("st")}, st, 0.7 FROM (
      SELECT comment_id, CASE stance WHEN 'oppose' THEN -0.5::DOUBLE WHEN 'support' THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS st FROM lab) lab
      JOIN co ON co.comment_id = lab.comment_id WHERE m IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sc WHERE sc.comment_id = lab.comment_id)
    UNION ALL SELECT lab.comment_id, m, 'emotion', emotion, NULL, 0.8 FROM lab JOIN co ON co.comment_id = lab.comment_id
    UNION ALL SELECT DISTINCT comment_id, CAST(NULL AS BIGINT), 'topic', t, CAST(NULL AS DOUBLE), 0.7::DOUBLE FROM (SELECT comment_id, unnest(topics) AS t FROM lab) x
    UNION ALL SELECT comment_id, NULL, 'toxicity', CASE WHEN toxicity >= 0.7 THEN 'high' WHEN toxicity >= 0.4 THEN 'medium' ELSE 'low' END, toxicity, 0.8 FROM lab
    UNION ALL SELECT comment_id, NULL, 'sarcasm', 'sarcasm', 1, 0.7 FROM lab WHERE sarcasm)"""


def _analysed(c):
    """Analyses of all events, on comments that mention one nation or none."""
    found = F.struct((F.col("likes") % 25).alias("entity_id"), F.lit("n").alias("mention_text"), F.lit(1.0).alias("confidence"))
    none = F.array().cast("array<struct<entity_id:bigint,mention_text:string,confidence:double>>")
    comments = c.view("comments").withColumn("mentions", F.when(F.col("likes") % 3 == 0, F.array(found)).otherwise(none))
    comments = comments.withColumn("text", F.concat(F.lit("by "), "author_name")).withColumn("caption", F.lit(None).cast("string"))
    return en.analysed_comments(comments, _analyses(c))


def _nations(c):
    return c.view("entities").withColumn("canonical_name", F.col("name")).withColumn("aliases", F.array().cast("array<string>"))


@query("d17_signal_fanout", _FANOUT + " SELECT fan.comment_id, entity_id, signal_type, value, numeric_value, w AS weight_score, confidence FROM fan JOIN co ON co.comment_id = fan.comment_id")
def _(c):
    signals = en.response_signals(_analysed(c), _nations(c), F.timestamp_seconds(F.lit(0)), "model")
    return signals.select("comment_id", "entity_id", "signal_type", "value", "numeric_value", "weight_score", "confidence")


@query("d18_stance_fallback", _FANOUT + """ SELECT value, numeric_value, count(*) AS n FROM fan WHERE signal_type = 'sentiment'
    AND NOT EXISTS (SELECT 1 FROM sc WHERE sc.comment_id = fan.comment_id) GROUP BY value, numeric_value""")
def _(c):
    unscored = _analysed(c).filter(F.size("analysis.entity_scores") == 0)
    signals = en.response_signals(unscored, _nations(c), F.timestamp_seconds(F.lit(0)), "model")
    return signals.filter("signal_type = 'sentiment'").groupBy("value", "numeric_value").agg(F.count(F.lit(1)).alias("n"))


@query("d19_review_items", _PARTS + """
  SELECT comment_id, name AS entity_mention, confidence, concat('Low confidence (', printf('%.2f', confidence), ') for entity assignment') AS reason
  FROM sc WHERE confidence < 0.7 AND length(regexp_replace(name, '\\P{L}', '', 'g')) * 2 >= length(name)
  UNION ALL SELECT comment_id, 'Justin', 0.4::DOUBLE, 'two of them' FROM j WHERE ok AND contains(raw_json, 'two of them')""")
def _(c):
    items = en.review_items(_analysed(c), F.timestamp_seconds(F.lit(0)))
    return items.select("comment_id", "entity_mention", "confidence", "reason")


@query("d20_discovered_names", _PARTS + """,
  all_names AS (SELECT comment_id, unnest(others) AS name FROM lab
    UNION ALL SELECT comment_id, name FROM sc WHERE NOT EXISTS (SELECT 1 FROM nation WHERE lower(n_name) = lower(name)))
  SELECT DISTINCT comment_id, name FROM all_names WHERE lower(name) <> 'photo'""")
def _(c):
    return en.discovered_from_responses(_analysed(c), _nations(c)).select("comment_id", "name")


RULE_SIGNALS_SQL = f"""
  WITH sco AS (SELECT comment_id, {_RULES % ('0', '0')} FROM (SELECT comment_id,
      {_hits(fv.POSITIVE_WORDS)} + {_hits(fv.POSITIVE_EMOJIS, 'text')} AS p, {_hits(fv.NEGATIVE_WORDS)} + {_hits(fv.NEGATIVE_EMOJIS, 'text')} AS n FROM replies) h),
  men AS (SELECT * FROM ({_D11}) d)
  SELECT s.comment_id, m.entity_id, {_LEVEL.format('score')} AS value, score AS numeric_value, round(coalesce(m.confidence, 1) * s.confidence, 6) AS confidence
  FROM sco s JOIN (SELECT comment_id, entity_id, confidence FROM men UNION ALL SELECT comment_id, NULL, NULL FROM replies) m ON m.comment_id = s.comment_id"""


@query("d21_rule_signals", RULE_SIGNALS_SQL)
def _(c):
    signals = en.rule_signals(c.view("replies"), c.catalog(), c.view("tposts"), F.timestamp_seconds(F.lit(0)))
    return rounded(signals.select("comment_id", "entity_id", "value", "numeric_value", "confidence"), "confidence")


@query("d22_enrichment_stats", _FANOUT + """
  SELECT 'comments_processed' AS kind, count(*) AS count FROM lab UNION ALL SELECT 'signals_created', count(*) FROM fan
  UNION ALL SELECT 'entities_discovered', count(DISTINCT (comment_id, name)) FROM (SELECT comment_id, unnest(others) AS name FROM lab
    UNION ALL SELECT comment_id, name FROM sc WHERE NOT EXISTS (SELECT 1 FROM nation WHERE lower(n_name) = lower(name))) a WHERE lower(name) <> 'photo'""")
def _(c):
    analysed = _analysed(c)
    signals = en.response_signals(analysed, _nations(c), F.timestamp_seconds(F.lit(0)), "model")
    return en.enrichment_stats(analysed, signals, en.discovered_from_responses(analysed, _nations(c)))


# ------------------------------------------------------------ whole runs

def _run_sql(answered: str, counts: str = "") -> str:
    """The stored tables after a run over all replies; ``answered`` gives each its response or NULL."""
    return f"""
  WITH rr AS (SELECT comment_id, coalesce(raw_json, '{{}}') AS raw_json FROM ({answered}) a),
  men AS (SELECT d.* FROM ({_D11}) d JOIN rr ON rr.comment_id = d.comment_id),
  {_PARTS.replace("FROM responses)", "FROM rr)").strip()[4:]},
  ent AS (SELECT entity_id, concat('nation_', entity_id) AS key FROM catalog),
  fan AS (
    SELECT sc.comment_id, ent.entity_id, 'sentiment' AS kind, {_LEVEL.format('score')} AS value, score AS numeric_value, confidence
      FROM sc JOIN ent ON key = lower(name) WHERE confidence >= 0.7
    UNION ALL SELECT comment_id, entity_id, 'sentiment', {_LEVEL.format('st')}, st, 0.7 FROM (
      SELECT men.comment_id, entity_id, CASE stance WHEN 'oppose' THEN -0.5::DOUBLE WHEN 'support' THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS st
      FROM lab JOIN men ON men.comment_id = lab.comment_id WHERE NOT EXISTS (SELECT 1 FROM sc WHERE sc.comment_id = lab.comment_id)) x
    UNION ALL SELECT lab.comment_id, entity_id, 'emotion', emotion, NULL, 0.8 FROM lab LEFT JOIN men ON men.comment_id = lab.comment_id
    UNION ALL SELECT DISTINCT comment_id, CAST(NULL AS BIGINT), 'topic', t, CAST(NULL AS DOUBLE), 0.7::DOUBLE FROM (SELECT comment_id, unnest(topics) AS t FROM lab) x
    UNION ALL SELECT comment_id, NULL, 'toxicity', CASE WHEN toxicity >= 0.7 THEN 'high' WHEN toxicity >= 0.4 THEN 'medium' ELSE 'low' END, toxicity, 0.8 FROM lab
    UNION ALL SELECT comment_id, NULL, 'sarcasm', 'sarcasm', 1, 0.7 FROM lab WHERE sarcasm),
  run_names AS (
    SELECT comment_id, name FROM (SELECT comment_id, unnest(others) AS name FROM lab
      UNION ALL SELECT comment_id, name FROM sc WHERE lower(name) NOT IN (SELECT key FROM ent)) o WHERE lower(name) <> 'photo'
    UNION SELECT a.comment_id, name FROM (SELECT comment_id, unnest({_CAPS}) AS name FROM replies) a JOIN rr ON rr.comment_id = a.comment_id
      WHERE NOT EXISTS (SELECT 1 FROM men WHERE men.comment_id = a.comment_id AND mention_text = lower(name))),
  run_items AS (SELECT comment_id, name, confidence FROM sc WHERE confidence < 0.7
    UNION ALL SELECT comment_id, 'Justin', 0.4::DOUBLE FROM j WHERE ok AND contains(raw_json, 'two of them')),
  run_stored AS (SELECT kind, comment_id, entity_id, value, numeric_value, confidence, CAST(NULL AS BIGINT) AS n FROM fan
    UNION ALL SELECT 'discovered', NULL, NULL, name, NULL, NULL, count(*) FROM run_names GROUP BY name
    UNION ALL SELECT 'review', comment_id, NULL, name, NULL, confidence, NULL FROM run_items)
  SELECT * FROM run_stored{counts}"""


def _run_store(c, root: str, counts=None):
    from hearsay.tables import read_tables

    stored = read_tables(c.spark, root, ["extracted_signals", "discovered_entities", "review_queue"])
    columns = ["kind", "comment_id", "entity_id", "value", "numeric_value", "confidence", "n"]
    kinds = ["string", "bigint", "bigint", "string", "double", "double", "bigint"]

    def rows(df, **given):
        return df.select(*[given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in zip(columns, kinds)])

    s, d, q = stored.extracted_signals, stored.discovered_entities, stored.review_queue
    out = rows(s, **{**{n: F.col(n) for n in columns[1:6]}, "kind": F.col("signal_type")})
    out = out.unionByName(rows(d, kind=F.lit("discovered"), value=F.col("name"), n=F.col("mention_count")))
    out = out.unionByName(rows(q, kind=F.lit("review"), comment_id=F.col("comment_id"), value=F.col("entity_mention"), confidence=F.col("confidence")))
    return out if counts is None else out.unionByName(rows(counts, kind=F.col("kind"), n=F.col("count")))


def _run_catalog(c):
    known = F.concat(F.lit("NATION_"), F.col("entity_id").cast("string"))
    return c.catalog().withColumn("aliases", F.concat("aliases", F.array(known)))


@query("d22_enrichment_run", _run_sql("SELECT c.comment_id, raw_json FROM run_comments c LEFT JOIN run_responses r ON r.comment_id = c.comment_id", """
  UNION ALL SELECT 'comments_processed', NULL, NULL, NULL, NULL, NULL, count(*) FROM rr
  UNION ALL SELECT 'signals_created', NULL, NULL, NULL, NULL, NULL, count(*) FROM fan
  UNION ALL SELECT 'entities_discovered', NULL, NULL, NULL, NULL, NULL, count(*) FROM run_names
  UNION ALL SELECT 'queued_for_review', NULL, NULL, NULL, NULL, NULL, count(*) FROM run_items"""))
def _(c):
    from hearsay.operators.run import create_store, enrich
    from hearsay.session import scratch_path

    root = scratch_path(c.spark, "store")
    create_store(c.spark, root)
    for name in ("first", "second"):
        # The second run meets all comments again and changes nothing.
        counts = enrich(c.view("run_comments"), c.view("run_responses"), _run_catalog(c), c.view("tposts"), root, name, F.timestamp_seconds(F.lit(0)), "model")
    return _run_store(c, root, counts)


# Responses of a third of the comments come too late; the last day's comments are still waiting for theirs.
@query("j2_response_stream", _run_sql("""
  SELECT c.comment_id, r.raw_json FROM run_comments c LEFT JOIN run_responses r
    ON r.comment_id = c.comment_id AND r.responded_at <= c.created_at + INTERVAL '1' HOUR
  WHERE r.comment_id IS NOT NULL OR c.created_at < (SELECT max(created_at) FROM run_comments)"""))
def _(c):
    from hearsay.operators.run import create_store
    from hearsay.session import scratch_path
    from hearsay.streaming.jobs import response_stream

    def live(name):
        path = scratch_path(c.spark, name)
        c.view(name).write.parquet(path)
        return c.spark.readStream.schema(c.view(name).schema).parquet(path)

    root = scratch_path(c.spark, "store")
    create_store(c.spark, root)
    response_stream(
        live("run_comments"), live("run_responses"), _run_catalog(c), c.view("tposts"), root, scratch_path(c.spark, "progress"),
        F.timestamp_seconds(F.lit(0)), "model",
    ).awaitTermination()
    return _run_store(c, root)


@query("f25_score_totals", _PARTS + """ SELECT count(*) AS responses, count(DISTINCT sc.comment_id) AS with_entity_scores,
    count(DISTINCT CASE WHEN recovered THEN lab.comment_id END) AS recovered, count(DISTINCT CASE WHEN toxicity > 0.5 THEN lab.comment_id END) AS high_toxicity,
    max(toxicity) AS max_toxicity FROM lab LEFT JOIN sc ON sc.comment_id = lab.comment_id""")
def _(c):
    return qa.analysis_totals(_analyses(c)).drop("avg_toxicity")


@query("f25_label_counts", _PARTS + """ SELECT 'emotion' AS kind, emotion AS label, count(*) AS count FROM lab GROUP BY emotion
  UNION ALL SELECT 'stance', stance, count(*) FROM lab GROUP BY stance
  UNION ALL SELECT 'entities', CAST(n AS VARCHAR), count(*) FROM (SELECT lab.comment_id, count(sc.name) AS n FROM lab LEFT JOIN sc ON sc.comment_id = lab.comment_id GROUP BY 1) x GROUP BY n""")
def _(c):
    return qa.label_counts(_analyses(c))


@query("f25_scored_name_stats", _PARTS + """ SELECT name AS entity_name, count(*) AS scores, round(avg(score), 6) AS avg_score, min(score) AS min_score,
    max(score) AS max_score, count(CASE WHEN score < -0.5 THEN 1 END) AS low_scores,
    round_even(count(CASE WHEN score < -0.5 THEN 1 END) * 100::DOUBLE / count(*), 1) AS low_pct FROM sc GROUP BY name""")
def _(c):
    return rounded(qa.scored_name_stats(_analyses(c)), "avg_score")


# ------------------------------------------------------------------ joins


@query("e4_unenriched", """SELECT comment_id FROM comments c WHERE NOT EXISTS (
    SELECT 1 FROM signals s WHERE s.comment_id = c.comment_id AND s.signal_type = 'sentiment')""")
def _(c):
    some = c.view("signals").filter("signal_type = 'sentiment'")
    return en.work_set(c.view("comments"), some).select("comment_id")


@query("e5_listed_comments", """SELECT comment_id, likes FROM comments WHERE comment_id IN (SELECT comment_id FROM signals WHERE signal_type = 'topic')""")
def _(c):
    ids = c.view("signals").filter("signal_type = 'topic'")
    return en.work_set(c.view("comments"), ids=ids).select("comment_id", "likes")


@query("a12_work_set_since", "SELECT comment_id FROM comments WHERE created_at >= TIMESTAMP '2024-01-20 00:00:00'")
def _(c):
    return en.work_set(c.view("comments"), since="2024-01-20 00:00:00").select("comment_id")


_E6 = f"""SELECT n.name, n.entity_type, t.comment_id, t.likes FROM tcomments t JOIN found_names n ON contains(lower(t.text), lower(n.name))
  WHERE t.created_at BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '{END}'"""


def _text_tables(c):
    return c.tables().with_(comments=c.view("tcomments"), posts=c.view("tposts"), monitored_entities=c.catalog())


@query("e6_name_mentions", _E6)
def _(c):
    names = c.view("found_names").select("name", "entity_type")
    return di.name_mentions(_text_tables(c), names, "2024-01-01 00:00:00", END).select("name", "entity_type", "comment_id", "likes")


@query("e6_name_mentions_joined", _E6)
def _(c):
    names = c.view("found_names").select("name", "entity_type")
    # Several automata, one pass.
    comments = window_comments(_text_tables(c), "2024-01-01 00:00:00", END).select("comment_id", "likes", "text")
    terms = names.select("*", F.col("name").alias("ord"), F.lower("name").alias("term"))
    return find_terms(comments, "text", terms, table_bytes=1 << 10).select("name", "entity_type", "comment_id", "likes")


@query("e7_caption_entity", """SELECT post_id, name AS caption_entity FROM (SELECT p.post_id, c.name,
    row_number() OVER (PARTITION BY p.post_id ORDER BY k.load_order) AS rn
  FROM posts p JOIN claims k ON contains(lower(p.caption), k.term) JOIN catalog c ON c.entity_id = k.entity_id) x WHERE rn = 1""")
def _(c):
    t = c.tables().with_(monitored_entities=c.catalog())
    return an.caption_entity(t, c.view("posts"))


@query("e8_unmonitored", f"""SELECT name FROM (SELECT DISTINCT p_name AS name FROM part UNION ALL SELECT name FROM catalog) n
  WHERE lower(name) NOT IN (SELECT lower(name) FROM catalog)""")
def _(c):
    names = c.sql("SELECT DISTINCT p_name AS name FROM part UNION ALL SELECT name FROM catalog")
    return di.unmonitored(names, c.catalog())


@query("e9_promoted_ids", """SELECT n.name AS entity_name, e.entity_id FROM (SELECT DISTINCT p_name AS name FROM part UNION ALL SELECT name FROM catalog) n
  LEFT JOIN catalog e ON e.name = n.name""")
def _(c):
    names = c.sql("SELECT DISTINCT p_name AS name FROM part UNION ALL SELECT name FROM catalog")
    ranking = names.select(F.lit(None).cast("bigint").alias("entity_id"), F.col("name").alias("entity_name"))
    return di.resolve_promoted(c.tables().with_(monitored_entities=c.catalog()), ranking).select("entity_name", "entity_id")


_F13 = f"""
  WITH win AS (SELECT t.*, p.platform FROM tcomments t JOIN tposts p ON p.post_id = t.post_id
    WHERE t.created_at BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-30 00:00:00' @platforms),
  mon AS (SELECT s.entity_id % 7 + 1 AS entity_id, s.* EXCLUDE (entity_id) FROM signals s WHERE signal_type = 'sentiment' AND s.entity_id IS NOT NULL),
  top AS (SELECT c.entity_id, c.name AS entity_name, 'person' AS entity_type, count(DISTINCT m.comment_id) AS mention_count, avg(numeric_value) AS avg_sentiment,
      CAST(sum(w.likes) AS BIGINT) AS total_likes, sum(numeric_value * weight_score) / sum(weight_score) AS weighted_sentiment, true AS is_monitored
    FROM mon m JOIN win w ON w.comment_id = m.comment_id JOIN catalog c ON c.entity_id = m.entity_id GROUP BY c.entity_id, c.name),
  cand AS (SELECT name, coalesce(entity_type, 'unknown') AS entity_type FROM found_names WHERE mention_count >= 10 AND lower(name) NOT IN ({listed(fv.REPORT_BLOCKLIST)})
    AND regexp_matches(name, '\\p{{L}}') AND lower(name) NOT IN (SELECT lower(name) FROM catalog)),
  men AS (SELECT n.name, n.entity_type, w.comment_id, w.likes FROM win w JOIN cand n ON contains(lower(w.text), lower(n.name))),
  vol AS (SELECT name, entity_type, count(*) AS mention_count, CAST(sum(likes) AS BIGINT) AS total_likes FROM men GROUP BY name, entity_type HAVING count(*) >= 10),
  sen AS (SELECT name, avg(numeric_value) AS a, sum(numeric_value * weight_score) / sum(weight_score) AS w FROM men
    JOIN signals s ON s.comment_id = men.comment_id AND signal_type = 'sentiment' GROUP BY name)
  SELECT * FROM (SELECT * FROM top UNION ALL SELECT NULL, v.name, v.entity_type, v.mention_count, round_even(coalesce(a, 0), 3), v.total_likes,
      round_even(CASE WHEN coalesce(a, 0) = 0 THEN 0 ELSE w END, 3), false FROM vol v LEFT JOIN sen ON sen.name = v.name) u
  ORDER BY mention_count DESC, is_monitored DESC, entity_id, entity_name LIMIT 10"""


def _dynamic(c, platforms=None):
    signals = c.view("signals").withColumn("entity_id", F.col("entity_id") % 7 + 1)
    found = c.view("found_names").withColumn("reviewed", F.lit(False))
    t = _text_tables(c).with_(extracted_signals=signals, discovered_entities=found)
    return di.dynamic_entities(t, "2024-01-01 00:00:00", "2024-01-30 00:00:00", 10, platforms, 10)


@query("f13_dynamic_entities", _F13.replace("@platforms", ""))
def _(c):
    return _dynamic(c)


@query("h1_dynamic_entities_of_platform", _F13.replace("@platforms", "AND p.platform IN ('youtube', 'tiktok')"))
def _(c):
    return _dynamic(c, ["youtube", "tiktok"])


@query("h3_names_once_per_comment", f"""SELECT comment_id, count(*) AS names FROM (
    SELECT DISTINCT comment_id, lower(w) AS name FROM (SELECT comment_id, unnest({_CAPS}) AS w FROM tcomments) a) b GROUP BY comment_id""")
def _(c):
    mined = ma.mine_mentions(c.view("tcomments")).withColumn("key", F.lower("name"))
    return mined.dropDuplicates(["comment_id", "key"]).groupBy("comment_id").agg(F.count(F.lit(1)).alias("names"))


_WORDLINES = ["the of", "this", "retion", "und", "les", "thing"]


def _story_sql() -> str:
    lines = " UNION ALL ".join(f"SELECT {i} AS ord, '{w}' AS line" for i, w in enumerate(_WORDLINES))
    return f"""
  WITH said AS (SELECT comment_id, lower(text) AS t FROM tcomments
    WHERE created_at BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '{END}'),
  lines AS ({lines}),
  hits AS (SELECT ord, line, CAST(sum(len(regexp_extract_all(concat(' ', regexp_replace(t, '[^\\p{{L}}\\p{{N}}_]', '  ', 'g'), ' '), concat(' ', replace(line, ' ', '  '), ' ')))) AS BIGINT) AS n
    FROM said, lines GROUP BY ord, line HAVING sum(len(regexp_extract_all(concat(' ', regexp_replace(t, '[^\\p{{L}}\\p{{N}}_]', '  ', 'g'), ' '), concat(' ', replace(line, ' ', '  '), ' ')))) >= 3
    ORDER BY n DESC, ord LIMIT 5),
  who AS (SELECT h.line, c.name, c.entity_id, count(*) AS k FROM hits h JOIN said ON contains(t, h.line) JOIN catalog c ON contains(t, lower(c.name)) GROUP BY 1, 2, 3 HAVING count(*) >= 2),
  named AS (SELECT line, list_aggregate(list(name ORDER BY entity_id)[1:3], 'string_agg', ', ') AS entities FROM who GROUP BY line)
  SELECT array_to_string(list_transform(string_split(h.line, ' '), lambda w: concat(upper(w[1]), w[2:])), ' ') AS storyline, n AS mention_count,
    coalesce(entities, 'General') AS entities, round_even(n * 100::DOUBLE / (SELECT max(n) FROM hits), 1) AS intensity,
    CASE WHEN n > (SELECT max(n) FROM hits) * 0.8 THEN 'High' WHEN n > (SELECT max(n) FROM hits) * 0.5 THEN 'Moderate' ELSE 'Emerging' END AS trajectory,
    'trending' AS type FROM hits h LEFT JOIN named ON named.line = h.line"""


@query("f17_storylines", _story_sql())
def _(c):
    top = c.catalog().select(F.col("entity_id").alias("rank"), F.col("name").alias("entity_name"))
    return st.storylines(_text_tables(c), "2024-01-01 00:00:00", END, top, _WORDLINES)


@query("e13_storyline_entities", "SELECT storyline, entities FROM (" + _story_sql() + ") x")
def _(c):
    top = c.catalog().select(F.col("entity_id").alias("rank"), F.col("name").alias("entity_name"))
    return st.storylines(_text_tables(c), "2024-01-01 00:00:00", END, top, _WORDLINES).select("storyline", "entities")


@query("g10_engaged_comments", f"""SELECT comment_id, likes FROM tcomments WHERE likes >= 10
  AND created_at BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '{END}' ORDER BY likes DESC, comment_id LIMIT 200""")
def _(c):
    return st.engaged_comments(_text_tables(c), "2024-01-01 00:00:00", END).select("comment_id", "likes")


def _respond(frame):
    """A stand-in for an external analyser: toxicity by text length, one call in seven fails."""
    def one(text):
        n = len(text)
        return None if n % 7 == 0 else '{"toxicity": %d.5, "topics": ["n%d"]}' % (n % 2, n % 5)

    return frame["text"].map(one)


@query("k3_analysis_hook", """SELECT comment_id, CASE WHEN length(text) % 7 = 0 THEN 0::DOUBLE WHEN length(text) % 2 = 0 THEN 0.5::DOUBLE ELSE 1::DOUBLE END AS toxicity,
    CASE WHEN length(text) % 7 <> 0 THEN concat('n', CAST(length(text) % 5 AS VARCHAR)) ELSE '' END AS topics FROM tcomments""")
def _(c):
    parsed = rs.parse_responses(rs.collect_responses(c.view("tcomments"), _respond, "text"))
    return parsed.select("comment_id", "analysis.toxicity", F.array_join("analysis.topics", "|").alias("topics"))


@query("k1_pandas_scorer", """SELECT comment_id, CAST(length(text) % 5 - 2 AS DOUBLE) / 2 AS score, 0.75::DOUBLE AS confidence, 'batch' AS source_model FROM tcomments""")
def _(c):
    @F.pandas_udf("score double, confidence double, source_model string")
    def batch(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"score": (text.str.len() % 5 - 2) / 2.0, "confidence": 0.75, "source_model": "batch"})

    sc.register_column_scorer("batch", batch)
    return sc.score_texts(c.view("tcomments"), scorer="batch").select("comment_id", "sentiment.*")
