import json

from pyspark.sql import functions as F

from hearsay.operators import enrich as en
from hearsay.operators import responses as rs
from hearsay.operators import scoring as sc
from hearsay.schemas import ANALYSIS


def score(spark, *texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "comment_id int, text string")
    got = sc.rule_scores(df, **options).orderBy("comment_id").select("sentiment.score", "sentiment.confidence").collect()
    return [tuple(r) for r in got]


def test_lexicon(spark):
    good, bad, inside, nothing, missing = score(
        spark, "I love this! Amazing! 😍", "This is cringe. Total flop 👎", "I hate this", "", None
    )
    assert good == (1.0, 0.8) and bad == (-1.0, 0.8)
    # "ate" is found inside "hate": one hit on each side.
    assert inside == (0.0, 0.7)
    assert nothing == missing == (0.0, 0.3)


def test_whole_words_on_request(spark):
    assert score(spark, "I hate this mess", match="token") == [(-1.0, 0.7)]


def test_word_polarity_fallback(spark):
    words = spark.createDataFrame([("fine", 0.5, 0.5), ("dull", -0.25, 1.0)], "word string, polarity double, subjectivity double")
    assert score(spark, "Fine fine dull day", "fire love", words=words) == [(0.25, 0.3 + 2 / 3 * 0.4), (1.0, 0.7)]


def test_routing(spark):
    df = spark.createDataFrame([(1, "love love amazing great"), (2, "meh")], "comment_id int, text string")
    sc.register_column_scorer("fixed", lambda t: F.struct(F.lit(0.9).alias("score"), F.lit(0.95).alias("confidence"), F.lit("fixed").alias("source_model")))
    got = {r.comment_id: r.sentiment.source_model for r in sc.hybrid_scores(df, expensive="fixed").collect()}
    assert got == {1: "rule_based", 2: "fixed"}


def test_routing_scans_once_and_masks_sure_rows(spark):
    df = spark.createDataFrame([(1, "love love amazing great"), (2, "meh"), (3, None)], "comment_id int, text string")
    sc.register_column_scorer("seen", lambda t: F.struct(F.lit(0.9).alias("score"), F.lit(0.95).alias("confidence"), F.coalesce(t, F.lit("nothing")).alias("source_model")))
    found = sc.hybrid_scores(df, expensive="seen")
    assert {r.comment_id: r.sentiment.source_model for r in found.collect()} == {1: "rule_based", 2: "meh", 3: ""}
    text = found._jdf.queryExecution().executedPlan().toString()
    assert text.count("Scan ") == 1 and "Union" not in text


def test_lexicon_with_cased_signs(spark):
    df = spark.createDataFrame([(1, "GOOD :D 😍"), (2, "good :d"), (3, None)], "id int, text string")
    found = sc.lexicon_hits(df, F.col("text"), {"p": (["good", "goo"], [":D", "😍"]), "n": (["d"], [])}).collect()
    assert [(r.id, r.p, r.n) for r in found] == [(1, 4, 1), (2, 2, 1), (3, 0, 0)]


FULL = {
    "entity_scores": {"Taylor Swift (the singer)": "0.5", "Bad": 3, "No": "x"},
    "entity_confidence": {"Taylor Swift": 0.6},
    "emotion": "JOY", "stance": "unsure", "topics": ["tour", "", "album"], "other_entities": ["Jane Doe"],
    "sarcasm": True, "toxicity": 1.4,
    "ambiguous_mentions": [{"name": "Ryan", "possible_entities": ["A", "B"]}, "odd"],
}


def parse(spark, *raws):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "comment_id int, raw_json string")
    return [(r.recovered, r.analysis) for r in rs.parse_responses(df).orderBy("comment_id").collect()]


def test_complete_response(spark):
    (recovered, a), = parse(spark, json.dumps(FULL))
    assert not recovered
    assert a.entity_scores == {"Taylor Swift": 0.5}
    assert a.entity_confidence == {"Taylor Swift": 0.6, "Bad": 0.8, "No": 0.8}
    assert (a.emotion, a.stance, a.topics, a.other_entities) == ("joy", "neutral", ["tour", "album"], ["Jane Doe"])
    assert a.sarcasm is True and a.toxicity == 1.0
    (item,) = a.ambiguous_mentions
    assert (item.name, item.confidence, item.reason) == ("Ryan", 0.5, "Low confidence")


def test_cut_response_keeps_what_it_shows(spark):
    raw = '{"entity_scores": {"A B": -0.25, "C": 2}, "emotion": "anger", "topics": ["x", "y"], "toxicity": 0.7, "stance": "supp'
    (recovered, a), = parse(spark, raw)
    assert recovered
    assert a.entity_scores == {"A B": -0.25} and a.entity_confidence == {"A B": 0.8, "C": 0.8}
    assert (a.emotion, a.stance, a.topics, a.toxicity, a.sarcasm) == ("anger", "neutral", ["x", "y"], 0.7, False)


def test_failed_and_mistyped_responses_are_neutral(spark):
    for _, a in parse(spark, None, "", "null", "[1]", '{"entity_scores": "none", "topics": 3, "toxicity": "high", "sarcasm": 0}'):
        assert (a.entity_scores, a.emotion, a.stance, a.topics, a.toxicity, a.sarcasm) == ({}, "neutral", "neutral", [], 0.0, False)


def analysed(spark, analysis, likes=500, mentions=()):
    from pyspark.sql import types as T

    mention = T.StructType([T.StructField("entity_id", T.StringType())])
    schema = T.StructType([
        T.StructField("comment_id", T.StringType()), T.StructField("likes", T.LongType()), T.StructField("text", T.StringType()),
        T.StructField("caption", T.StringType()), T.StructField("created_at", T.TimestampType()),
        T.StructField("mentions", T.ArrayType(mention)), T.StructField("analysis", ANALYSIS)])
    base = {"entity_scores": {}, "entity_confidence": {}, "emotion": "neutral", "stance": "neutral", "topics": [], "other_entities": [], "sarcasm": False, "toxicity": 0.0, "ambiguous_mentions": []}
    return spark.createDataFrame([("c1", likes, "text", None, None, [(m,) for m in mentions], {**base, **analysis})], schema)


def run(spark):
    return F.timestamp_seconds(F.lit(0))


def test_fanout(spark, rows, catalog):
    frame = analysed(spark, {"entity_scores": {"Tay": 0.8, "tay zonday": 0.4, "Nobody Known": 0.1, "OMG": 0.9}, "topics": ["tour", "tour", "b"], "sarcasm": True, "toxicity": 0.75}, mentions=["e1", "e2"])
    signals = en.response_signals(frame, catalog, run(spark), "m")
    assert rows(signals.select("weight_score").distinct()) == [(6.0,)]
    got = rows(signals, "signal_type", "entity_id", "value", "confidence")
    sentiment = [r for r in got if r[0] == "sentiment"]
    # Both spellings name one entity: one signal remains.
    assert len(sentiment) == 1 and sentiment[0][1] == "e4"
    assert [r for r in got if r[0] != "sentiment"] == [
        ("emotion", "e1", "neutral", 0.8), ("emotion", "e2", "neutral", 0.8), ("sarcasm", None, "sarcasm", 0.7),
        ("topic", None, "b", 0.7), ("topic", None, "tour", 0.7), ("toxicity", None, "high", 0.8)]


def test_stance_fallback_and_comment_emotion(spark, rows, catalog):
    with_mention = en.response_signals(analysed(spark, {"stance": "oppose"}, mentions=["e1"]), catalog, run(spark), "m")
    assert ("sentiment", "e1", "Negative", -0.5) in rows(with_mention, "signal_type", "entity_id", "value", "numeric_value")
    alone = en.response_signals(analysed(spark, {"stance": "oppose", "emotion": "joy"}), catalog, run(spark), "m")
    assert rows(alone, "signal_type", "entity_id", "value") == [("emotion", None, "joy"), ("toxicity", None, "low")]


def test_low_confidence_goes_to_review(spark, rows, catalog):
    frame = analysed(spark, {"entity_scores": {"Tay": 0.8}, "entity_confidence": {"Tay": 0.65}, "ambiguous_mentions": [("Ryan", ["e2", "e3"], 0.4, "two")]})
    assert not [r for r in rows(en.response_signals(frame, catalog, run(spark), "m"), "signal_type") if r[0] == "sentiment"]
    assert rows(en.review_items(frame, run(spark)), "entity_mention", "reason") == [
        ("Ryan", "two"), ("Tay", "Low confidence (0.65) for entity assignment")]


def test_discovered_once_per_comment(spark, rows, catalog):
    frame = analysed(spark, {"entity_scores": {"jane doe": 0.1, "Tay": 0.2}, "other_entities": ["Jane Doe", "JANE DOE", "T-Swift", "photo"]})
    assert rows(en.discovered_from_responses(frame, catalog), "name") == [("Jane Doe",), ("T-Swift",)]


def test_rule_signals(spark, rows, catalog):
    comments = spark.createDataFrame([("c1", "p", "love amazing taylor swift and ryan reynolds", 100)], "comment_id string, post_id string, text string, likes long")
    got = rows(en.rule_signals(comments, catalog, None, run(spark)), "entity_id", "value", "numeric_value", "confidence", "weight_score")
    assert (None, "Strongly Positive", 1.0, 0.7, 2.0) in got and ("e1", "Strongly Positive", 1.0, 0.7, 2.0) in got
    assert {r[0] for r in got} == {None, "e1", "e2", "e4"}


def test_names_are_resolved_inside_the_row(spark, rows, catalog):
    """The later of two spellings wins, unknown and missing names stay out, and nothing is shuffled."""
    frame = analysed(spark, {"ambiguous_mentions": [("Ryan", ["e2"], 0.4, "one"), ("Ryan", ["e3"], 0.3, "two")]})
    # Built as a map column: a Python dict does not reach Spark in its order.
    scores = F.map_from_arrays(F.array(*map(F.lit, ["T-Swift", "taylor swift", "Nobody Known"])), F.array(*map(F.lit, [0.8, 0.4, 0.2])))
    frame = frame.withColumn("analysis", F.col("analysis").withField("entity_scores", scores))
    frame = frame.unionByName(analysed(spark, {}).withColumn("analysis", F.lit(None).cast(ANALYSIS)))
    signals = en.response_signals(frame, catalog, run(spark), "m", "created_at")
    assert [r[1:] for r in rows(signals, "signal_type", "entity_id", "numeric_value") if r[0] == "sentiment"] == [("e1", 0.4)]
    items = en.review_items(frame, run(spark))
    assert rows(items, "entity_mention", "reason") == [("Ryan", "two")]
    for df in (signals, items, en.discovered_from_responses(frame, catalog)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_names_in_texts_outside_the_catalog(spark, rows):
    mentions = "array<struct<entity_id:string,mention_text:string,confidence:double>>"
    frame = spark.sql(f"""SELECT 'c1' AS comment_id, current_timestamp() AS created_at, "Jane Doe met Ann Lee and Jane Doe" AS text,
      from_json('[{{"mention_text": "ann lee"}}]', '{mentions}') AS mentions
      UNION ALL SELECT 'c2', NULL, NULL, CAST(array() AS {mentions})""")
    assert rows(en.discovered_in_texts(frame), "comment_id", "name") == [("c1", "Jane Doe")]
