from pyspark.sql import functions as F

from hearsay.functions import labels, numbers, sentences, text


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_post_ids(spark):
    urls = [
        ("https://www.instagram.com/p/DRSmMhODnJ2/", "DRSmMhODnJ2"),
        ("https://instagram.com/p/ABC123", "ABC123"),
        ("/p/XYZ789/", "XYZ789"),
        ("https://instagram.com/p/ABC?igsh=1", "ABC"),
        ("https://example.com/reel/R1/", "R1"),
    ]
    df = spark.createDataFrame(urls, "url string, want string")
    got = df.select(text.post_id_from_url(F.col("url")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)
    assert one(spark, text.post_id_from_last_segment(F.lit("https://x.com/ABC/p/"))) == ("ABC",)


def test_human_counts(spark):
    values = [("46k", 46000, 46000), ("1.2m", 1200000, 1200000), ("12", 12, 12), ("12.7", 12, None), ("junk", 0, None), ("", 0, None), (None, 0, None)]
    df = spark.createDataFrame(values, "t string, lenient long, strict long")
    for r in df.select("*", numbers.human_count(F.col("t")).alias("a"), numbers.human_count(F.col("t"), True).alias("b")).collect():
        assert (r.a, r.b) == (r.lenient, r.strict), r


def test_timestamps(spark):
    values = [("1732599802", True), ("2025-11-26T05:43:22Z", True), ("2025-11-26 05:43:22", True), ("soon", False), ("", False), ("99999999999999999999", False)]
    df = spark.createDataFrame(values, "t string, ok boolean")
    got = df.select("ok", numbers.parse_timestamp(F.col("t")).isNotNull().alias("g")).collect()
    assert all(r.ok == r.g for r in got)


def test_label_boundaries(spark):
    expected = {0.7: "Strongly Positive", 0.3: "Positive", -0.29: "Neutral", -0.3: "Negative", -0.7: "Strongly Negative"}
    strict = {0.7: "Positive", 0.3: "Neutral", 0.71: "Strongly Positive"}
    for value, want in expected.items():
        assert one(spark, labels.sentiment_label(F.lit(value))) == (want,)
    for value, want in strict.items():
        assert one(spark, labels.sentiment_label(F.lit(value), strict=True)) == (want,)


def test_changes(spark):
    assert one(spark, numbers.percent_change(F.lit(0.0), F.lit(0.4))) == (0.0,)
    assert one(spark, numbers.percent_change(F.lit(-0.5), F.lit(0.5))) == (200.0,)
    assert one(spark, numbers.percent_of(F.lit(1), F.lit(0))) == (0.0,)


def test_name_filters(spark):
    cases = [("Blake Lively", True), ("■■■", False), ("😀😀", False), ("x", False), ("the", False), ("Link in Bio", False), ("東京", False), ("Harper's Bazaar", False), ("123", False), ("People Magazine", False), ("Zendaya", True)]
    df = spark.createDataFrame(cases, "n string, keep boolean")
    assert all(r.keep == r.g for r in df.select("keep", text.is_discovered_name(F.col("n")).alias("g")).collect())
    assert one(spark, text.is_scored_name(F.lit("OMG")), text.is_scored_name(F.lit("A1234")), text.is_scored_name(F.lit("JLo"))) == (False, False, True)


def test_display_text(spark):
    assert one(spark, text.display_text(F.lit("ﬁne\u0007 ok\n"))) == ("fine ok",)


def test_rounding_in_sentences(spark):
    # Ties go to the even digit and a small negative number keeps its sign.
    assert one(spark, sentences.signed(F.lit(0.125)), sentences.signed(F.lit(-0.001)), sentences.signed(F.lit(2.0), 1)) == ("+0.12", "-0.00", "+2.0")


def test_micro_insight_keeps_two_bullets(spark):
    got = one(spark, sentences.micro_insight(F.lit(0.6), F.lit(1200), F.lit(60000), F.lit(-45.0)))[0]
    assert got == "Strong positive sentiment (+0.60) with 1,200 mentions • Sentiment declined 45.0% in past 72hrs"


def test_numbers_in_sentences_are_rounded_as_they_are_stored(spark):
    """As the reference's format strings do; only true ties go to the even digit."""
    from hearsay.functions import sentences as say

    values = [k / 1000 * sign for k in range(0, 1200, 5) for sign in (1, -1) if k or sign > 0] + [0.125, 0.375, 12345.675, 1e9 + 0.125, -2e-9]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    shown = df.select("v", say.signed(df.v), say.signed(df.v, 1), say.fixed(df.v, 2)).collect()
    assert [tuple(r) for r in shown] == [(v, f"{v:+.2f}", f"{v:+.1f}", f"{v:.2f}") for v in values]
