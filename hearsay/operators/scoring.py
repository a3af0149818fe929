"""Sentiment scorers: each adds a ``sentiment`` struct to a DataFrame of texts.

The struct holds ``score`` in [-1, 1], ``confidence`` and ``source_model``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay import fixed_values as fv
from hearsay.operators.textsearch import term_numbers
from hearsay.sizing import unnest

Scorer = Callable[[DataFrame, str], DataFrame]
_SCORERS: dict[str, Scorer] = {}


def register_scorer(name: str, scorer: Scorer) -> None:
    """Make a scorer available by name.

    A scorer maps (DataFrame, text column) to the DataFrame plus ``sentiment``.
    """
    _SCORERS[name] = scorer


def register_column_scorer(name: str, score: Callable[[Column], Column]) -> None:
    """Register a Column expression or pandas UDF that returns the struct."""
    register_scorer(name, lambda df, text: df.withColumn("sentiment", score(F.col(text))))


def score_texts(df: DataFrame, text: str = "text", scorer: str = fv.RULE_MODEL) -> DataFrame:
    """Score with the named scorer; an unknown name falls back to the rules."""
    return _SCORERS.get(scorer, _SCORERS[fv.RULE_MODEL])(df, text)


# ------------------------------------------------------------------ lexicon


def caseless(terms: list[str]) -> bool:
    """Whether lower-casing a text neither hides nor makes an occurrence of these terms."""
    return all(t == t.lower() == t.upper() for t in terms)


def term_counts(df: DataFrame, text: Column, groups: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """``df`` with a count for each group: its different words (ignoring case) and emojis in the text, as substrings.

    One walk over each text finds the terms of all groups; emojis that have a
    case are looked for in a walk over the text as it stands.
    """
    folded, given = set(), set()
    for words, emojis in groups.values():
        folded.update(words)
        (folded if caseless(emojis) else given).update(emojis)
    found = df
    numbers = {}
    for name, body, terms in (("_folded", F.lower(text), sorted(folded)), ("_given", text, sorted(given))):
        numbers[name] = {t: k for k, t in enumerate(terms)}
        found = found.withColumn(name, term_numbers(df, body, terms))

    def among(name: str, terms: list[str]) -> Column:
        own = sorted(numbers[name][t] for t in set(terms))
        return F.size(F.array_intersect(name, F.array(*[F.lit(k) for k in own]))) if own else F.lit(0)

    counts = {}
    for group, (words, emojis) in groups.items():
        shared = caseless(emojis)
        both = among("_folded", [*words, *emojis]) if shared and not set(words) & set(emojis) else among("_folded", words) + among("_folded" if shared else "_given", emojis)
        counts[group] = both
    return found.withColumns(counts).drop("_folded", "_given")


def count_tokens(text: Column, terms: list[str]) -> Column:
    """How many different terms occur in the text as whole words."""
    words = F.regexp_extract_all(text, F.lit(fv.TOKEN_PATTERN), F.lit(0))
    return F.size(F.array_intersect(words, F.array(*[F.lit(t) for t in terms])))


def token_hits(text: Column, words: list[str], emojis: list[str]) -> Column:
    """Different lexicon words that are tokens of a text, and emojis anywhere in it."""
    hits = count_tokens(F.lower(text), words)
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(e)).cast("int") for e in emojis], hits)


def lexicon_hits(df: DataFrame, text: Column, groups: dict[str, tuple[list[str], list[str]]], match: str = "substring") -> DataFrame:
    """``df`` with a count for each group of (words, emojis).

    ``substring`` also counts words inside other words; ``token`` does not.
    """
    if match == "substring":
        return term_counts(df, text, groups)
    return df.withColumns({name: token_hits(text, words, emojis) for name, (words, emojis) in groups.items()})


def lexicon_score(positive: Column, negative: Column) -> Column:
    return F.try_divide((positive - negative).cast("double"), positive + negative)


def lexicon_confidence(positive: Column, negative: Column) -> Column:
    return F.least(F.lit(0.8), F.lit(0.5) + (positive + negative) * F.lit(0.1))


def word_polarity(df: DataFrame, key: str, text: str, words: DataFrame) -> DataFrame:
    """Mean polarity and subjectivity of the known words of each text.

    ``words`` is the caller's table ``(word, polarity, subjectivity)``. The
    tokens of a text sit in one task, so each task sends one row per text on.
    """
    found = F.regexp_extract_all(F.lower(text), F.lit(fv.TOKEN_PATTERN), F.lit(0))
    tokens = unnest(df, [key], found, "word")
    return tokens.join(words, "word").groupBy(key).agg(
        F.avg("polarity").alias("polarity"), F.avg("subjectivity").alias("subjectivity")
    )


def rule_scores(
    df: DataFrame,
    text: str = "text",
    match: str = "substring",
    words: DataFrame | None = None,
    key: str = "comment_id",
    lexicon: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Lexicon score where two or more terms hit, word polarity elsewhere.

    Without a word table the fallback is neutral with the lowest confidence and
    the whole scorer is one pass over the texts, without a join.
    """
    lex = lexicon or {
        "positive": fv.POSITIVE_WORDS, "negative": fv.NEGATIVE_WORDS,
        "positive_emojis": fv.POSITIVE_EMOJIS, "negative_emojis": fv.NEGATIVE_EMOJIS,
    }
    body = F.coalesce(F.col(text), F.lit(""))
    groups = {"_pos": (lex["positive"], lex.get("positive_emojis", [])), "_neg": (lex["negative"], lex.get("negative_emojis", []))}
    scored = lexicon_hits(df, body, groups, match)
    pos, neg = F.col("_pos"), F.col("_neg")
    enough = pos + neg >= fv.MIN_LEXICON_HITS
    polarity, subjectivity = F.lit(0.0), F.lit(0.0)
    if words is not None:
        unsure = scored.filter(~enough).select(key, text)
        scored = scored.join(word_polarity(unsure, key, text, words), key, "left")
        polarity = F.coalesce("polarity", F.lit(0.0))
        subjectivity = F.coalesce("subjectivity", F.lit(0.0))
    sentiment = F.struct(
        F.when(enough, lexicon_score(pos, neg)).otherwise(polarity).alias("score"),
        F.when(enough, lexicon_confidence(pos, neg))
        .otherwise(F.lit(0.3) + subjectivity * F.lit(0.4)).alias("confidence"),
        F.lit(fv.RULE_MODEL).alias("source_model"),
    )
    return scored.withColumn("sentiment", sentiment).drop("_pos", "_neg", "polarity", "subjectivity")


def needs_escalation(sentiment: str = "sentiment") -> Column:
    """Low confidence, or a score too close to neutral to trust."""
    return (F.col(f"{sentiment}.confidence") < fv.ESCALATE_BELOW_CONFIDENCE) | (
        F.abs(F.col(f"{sentiment}.score")) < fv.ESCALATE_BELOW_STRENGTH
    )


def hybrid_scores(
    df: DataFrame, text: str = "text", cheap: str = fv.RULE_MODEL, expensive: str = fv.RULE_MODEL
) -> DataFrame:
    """Keep confident cheap scores; the other scorer only gets the texts of the rest.

    One scan: the costly scorer reads a column that is NULL in sure rows, so it has
    nothing to do for them, and the row itself says which score counts. The same
    scorer twice is one score. A costly scorer must take NULL texts.
    """
    first = score_texts(df, text, cheap)
    if cheap == expensive:
        return first
    masked = first.withColumnsRenamed({"sentiment": "_cheap"}).withColumn("_unsure", F.when(needs_escalation("_cheap"), F.coalesce(F.col(text), F.lit(""))))
    both = score_texts(masked, "_unsure", expensive)
    return both.withColumn("sentiment", F.when(F.col("_unsure").isNull(), F.col("_cheap")).otherwise(F.col("sentiment"))).drop("_cheap", "_unsure")


register_scorer(fv.RULE_MODEL, rule_scores)
register_scorer("hybrid", hybrid_scores)
