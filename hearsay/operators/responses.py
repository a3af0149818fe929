"""Parsing and validating multi-signal JSON responses, one per comment."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay import fixed_values as fv
from hearsay.functions.text import strip_hint
from hearsay.sizing import let

_PAIRS = "array<struct<name:string,score:double>>"
_NAMES = "array<string>"
_AMBIGUOUS = "array<struct<name:string,possible_entities:array<string>,confidence:double,reason:string>>"


def _document(raw: Column) -> Column:
    """The parsed response, or NULL when it is not a complete JSON object or list.

    A cut response seldom ends in a closing bracket; testing that first saves
    the cost of a failing parse.
    """
    return F.when(raw.rlike(r"[}\]]\s*$"), F.try_parse_json(raw))


def _pairs(value: Column) -> Column:
    """Name/number pairs of a JSON object; not an object gives NULL."""
    return F.transform(
        F.map_entries(value),
        lambda e: F.struct(
            e["key"].alias("name"), F.try_variant_get(e["value"], "$", "double").alias("score")
        ),
    )


def _truthy(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    return F.coalesce(
        F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(kind == "STRING", text != "")
        .when(kind == "VOID", F.lit(False))
        .when(kind.rlike("^(ARRAY<VOID>|OBJECT<>)$"), F.lit(False))
        .when(kind.rlike("^(ARRAY|OBJECT)"), F.lit(True))
        .otherwise(F.try_variant_get(value, "$", "double") != 0),
        F.lit(False),
    )


def _parsed(doc: Column) -> Column:
    """Fields of a complete response; absent or mistyped fields are NULL."""

    def field(path: str, kind: str) -> Column:
        return F.try_variant_get(doc, f"$.{path}", kind)

    ambiguous = F.transform(
        F.filter(
            field("ambiguous_mentions", "array<variant>"),
            lambda x: F.schema_of_variant(x).startswith("OBJECT"),
        ),
        lambda x: F.struct(
            F.coalesce(F.try_variant_get(x, "$.name", "string"), F.lit("")).alias("name"),
            F.coalesce(F.try_variant_get(x, "$.possible_entities", _NAMES), F.array().cast(_NAMES)).alias("possible_entities"),
            F.coalesce(F.try_variant_get(x, "$.confidence", "double"), F.lit(0.5)).alias("confidence"),
            F.coalesce(F.try_variant_get(x, "$.reason", "string"), F.lit("Low confidence")).alias("reason"),
        ),
    )
    return F.struct(
        _pairs(field("entity_scores", "map<string,variant>")).alias("scores"),
        _pairs(field("entity_confidence", "map<string,variant>")).alias("confidences"),
        field("emotion", "string").alias("emotion"),
        field("stance", "string").alias("stance"),
        field("topics", _NAMES).alias("topics"),
        field("other_entities", _NAMES).alias("other_entities"),
        _truthy(field("sarcasm", "variant")).alias("sarcasm"),
        field("toxicity", "double").alias("toxicity"),
        ambiguous.alias("ambiguous_mentions"),
    )


def _recovered(raw: Column) -> Column:
    """Whatever a truncated response still shows, read by pattern.

    Closing open strings and brackets first would add nothing: a response cut
    inside an object stays unreadable without the braces that follow.
    """

    def inside(key: str, opening: str, closing: str) -> Column:
        return F.regexp_extract(raw, rf'"{key}"\s*:\s*\{opening}([^\{closing}]*)\{closing}', 1)

    def word(key: str) -> Column:
        return F.nullif(F.regexp_extract(raw, rf'"{key}"\s*:\s*"([^"]+)"', 1), F.lit(""))

    def quoted(key: str) -> Column:
        return F.regexp_extract_all(inside(key, "[", "]"), F.lit(r'"([^"]+)"'), F.lit(1))

    pair = r'"([^"]+)"\s*:\s*(-?\d+\.?\d*)'
    listed = inside("entity_scores", "{", "}")
    names = F.regexp_extract_all(listed, F.lit(pair), F.lit(1))
    numbers = F.regexp_extract_all(listed, F.lit(pair), F.lit(2))
    scores = F.zip_with(
        names, numbers, lambda n, s: F.struct(n.alias("name"), s.try_cast("double").alias("score"))
    )
    return F.struct(
        scores.alias("scores"),
        F.array().cast(_PAIRS).alias("confidences"),
        word("emotion").alias("emotion"),
        word("stance").alias("stance"),
        quoted("topics").alias("topics"),
        quoted("other_entities").alias("other_entities"),
        (F.lower(F.regexp_extract(raw, r'(?i)"sarcasm"\s*:\s*(true|false)', 1)) == "true").alias("sarcasm"),
        F.regexp_extract(raw, r'"toxicity"\s*:\s*(\d+\.?\d*)', 1).try_cast("double").alias("toxicity"),
        F.array().cast(_AMBIGUOUS).alias("ambiguous_mentions"),
    )


def _last_by_name(pairs: Column) -> Column:
    """Pairs as a map; of equal names the last one counts."""
    names = F.array_distinct(F.transform(pairs, lambda p: p["name"]))
    return F.map_from_arrays(
        names,
        F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda p: p["name"] == n), -1)["score"]),
    )


def _clean_pairs(pairs: Column, low: float, high: float) -> Column:
    """Drop scores that are no number or out of range, and strip name hints."""
    kept = F.filter(pairs, lambda p: (p["score"] >= low) & (p["score"] <= high))
    return F.transform(kept, lambda p: F.struct(strip_hint(p["name"]).alias("name"), p["score"].alias("score")))


def _one_of(value: Column, allowed: list[str], default: str) -> Column:
    low = F.lower(value)
    return F.when(low.isin(allowed), low).otherwise(F.lit(default))


def _non_empty(names: Column) -> Column:
    return F.filter(F.coalesce(names, F.array().cast(_NAMES)), lambda n: n.isNotNull() & (n != ""))


def validated(parts: Column) -> Column:
    """The validated analysis: bounded numbers, known labels, explicit defaults."""
    none = F.array().cast(_PAIRS)
    raw_scores = F.coalesce(parts["scores"], none)
    given = _clean_pairs(F.coalesce(parts["confidences"], none), 0.0, 1.0)
    assumed = F.transform(
        raw_scores,
        lambda p: F.struct(
            strip_hint(p["name"]).alias("name"), F.lit(fv.DEFAULT_ENTITY_CONFIDENCE).alias("score")
        ),
    )
    return F.struct(
        _last_by_name(_clean_pairs(raw_scores, -1.0, 1.0)).alias("entity_scores"),
        _last_by_name(F.concat(assumed, given)).alias("entity_confidence"),
        _one_of(parts["emotion"], fv.EMOTIONS, "neutral").alias("emotion"),
        _one_of(parts["stance"], fv.STANCES, "neutral").alias("stance"),
        _non_empty(parts["topics"]).alias("topics"),
        _non_empty(parts["other_entities"]).alias("other_entities"),
        F.coalesce(parts["sarcasm"], F.lit(False)).alias("sarcasm"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(parts["toxicity"], F.lit(0.0)))).alias("toxicity"),
        F.coalesce(parts["ambiguous_mentions"], F.array().cast(_AMBIGUOUS)).alias("ambiguous_mentions"),
    )


def collect_responses(
    comments: DataFrame, respond: Callable[[pd.DataFrame], pd.Series], *columns: str
) -> DataFrame:
    """Responses of a caller's analyser, as the table ``(comment_id, raw_json)``.

    ``respond`` gets Arrow batches of ``comment_id`` and ``columns`` and returns
    one JSON text per row; a failed call may return None. It runs in every task.
    """
    kept = comments.select("comment_id", *columns)
    id_type = kept.schema["comment_id"].dataType.simpleString()

    def batches(frames):
        for frame in frames:
            yield pd.DataFrame({"comment_id": frame["comment_id"], "raw_json": respond(frame)})

    return kept.mapInPandas(batches, f"comment_id {id_type}, raw_json string")


def parse_responses(responses: DataFrame, raw: str = "raw_json") -> DataFrame:
    """``responses`` with ``raw`` replaced by ``recovered`` and ``analysis``.

    A missing response (a failed call) gives the all-neutral analysis.
    """
    keys = [c for c in responses.columns if c != raw]
    text = F.coalesce(F.col(raw), F.lit("{}"))
    # Bind the text, the parsed document and its parts once each: every response
    # is parsed a single time however many fields are read from it.
    staged = responses.withColumn("_r", let(
        F.struct(text.alias("raw"), _document(text).alias("doc")),
        lambda r: let(
            F.struct(
                r["doc"].isNull().alias("recovered"),
                F.when(r["doc"].isNotNull(), _parsed(r["doc"])).otherwise(_recovered(r["raw"])).alias("parts"),
            ),
            lambda x: F.struct(x["recovered"].alias("recovered"), validated(x["parts"]).alias("analysis")),
        ),
    ))
    return staged.select(*keys, "_r.recovered", "_r.analysis")
