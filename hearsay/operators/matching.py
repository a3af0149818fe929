"""Matching comments to the catalog of monitored entities.

Tiers, best first: a name or alias inside the comment, a first name, a last
name, a pronoun. The weaker tiers lean on the entities named in the post's
caption. Each (comment, entity) pair keeps its best tier only.

Names, aliases and single tokens of a catalog of any size are found by automata in one pass
(``textsearch``), and the tiers are resolved inside the row: comments are not shuffled. Captions, where they
lend context, are joined as one short array per post.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay import fixed_values as fv
from hearsay.functions.text import strip
from hearsay.operators.textsearch import find_terms, with_terms
from hearsay.sizing import unnest


def _no_texts() -> Column:
    return F.array().cast("array<string>")



def _ordered(entities: DataFrame) -> DataFrame:
    order = F.col("load_order") if "load_order" in entities.columns else F.col("entity_id")
    aliases = F.col("aliases") if "aliases" in entities.columns else _no_texts()
    canonical = F.col("canonical_name") if "canonical_name" in entities.columns else F.lit(None).cast("string")
    return entities.select(
        "entity_id", "name", canonical.alias("canonical_name"),
        F.coalesce(aliases, _no_texts()).alias("aliases"), order.alias("load_order"),
    )


def catalog_terms(entities: DataFrame) -> DataFrame:
    """Lower-case names and aliases, each owned by one entity.

    A term claimed by several entities belongs to the last one, at the place
    where the term first appeared.
    """
    claims = _ordered(entities).select(
        "entity_id", "load_order", F.lower("name").alias("_name"),
        F.posexplode(F.concat(F.array("name"), "aliases")).alias("_pos", "_term"),
    ).withColumn("term", strip(F.lower("_term"))).filter("term <> ''")
    place = F.struct("load_order", "_pos")
    owned = claims.groupBy("term").agg(
        F.min(place).alias("ord"), F.max_by(F.struct("entity_id", "_name", "load_order"), place).alias("o")
    )
    return owned.select(
        "ord", "term", F.col("o.entity_id").alias("entity_id"),
        F.when(F.col("term") == F.col("o._name"), fv.CONFIDENCE_NAME)
        .otherwise(fv.CONFIDENCE_ALIAS).alias("confidence"),
    )


def catalog_name_parts(entities: DataFrame) -> DataFrame:
    """First and last token of each name and whether only one entity has it."""
    words = F.split(strip(F.lower("name")), r"\s+")
    parts = _ordered(entities).select(
        "entity_id",
        F.nullif(F.get(words, F.lit(0)), F.lit("")).alias("first"),
        F.when(F.size(words) > 1, F.element_at(words, -1)).alias("last"),
    )
    for part in ("first", "last"):
        only = F.count(part).over(Window.partitionBy(part)) == 1
        parts = parts.withColumn(f"{part}_unique", only)
    return parts


def alias_table(entities: DataFrame) -> DataFrame:
    """Every lower-case spelling of an entity; later spellings win a clash."""
    spellings = F.concat(F.array("name", "canonical_name"), "aliases")
    listed = _ordered(entities).select(
        "entity_id", "load_order", F.posexplode(spellings).alias("_pos", "_alias")
    ).filter("_alias is not null")
    return listed.groupBy(F.lower("_alias").alias("alias")).agg(
        F.max_by("entity_id", F.struct("load_order", "_pos")).alias("entity_id")
    )


def resolve_names(df: DataFrame, name: str, entities: DataFrame, how: str = "left") -> DataFrame:
    """Attach ``resolved_entity_id`` by name, canonical name or alias."""
    aliases = alias_table(entities).withColumnRenamed("entity_id", "resolved_entity_id")
    keyed = df.withColumn("_key", strip(F.lower(name)))
    return keyed.join(aliases, keyed["_key"] == aliases["alias"], how).drop("_key", "alias")


def resolved_ids(df: DataFrame, names: Column, entities: DataFrame) -> Column:
    """Beside every name of an array the id of its entity, by any spelling; NULL for unknown names.

    As ``resolve_names``, inside the row: the spellings of the catalog are broadcast, rows are neither
    exploded nor moved. ``df`` only names the session. A NULL array has no ids.
    """
    table = alias_table(entities).orderBy("alias").toArrow().combine_chunks()
    spellings, owners = (
        pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in (table.column("alias"), table.column("entity_id"))
    )
    payload = df.sparkSession.sparkContext.broadcast((spellings, owners))

    @F.arrow_udf(f"array<{entities.schema['entity_id'].dataType.simpleString()}>")
    def ids(lists: pa.Array) -> pa.Array:
        spellings, owners = payload.value
        asked = lists.flatten()
        found = owners.take(pc.index_in(asked, value_set=spellings.cast(asked.type)))
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), found)

    return ids(F.transform(names, lambda n: strip(F.lower(n))))


def caption_context(entities: DataFrame, posts: DataFrame, caption: str = "caption") -> DataFrame:
    """(post_id, entity_id) for every entity named in a post's caption."""
    terms = _ordered(entities).select(
        "entity_id", F.posexplode(F.concat(F.array("name"), "aliases")).alias("_pos", "_term"), "load_order"
    ).select(
        F.struct("load_order", "_pos").alias("ord"), strip(F.lower("_term")).alias("term"), "entity_id"
    ).filter("term <> ''")
    return find_terms(posts.select("post_id", caption), caption, terms).select("post_id", "entity_id").distinct()


def context_arrays(entities: DataFrame, posts: DataFrame, caption: str = "caption") -> DataFrame:
    """Per post, the array of entities named in its caption."""
    found = caption_context(entities, posts, caption)
    return found.groupBy("post_id").agg(F.sort_array(F.collect_list("entity_id")).alias("context"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(fv.TOKEN_PATTERN), F.lit(0))


def _pronouns() -> Column:
    return F.array(*[F.lit(p) for p in fv.PRONOUNS])


def _token_owners(entities: DataFrame) -> DataFrame:
    """Rows (ord, term, tier, entity_id, unique): first names as tier 1, last names as tier 2; a token stands between zero bytes."""
    parts = catalog_name_parts(entities)
    sides = [
        parts.select(F.lit(tier).alias("tier"), F.col(part).alias("word"), "entity_id", F.col(f"{part}_unique").alias("unique"))
        for tier, part in ((1, "first"), (2, "last"))
    ]
    # A name whose part is no token of the pattern is never a token of a text.
    return sides[0].union(sides[1]).filter("word IS NOT NULL").select(
        F.struct("tier", "entity_id").alias("ord"), F.concat(F.lit("\0"), "word", F.lit("\0")).alias("term"), "tier", "entity_id", "unique", "word"
    )


def mention_arrays(
    comments: DataFrame, entities: DataFrame, posts: DataFrame | None = None, text: str = "text"
) -> DataFrame:
    """``comments`` plus ``mentions``: an array of matched entities per comment, by ``entity_id``.

    With ``posts``, captions lend context: it is computed once per post and joined
    as a short array.
    """
    df = comments
    id_type = entities.schema["entity_id"].dataType.simpleString()
    no_ids = F.array().cast(f"array<{id_type}>")
    context = no_ids
    if posts is not None:
        df = df.join(context_arrays(entities, posts), "post_id", "left")
        context = F.coalesce("context", no_ids)
    body = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({"_context": context, "_words": F.array_distinct(tokens(body))})
    df = with_terms(df, F.lower(body), catalog_terms(entities), "_named")
    zero = F.lit("\0")
    df = with_terms(df, F.concat(zero, F.array_join("_words", "\0"), zero), _token_owners(entities), "_parts")

    place = df.schema["_named"].dataType.elementType["ord"].dataType
    no_place = F.lit(None).cast(place)

    def candidate(entity: Column, tier: Column, ord_: Column, mention: Column, confidence: Column) -> Column:
        return F.struct(
            entity.alias("entity_id"), tier.alias("tier"), ord_.alias("ord"), mention.alias("mention_text"), confidence.alias("confidence")
        )

    def weight(part: Column) -> Column:
        near = F.array_contains("_context", part["entity_id"])
        return (
            F.when(near & (part["tier"] == 1), fv.CONFIDENCE_FIRST_IN_CONTEXT)
            .when(near, fv.CONFIDENCE_LAST_IN_CONTEXT)
            .when(part["tier"] == 1, fv.CONFIDENCE_FIRST_UNIQUE)
            .otherwise(fv.CONFIDENCE_LAST_UNIQUE)
        )

    named = F.transform("_named", lambda x: candidate(x["entity_id"], F.lit(0), x["ord"], x["term"], x["confidence"]))
    trusted = F.filter("_parts", lambda x: x["unique"] | F.array_contains("_context", x["entity_id"]))
    partial = F.transform(trusted, lambda x: candidate(x["entity_id"], x["tier"], no_place, x["word"], weight(x)))
    spoken = F.when(F.arrays_overlap("_words", _pronouns()), F.col("_context")).otherwise(no_ids)
    pronoun = F.transform(spoken, lambda e: candidate(e, F.lit(3), no_place, F.lit("pronoun"), F.lit(fv.CONFIDENCE_PRONOUN)))
    # The best candidate of an entity comes first of it.
    df = df.withColumn("_best", F.array_sort(F.concat(named, partial, pronoun)))
    first = F.filter("_best", lambda x, i: (i == 0) | (F.get("_best", i - 1)["entity_id"] != x["entity_id"]))
    kept = F.transform(first, lambda x: F.struct(x["entity_id"].alias("entity_id"), x["mention_text"].alias("mention_text"), x["confidence"].alias("confidence")))
    return df.select(*comments.columns, kept.alias("mentions"))


def catalog_mentions(comments: DataFrame, entities: DataFrame, posts: DataFrame | None = None, text: str = "text") -> DataFrame:
    """One row (comment_id, entity_id, mention_text, confidence) per matched pair."""
    kept = ["comment_id", text] + (["post_id"] if posts is not None else [])
    found = mention_arrays(comments.select(*kept), entities, posts, text)
    return unnest(found, ["comment_id"], F.col("mentions"), "m").select("comment_id", "m.*")


def full_name_mentions(comments: DataFrame, entities: DataFrame, text: str = "text") -> DataFrame:
    """Name and alias matches only, one row per (comment, entity): the first term in catalog order."""
    found = with_terms(comments.select("comment_id", text), F.lower(text), catalog_terms(entities), "_named")
    first = F.filter("_named", lambda x, i: F.array_position(F.transform("_named", lambda y: y["entity_id"]), x["entity_id"]) == i + 1)
    return unnest(found, ["comment_id"], first, "m").select(
        "comment_id", "m.entity_id", F.col("m.term").alias("mention_text"), "m.confidence"
    )


# ------------------------------------------------------------- discovery


def capitalised_names(text: Column, min_words: int = 2) -> Column:
    """Candidate names: runs of capitalised words."""
    more = min_words - 1
    pattern = rf"\p{{Lu}}[\p{{L}}'’-]+(?:[ ]\p{{Lu}}[\p{{L}}'’-]+){{{more},}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def mine_mentions(comments: DataFrame, text: str = "text", entity_type: str = "PERSON") -> DataFrame:
    """Built-in annotator: (comment_id, name, entity_type, confidence) per candidate."""
    return unnest(comments, ["comment_id"], capitalised_names(F.col(text)), "name").select("comment_id", "name", F.lit(entity_type).alias("entity_type"),
             F.lit(fv.CONFIDENCE_DISCOVERED).alias("confidence"))


def new_mentions(annotated: DataFrame, matched: DataFrame) -> DataFrame:
    """Annotated names whose text is not already a catalog match of the comment."""
    known = matched.select("comment_id", F.lower("mention_text").alias("_name"))
    return annotated.withColumn("_name", F.lower("name")).join(
        known, ["comment_id", "_name"], "left_anti"
    ).drop("_name")
