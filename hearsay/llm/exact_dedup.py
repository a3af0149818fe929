"""Operator 8: exact dedup by recipes of content-defined chunks. DataFrame functions only.

A text is cut where its content says so: after at least ``least`` characters, at
the next end of a line or sentence, and after ``most`` characters at the latest.
Equal texts are cut alike, so they are equal exactly when their ordered lists of
chunk identifiers are.

Chunks are deduplicated to verified identifiers: a chunk is named by its 64-bit
hash and, among different chunks of one hash, by its rank. The dictionary of
different chunks is grouped on the chunks themselves, so a collision is seen and
resolved, never assumed away. After that only identifiers travel; a text is cut
in place and moves at most once as chunks, combined in each task first.

Skew: a group of copies is one row per task before any shuffle. Rows find their
group by a join that AQE may split; no group is gathered.

Cases: NULL text equals empty text and is a group like any other. A NULL id is
smaller than all ids. Rows that repeat both id and text are one document written
twice: exactly one of them is kept. Empty tables give empty results; further
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.llm.common import ascii_lower, staged


def chunks(text: Column, least: int = 512, most: int = 4096) -> Column:
    """The chunks of a text, in order; together they are the text."""
    cut = rf"(?s).{{{least},{most - 1}}}?(?:\n|[.!?] )|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(cut), F.lit(0))


def _hash(chunk: Column, bits: int) -> Column:
    return F.xxhash64(chunk) if bits == 64 else F.shiftrightunsigned(F.xxhash64(chunk), 64 - bits)


def collisions(texts: DataFrame, bits: int) -> DataFrame:
    """Rows (h, chunk, rank) of the chunks that share their hash with a different chunk."""
    parts = texts.select(F.explode(chunks(F.col("text"))).alias("chunk"))
    dictionary = parts.groupBy(_hash(F.col("chunk"), bits).alias("h"), "chunk").agg(F.count(F.lit(1)).alias("uses"))
    # Almost always empty: the texts are only read again if it is not.
    shared = staged(dictionary.groupBy("h").agg(F.count(F.lit(1)).alias("different")).filter("different > 1"), "shared-hashes")
    if shared.isEmpty():
        return texts.sparkSession.createDataFrame([], "h long, chunk string, rank int")
    twins = dictionary.join(shared, "h")
    # Few rows, and few per hash: the pairs of a birthday coincidence.
    smaller = twins.select(F.col("h").alias("h2"), F.col("chunk").alias("other"))
    ranked = twins.join(smaller, (F.col("h") == F.col("h2")) & (F.col("other") < F.col("chunk")), "left")
    ranks = ranked.groupBy("h", "chunk").agg(F.count("other").cast("int").alias("rank")).filter("rank > 0")
    return staged(ranks, "chunk-collisions")


def recipes(texts: DataFrame, bits: int = 64) -> DataFrame:
    """Rows (id, ``recipe``, ``sha``) of ``texts`` (id, text): the ordered verified identifiers, and a digest to report.

    A recipe is the list of chunk hashes with the list of (place, rank) of those
    chunks whose rank is above 0. Such chunks are as rare as hash collisions; if
    there are any, the texts that hold them get their ranks by equi-joins.
    """
    none = F.array().cast("array<struct<at:int,rank:int>>")
    ranked = collisions(texts, bits)
    digest = F.sha2(F.col("text").cast("binary"), 256).alias("sha")
    plain = texts.select("id", F.transform(chunks(F.col("text")), lambda c: _hash(c, bits)).alias("hashes"), digest)
    if ranked.isEmpty():
        return plain.select("id", F.struct("hashes", none.alias("ranks")).alias("recipe"), "sha")
    places = texts.select(digest, F.posexplode(chunks(F.col("text"))).alias("at", "chunk"))
    fixed = places.withColumn("h", _hash(F.col("chunk"), bits)).join(ranked, ["h", "chunk"]).groupBy("sha", "at").agg(F.min("rank").alias("rank"))
    fixes = fixed.groupBy("sha").agg(F.array_sort(F.collect_list(F.struct("at", "rank"))).alias("ranks"))
    return plain.join(fixes, "sha", "left").select("id", F.struct("hashes", F.coalesce("ranks", none).alias("ranks")).alias("recipe"), "sha")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """One row per input row: (id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``).

    Texts are equal when identical after lower-casing A-Z. The row with the
    largest id stays. ``bits`` shortens the chunk hash, for tests of collisions.
    """
    texts = docs.select(F.col(id_col).alias("id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    written = recipes(texts, bits).groupBy("id", "recipe", "sha").agg(F.count(F.lit(1)).alias("times"))
    written = staged(written, "chunk-recipes")
    groups = written.groupBy("recipe").agg(F.max("id").alias("keep_id"), F.sum("times").alias("group_size"))
    each = written.join(groups, "recipe").select("*", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy"))
    return each.select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
