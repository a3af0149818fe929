"""The corpus pipeline: five stages over ``documents``, each a table of the same columns but the last.

Rejected documents go; one document of each group of equal texts stays, then one
of each group of near copies (five words, similarity 0.8); passages that a
document with a smaller id has are cut; what is left is packed into bins. Every
stage works on all that the one before kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearsay.llm import exact_dedup, minhash, packing, quality, substring_dedup
from hearsay.llm.common import ascii_lower, staged

# The quality model, the MinHash links and best-fit packing have no SQL form. The pipeline's own test compares
# exact dedup with brute force; of the other stages, the operators are compared in tests of their own.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from all labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, F.lit(True))
    scored = quality.score(docs, model, to="__score", predicted="__accepted")
    return scored.filter("__accepted = 1").select(docs.columns)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id, once."""
    groups = exact_dedup.exact_groups(docs).filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__kept_sha"))
    sha = F.sha2(ascii_lower(F.coalesce("text", F.lit(""))).cast("binary"), 256)
    named = docs.withColumn("__sha", sha)
    stay = named.join(groups, (F.col("__sha") == F.col("__kept_sha")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    # Rows that repeat both id and text are one document.
    nth = F.row_number().over(Window.partitionBy("__sha", "doc_id").orderBy(F.lit(0)))
    return stay.withColumn("__nth", nth).filter("__nth = 1").select(docs.columns)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    gone = minhash.near_groups(docs).filter("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller id has; other texts as they are."""
    names = ("__words", "__removed", "__kept")
    cut = substring_dedup.remove_shared(docs, carry=tuple(docs.columns), names=names)
    text = F.when(F.col("__removed") > 0, F.col("__kept")).otherwise(F.col("text"))
    n_chars = F.when(F.col("__removed") > 0, F.char_length("__kept").cast("long")).otherwise(F.col("n_chars"))
    changed = {"text": text} | ({"n_chars": n_chars} if "n_chars" in docs.columns else {})
    return cut.withColumns(changed).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document in its bins."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("exact dedup", drop_exact),
    ("near dedup", drop_near),
    ("substring dedup", cut_passages),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = staged(docs, name.replace(" ", "-"))
    return docs
