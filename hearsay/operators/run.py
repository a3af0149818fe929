"""One enrichment run: comments and their responses in, all stored tables out.

A run has a name. It first writes everything it is going to change below
``<root>/_runs/<name>`` and then moves the stored tables there, so a run that died
at any point is finished by calling it again with its name: what is staged is neither
computed nor counted twice. A ledger of counted (comment, name) pairs makes any
further run over the same comments leave the tally of discovered names as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from hearsay.operators.enrich import discovered_from_responses, discovered_in_texts, response_signals, review_items
from hearsay.operators.matching import mention_arrays
from hearsay.operators.merge import apply_signals, merge_discovered, merge_reviews
from hearsay.operators.responses import parse_responses
from hearsay.schemas import DISCOVERED, REVIEW_QUEUE, SIGNALS, struct
from hearsay.tables import read_tables, write_table

LEDGER = struct("comment_id string, name string, run string")


def create_store(spark: SparkSession, root: str) -> None:
    """Empty stored tables of an enrichment."""
    signals = spark.createDataFrame([], SIGNALS).withColumn("comment_date", F.lit(None).cast("date"))
    write_table(signals, root, "extracted_signals")
    write_table(spark.createDataFrame([], DISCOVERED), root, "discovered_entities")
    write_table(spark.createDataFrame([], REVIEW_QUEUE), root, "review_queue")
    spark.createDataFrame([], LEDGER).write.mode("overwrite").partitionBy("run").parquet(f"{root}/counted_mentions")


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    """The (comment_id, name) pairs that the tally holds, by the run that counted them."""
    return spark.read.schema(LEDGER).parquet(f"{root}/counted_mentions")


def _is_written(spark: SparkSession, path: str) -> bool:
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def _staged(df, path: str, spark: SparkSession) -> tuple[DataFrame, int]:
    """The frame that ``df()`` makes, written once, and its rows, counted while it is written."""
    if _is_written(spark, path):
        found = spark.read.parquet(path)
        return found, found.count()
    frame, seen = df(), Observation()
    frame.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    return spark.read.schema(frame.schema).parquet(path), seen.get["n"]


def enrich(
    comments: DataFrame, responses: DataFrame | None, entities: DataFrame, posts: DataFrame, root: str, name: str,
    run_ts: Column, source_model: str,
) -> DataFrame:
    """Enrich ``comments`` into the stored tables below ``root``; returns the counts of the run, one row a kind.

    ``comments``: comment_id, post_id, text, created_at, likes, one row per comment; ``responses``: comment_id and
    raw_json, one row per comment, or None if ``comments`` brings raw_json along. A comment without response gets the neutral
    analysis. ``name`` names the run in its folders: letters, digits, ``-`` and ``_``.
    """
    spark, stage = comments.sparkSession, f"{root}/_runs/{name}"

    def analysed() -> DataFrame:
        matched = mention_arrays(comments, entities, posts)
        matched = matched.join(posts.select("post_id", "caption"), "post_id", "left")
        if responses is not None:
            matched = matched.join(responses.select("comment_id", "raw_json"), "comment_id", "left")
        return parse_responses(matched).drop("recovered").withColumn("comment_id", F.col("comment_id").cast("string"))

    work, processed = _staged(analysed, f"{stage}/analysed", spark)
    catalog = entities.withColumn("entity_id", F.col("entity_id").cast("string"))
    work = work.withColumn("comment_date", F.to_date("created_at"))

    signals, n_signals = _staged(
        lambda: response_signals(work, entities, run_ts, source_model, "comment_date").withColumn("entity_id", F.col("entity_id").cast("string")),
        f"{stage}/signals", spark,
    )
    items, n_items = _staged(lambda: review_items(work, run_ts), f"{stage}/items", spark)
    pairs, n_names = _staged(
        # A name that both the response and the annotator found in a comment counts once.
        lambda: discovered_from_responses(work, catalog).unionByName(discovered_in_texts(work)).dropDuplicates(["comment_id", "name"]),
        f"{stage}/names", spark,
    )
    stored = read_tables(spark, root, ["extracted_signals", "discovered_entities", "review_queue"])
    before = read_ledger(spark, root).filter(F.col("run") != name)
    # Both tables are staged whole before any stored table changes.
    tally, _ = _staged(lambda: merge_discovered(stored.discovered_entities, pairs, counted=before), f"{stage}/discovered_entities", spark)
    queue, _ = _staged(lambda: merge_reviews(stored.review_queue, items), f"{stage}/review_queue", spark)
    counted, _ = _staged(
        lambda: pairs.select("comment_id", "name").join(before.select("comment_id", "name"), ["comment_id", "name"], "left_anti"),
        f"{stage}/counted", spark,
    )
    applied = f"{stage}/applied"
    if not _is_written(spark, applied):
        apply_signals(root, stored.extracted_signals, signals)
        write_table(tally, root, "discovered_entities")
        write_table(queue, root, "review_queue")
        ledger = counted.withColumn("run", F.lit(name)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        ledger.partitionBy("run").parquet(f"{root}/counted_mentions")
        counts = [("comments_processed", processed), ("signals_created", n_signals), ("entities_discovered", n_names), ("queued_for_review", n_items)]
        spark.createDataFrame(counts, "kind string, count long").coalesce(1).write.mode("overwrite").parquet(applied)
    return spark.read.schema("kind string, count long").parquet(applied)
