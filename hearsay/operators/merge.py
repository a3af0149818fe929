"""Idempotent merges of new records into the stored tables.

Every merge is a DataFrame of the merged rows, joined on a natural or
deterministic key. ``apply_*`` functions write it back: facts are rewritten
only in the day partitions that the batch touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.functions.text import clip
from hearsay.keys import comment_id, post_id
from hearsay.operators.enrich import finish_signals, last_by_key
from hearsay.functions.labels import sentiment_label
from hearsay.session import checkpointed
from hearsay.tables import overwrite_partitions, post_bucket, write_table

MAX_SAMPLES = 10
SAMPLE_LENGTH = 200


# ------------------------------------------------------------------- posts


def post_records(raw: DataFrame) -> DataFrame:
    """The post side of raw comment records."""
    return raw.select(
        "platform", "external_post_id", "post_url", "post_caption", "post_subject",
        F.col("comment_timestamp").alias("posted_at"), "raw", "has_post_metadata", "seq",
    )


def update_records(updates: DataFrame) -> DataFrame:
    """Post updates in the shape of ``post_records``; they carry post metadata."""
    return updates.withColumn("has_post_metadata", F.lit(True))


def fold_posts(records: DataFrame) -> DataFrame:
    """All records of a post in one batch as one row, in arrival order.

    Combines in every task before the shuffle, so a post that drew a third of
    all comments arrives as a handful of partial rows.
    """
    filled = F.nullif("post_caption", F.lit(""))
    return records.groupBy("platform", "external_post_id").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.min_by(F.struct("post_url", "post_subject", "post_caption", "posted_at"), "seq").alias("first"),
        F.max_by(filled, F.when(filled.isNotNull(), F.col("seq"))).alias("last_caption"),
        F.max_by("posted_at", F.when(F.col("has_post_metadata"), F.col("seq"))).alias("last_posted_at"),
        F.max_by("raw", "seq").alias("last_raw"),
    )


def merge_posts(old: DataFrame, records: DataFrame) -> DataFrame:
    """Stored posts after a batch, with the ``action`` taken on each.

    The caption changes only to a non-empty one and the post time only by
    records with post metadata; raw data always; url and subject never.
    """
    new = fold_posts(records)
    joined = old.alias("o").join(
        new.alias("n"),
        (F.col("o.platform") == F.col("n.platform")) & (F.col("o.external_id") == F.col("n.external_post_id")),
        "full_outer",
    )
    known, hit = F.col("o.external_id").isNotNull(), F.col("n.external_post_id").isNotNull()

    def insert_or(stored: str, inserted: str) -> Column:
        return F.when(known, F.col(f"o.{stored}")).otherwise(F.col(f"n.first.{inserted}"))

    platform = F.coalesce("o.platform", "n.platform")
    external = F.coalesce("o.external_id", "n.external_post_id")
    return joined.select(
        F.coalesce("o.post_id", post_id(platform, external)).alias("post_id"),
        platform.alias("platform"),
        external.alias("external_id"),
        insert_or("url", "post_url").alias("url"),
        F.coalesce("n.last_caption", insert_or("caption", "post_caption")).alias("caption"),
        insert_or("subject_line", "post_subject").alias("subject_line"),
        F.coalesce("n.last_posted_at", insert_or("posted_at", "posted_at")).alias("posted_at"),
        F.when(hit, F.col("n.last_raw")).otherwise(F.col("o.raw_data")).alias("raw_data"),
        F.when(~hit, "kept").when(known, "updated").otherwise("created").alias("action"),
        F.coalesce("n.n_records", F.lit(0)).alias("n_records"),
    )


def apply_posts(root: str, stored: DataFrame, records: DataFrame) -> None:
    """Merge a batch into the stored posts, rewriting only the buckets it hits."""
    ids = records.select(post_id(F.col("platform"), F.col("external_post_id")).alias("post_id"))
    hit = ids.select(post_bucket().alias("bucket")).distinct()
    part = stored.join(F.broadcast(hit), "bucket", "left_semi").drop("bucket")
    overwrite_partitions(merge_posts(part, records).drop("action", "n_records"), root, "posts")


# ---------------------------------------------------------------- comments


def comment_records(raw: DataFrame) -> DataFrame:
    """One row per comment of a batch: of repeats the last record counts."""
    keyed = raw.select(
        post_id(F.col("platform"), F.col("external_post_id")).alias("post_id"),
        F.col("comment_author").alias("author_name"),
        F.col("comment_text").alias("text"),
        F.col("comment_timestamp").alias("created_at"),
        F.col("like_count").alias("likes"),
        "seq",
    ).withColumn("comment_id", comment_id(F.col("post_id"), F.col("author_name"), F.col("text"), F.col("created_at")))
    # The id is a hash of all key columns, so any row of the group carries them.
    return keyed.groupBy("comment_id").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.max_by(F.struct("post_id", "author_name", "text", "created_at", "likes"), "seq").alias("r"),
    ).select("comment_id", "n_records", "r.*")


def merge_comments(old: DataFrame, records: DataFrame) -> DataFrame:
    """Stored comments after a batch: a known comment only takes the new likes."""
    new = comment_records(records)
    joined = old.alias("o").join(new.alias("n"), F.col("o.comment_id") == F.col("n.comment_id"), "full_outer")
    known, hit = F.col("o.comment_id").isNotNull(), F.col("n.comment_id").isNotNull()

    def kept(name: str) -> Column:
        return F.when(known, F.col(f"o.{name}")).otherwise(F.col(f"n.{name}")).alias(name)

    return joined.select(
        F.coalesce("o.comment_id", "n.comment_id").alias("comment_id"),
        kept("post_id"), kept("author_name"), kept("text"), kept("created_at"),
        F.when(hit, F.col("n.likes")).otherwise(F.col("o.likes")).alias("likes"),
        F.coalesce("o.reply_count", F.lit(0).cast("bigint")).alias("reply_count"),
        F.col("o.parent_id").alias("parent_id"),
        F.coalesce("o.context_type", F.lit("direct")).alias("context_type"),
        F.col("o.extra_data").alias("extra_data"),
        F.when(~hit, "kept").when(known, "updated").otherwise("created").alias("action"),
        F.coalesce("n.n_records", F.lit(0)).alias("n_records"),
    )


def ingest_stats(merged_posts: DataFrame, merged_comments: DataFrame) -> DataFrame:
    """Created and updated posts and comments, counted per record.

    The second record of a new post is an update of it.
    """

    def counted(df: DataFrame, what: str) -> DataFrame:
        created = F.count_if(F.col("action") == "created")
        totals = df.agg(created.alias("created"), (F.coalesce(F.sum("n_records"), F.lit(0)) - created).alias("updated"))
        return totals.select(F.explode(F.create_map(
            F.lit(f"{what}_created"), F.col("created"), F.lit(f"{what}_updated"), F.col("updated"))
        ).alias("stat", "count"))

    return counted(merged_posts, "posts").unionByName(counted(merged_comments, "comments"))


def touched_days(df: DataFrame, at: str = "created_at") -> DataFrame:
    return df.select(F.to_date(at).alias("created_date")).distinct()


def in_touched(stored: DataFrame, touched: DataFrame) -> DataFrame:
    """Stored rows of the touched partitions; the partition of a missing day is one of them."""
    other = touched.select(*[F.col(c).alias(f"touched_{c}") for c in touched.columns])
    same = [F.col(c).eqNullSafe(F.col(f"touched_{c}")) for c in touched.columns]
    return stored.join(other, same, "left_semi")


def apply_comments(root: str, stored: DataFrame, records: DataFrame) -> None:
    """Merge a batch into the stored comments, rewriting only its days.

    The comment time is part of the key, so a record can only meet stored rows
    of its own day; the other days are neither read nor written.
    """
    part = in_touched(stored, touched_days(records, "comment_timestamp")).drop("created_date")
    merged = merge_comments(part, records).drop("action", "n_records")
    overwrite_partitions(merged, root, "comments")


# ----------------------------------------------------------------- signals


def merge_signals(old: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """Insert or update signals on (comment, entity, type, model).

    Both sides carry the deterministic signal id, in which a missing entity is
    a value like any other, so this is a plain equi-join. The value of a topic
    belongs to its key. Of a signal that ``new`` repeats the last row counts: by the column ``order`` if
    given, then by time and values, so that no order of rows changes the result. Columns that
    only ``old`` has keep their values.
    """
    both = [c for c in old.columns if c in new.columns]
    rest = [c for c in both if c != "signal_id"]
    latest = F.struct(*([F.col(order)] if order else []), *sorted(rest, key=lambda c: (c != "created_at", c)))
    once = new.groupBy("signal_id").agg(F.max_by(F.struct(*rest), latest).alias("_row")).select("signal_id", "_row.*")
    joined = old.alias("o").join(once.alias("n"), F.col("o.signal_id") == F.col("n.signal_id"), "full_outer")
    hit = F.col("n.signal_id").isNotNull()
    return joined.select(*[
        F.when(hit, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) if c in both else F.col(f"o.{c}").alias(c) for c in old.columns
    ])


def apply_signals(root: str, stored: DataFrame, new: DataFrame) -> None:
    """Merge signals into the stored table, rewriting only touched partitions.

    ``new`` carries ``comment_date``, the day of the comment.
    """
    parts = new.select("signal_type", "comment_date").distinct()
    touched = in_touched(stored, parts)
    overwrite_partitions(merge_signals(touched, new), root, "extracted_signals")


# -------------------------------------------------- discovered and reviews


def replace_table(root: str, name: str, merged: DataFrame) -> None:
    """Write a merged table over the stored one that it reads.

    For the tables that merges rebuild whole: discovered names, review queue, catalog
    and tracker. ``merged`` is written to the shared folder first; if the job dies
    while the table is being replaced, that copy still has all rows.
    """
    write_table(checkpointed(merged), root, name)


def discovered_totals(mentions: DataFrame) -> DataFrame:
    """Count, first and last sighting and up to ten samples of each name.

    ``mentions``: (comment_id, name, entity_type, created_at, text). Samples
    are ranked first and cut to ten per name in every task, so a name that a
    third of all comments contain never gathers its texts in one place.
    """
    counts = mentions.groupBy("name").agg(
        F.min("entity_type").alias("entity_type"),
        F.min("created_at").alias("first_seen_at"),
        F.max("created_at").alias("last_seen_at"),
        F.count(F.lit(1)).alias("mention_count"),
    )
    order = Window.partitionBy("name").orderBy("created_at", "comment_id")
    samples = (
        mentions.select("name", "created_at", "comment_id", clip(F.col("text"), SAMPLE_LENGTH).alias("sample"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= MAX_SAMPLES)
        .groupBy("name")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "sample"))).alias("s"))
        .select("name", F.transform("s", lambda x: x["sample"]).alias("sample_mentions"))
    )
    return counts.join(samples, "name")


def merge_discovered(old: DataFrame, mentions: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """Add new mentions to the stored tally.

    ``counted`` holds the (comment_id, name) pairs of earlier runs; passing it
    makes a repeated run change nothing.
    """
    # No more of a text is kept, so no more moves.
    mentions = mentions.withColumn("text", clip(F.col("text"), SAMPLE_LENGTH))
    if counted is not None:
        mentions = mentions.join(counted.select("comment_id", "name"), ["comment_id", "name"], "left_anti")
    joined = old.alias("o").join(discovered_totals(mentions).alias("n"), F.col("o.name") == F.col("n.name"), "full_outer")
    no_samples = F.array().cast("array<string>")
    samples = F.concat(F.coalesce("o.sample_mentions", no_samples), F.coalesce("n.sample_mentions", no_samples))
    return joined.select(
        F.coalesce("o.name", "n.name").alias("name"),
        F.coalesce("o.entity_type", "n.entity_type").alias("entity_type"),
        F.coalesce("o.first_seen_at", "n.first_seen_at").alias("first_seen_at"),
        F.greatest("o.last_seen_at", "n.last_seen_at").alias("last_seen_at"),
        (F.coalesce("o.mention_count", F.lit(0)) + F.coalesce("n.mention_count", F.lit(0))).alias("mention_count"),
        F.slice(samples, 1, MAX_SAMPLES).alias("sample_mentions"),
        F.coalesce("o.reviewed", F.lit(False)).alias("reviewed"),
        F.col("o.reviewed_at").alias("reviewed_at"),
        F.col("o.action_taken").alias("action_taken"),
    )


_REVIEW_UPDATES = ("confidence", "possible_entities", "reason")


def merge_reviews(old: DataFrame, new: DataFrame) -> DataFrame:
    """Queue new items; an item still waiting for the same mention is refreshed.

    A mention that was reviewed before is queued under an id of its own, with
    the number of earlier reviews, so that a decision meets one row.
    """
    waiting = ~F.coalesce(F.col("o.reviewed"), F.lit(False))
    same = (F.col("o.comment_id") == F.col("n.comment_id")) & (F.col("o.entity_mention") == F.col("n.entity_mention"))
    if "review_id" in new.columns:
        before = old.filter("reviewed").groupBy("comment_id", "entity_mention").agg(F.count(F.lit(1)).alias("_reviews"))
        again = F.concat("review_id", F.lit("-"), F.col("_reviews").cast("string"))
        counted = new.join(before, ["comment_id", "entity_mention"], "left")
        new = counted.withColumn("review_id", F.coalesce(again, "review_id")).select(new.columns)
    joined = old.alias("o").join(new.alias("n"), same & waiting, "full_outer")
    known, hit = F.col("o.comment_id").isNotNull(), F.col("n.comment_id").isNotNull()

    def column(name: str) -> Column:
        stored = F.col(f"o.{name}")
        fresh = F.col(f"n.{name}") if name in new.columns else F.lit(None).cast(old.schema[name].dataType)
        if name in _REVIEW_UPDATES:
            return F.when(hit, fresh).otherwise(stored).alias(name)
        return F.when(known, stored).otherwise(fresh).alias(name)

    return joined.select(*[column(c) for c in old.columns])


def review_decisions(queue: DataFrame, decisions: DataFrame, likes: DataFrame, run_ts: Column) -> tuple[DataFrame, DataFrame]:
    """Apply human decisions: the updated queue, and signals for assigned mentions.

    ``decisions``: (review_id, decision, assigned_entity_id, score, reviewed_by);
    ``likes``: (comment_id, weight_score). An assignment is certain, so its
    confidence is 1; ``ignore`` and ``new_entity`` give no signal. Items that
    were reviewed before keep their decision and give no further signal.
    """
    d = decisions.select(
        "review_id", F.col("decision").alias("_decision"), F.col("assigned_entity_id").alias("_entity"),
        F.col("score").alias("_score"), F.col("reviewed_by").alias("_by"),
    )
    joined = queue.join(d, "review_id", "left")
    decided = F.col("_decision").isNotNull() & ~F.coalesce("reviewed", F.lit(False))
    changes = {
        "reviewed": decided | F.coalesce("reviewed", F.lit(False)),
        "reviewed_at": F.when(decided, run_ts).otherwise(F.col("reviewed_at")),
        "reviewed_by": F.when(decided, F.coalesce("_by", "reviewed_by")).otherwise(F.col("reviewed_by")),
        "decision": F.when(decided, F.col("_decision")).otherwise(F.col("decision")),
        "assigned_entity_id": F.when(decided, F.coalesce("_entity", "assigned_entity_id")).otherwise(F.col("assigned_entity_id")),
    }
    updated = joined.select(*[changes.get(c, F.col(c)).alias(c) for c in queue.columns])
    assigned = joined.filter(decided & (F.col("_decision") == "assign")).join(likes.select("comment_id", "weight_score"), "comment_id")
    rows = assigned.select(
        "comment_id", F.col("_entity").alias("entity_id"), F.lit("sentiment").alias("signal_type"),
        sentiment_label(F.col("_score")).alias("value"), F.col("_score").cast("double").alias("numeric_value"),
        "weight_score", F.lit(1.0).alias("confidence"),
    )
    return updated, finish_signals(rows, run_ts, F.lit("human_review"))


# ------------------------------------------------------- catalog and tracker


def seed_entities(catalog: DataFrame, seeds: DataFrame) -> DataFrame:
    """The catalog plus seeds whose name it does not hold yet."""
    return catalog.unionByName(new_seeds(catalog, seeds), allowMissingColumns=True)


def new_seeds(catalog: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seeds whose name the catalog does not hold; of a name that comes twice the first counts."""
    missing = seeds.join(catalog.select("name"), "name", "left_anti").select(seeds.columns)
    rest = F.struct(*[c for c in seeds.columns if c != "name"])
    # By the order of the file; rows of one place, or without one, by their values.
    first = F.struct(*([F.col("load_order")] if "load_order" in seeds.columns else []), rest)
    return missing.groupBy("name").agg(F.min_by(rest, first).alias("_row")).select("name", "_row.*").select(seeds.columns)


def promote_entity(
    catalog: DataFrame, discovered: DataFrame, names: DataFrame, run_ts: Column
) -> tuple[DataFrame, DataFrame]:
    """Add names to the catalog unless present, and mark them as reviewed.

    ``names`` has the catalog's columns. Names already in the catalog change nothing.
    """
    added = new_seeds(catalog, names)
    grown = catalog.unionByName(added, allowMissingColumns=True)
    flag = added.select("name").withColumn("_added", F.lit(True))
    marked = discovered.join(flag, "name", "left")
    hit = F.coalesce("_added", F.lit(False))
    changes = {
        "reviewed": hit | F.col("reviewed"),
        "reviewed_at": F.when(hit, run_ts).otherwise(F.col("reviewed_at")),
        "action_taken": F.when(hit, "added_to_monitored").otherwise(F.col("action_taken")),
    }
    return grown, marked.select(*[changes.get(c, F.col(c)).alias(c) for c in discovered.columns])


def merge_tracker(old: DataFrame, visits: DataFrame) -> DataFrame:
    """Latest visit per url; ``visits`` has the tracker's columns."""
    both = old.unionByName(visits)
    return last_by_key(both, "url", "last_scraped").select(old.columns)
