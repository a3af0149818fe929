"""Joining exports whose ids do not agree exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.functions.text import post_id_from_url, rounded_id_prefix
from hearsay.sizing import beside


def keep_last(df: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """The last row of each key; combined in every task before the shuffle."""
    # The order stands beside the rest: who needs no more than it leaves the rest behind.
    rest = F.struct(*[c for c in df.columns if c not in (key, order)])
    return df.groupBy(key).agg(F.max_by(rest, order).alias("_r"), F.max(order).alias(order)).select(key, "_r.*", order).select(df.columns)


def _index(posts: DataFrame, key: Column, order: str = "seq") -> DataFrame:
    """One post id per key: the post loaded last."""
    keyed = posts.select(key.alias("_key"), F.col("id").alias("_id"), F.col(order).alias("_order"))
    return keyed.filter("_key is not null and _key <> ''").groupBy("_key").agg(
        F.max_by("_id", F.struct("_order", "_id")).alias("_id")
    )


def _tier(df: DataFrame, index: DataFrame, on: Column, name: str) -> DataFrame:
    renamed = index.select(F.col("_key").alias(f"_k_{name}"), F.col("_id").alias(name))
    return df.join(renamed, on == F.col(f"_k_{name}"), "left").drop(f"_k_{name}")


def rounded_matches(df: DataFrame, media_id: str, posts: DataFrame) -> DataFrame:
    """(_mid, matched_id, match_tier) of every media id in ``df``: exact id, else its 15-digit prefix.

    ``posts`` has ``id`` and its load order ``seq``. One row per media id, about one per post.
    """
    wanted = df.select(F.col(media_id).alias("_mid")).filter("_mid is not null").distinct()
    exact = posts.select(F.col("id").alias("_key"), F.col("id").alias("_id")).distinct()
    prefix = _index(posts, rounded_id_prefix(F.col("id")))
    tiers = _tier(wanted, exact, F.col("_mid"), "_exact")
    tiers = _tier(tiers, prefix, rounded_id_prefix(F.col("_mid")), "_prefix")
    return tiers.select(
        "_mid",
        F.coalesce("_exact", "_prefix").alias("matched_id"),
        F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_prefix").isNotNull(), "prefix")
        .otherwise("none").alias("match_tier"),
    )


def match_rounded(df: DataFrame, media_id: str, posts: DataFrame) -> DataFrame:
    """Attach ``matched_id`` and ``match_tier`` (``rounded_matches``).

    The distinct media ids are matched; the comments themselves take part in a single
    join with that mapping, whose hot ids are split by skew joins.
    """
    mapping = rounded_matches(df, media_id, posts).withColumnRenamed("match_tier", "_tier")
    joined = df.join(mapping, F.col(media_id) == F.col("_mid"), "left")
    return joined.withColumn("match_tier", F.coalesce("_tier", F.lit("none"))).drop("_mid", "_tier")


def _metadata_tiers(posts: DataFrame, metadata: DataFrame) -> DataFrame:
    exact = posts.select(F.col("id").alias("_key"), F.col("id").alias("_id")).distinct()
    prefix = _index(posts, rounded_id_prefix(F.col("id")))
    tiers = _tier(metadata, exact, F.col("media_id"), "_exact")
    tiers = _tier(tiers, prefix, rounded_id_prefix(F.col("media_id")), "_prefix")
    return _tier(tiers, _index(posts, F.col("shortcode")), F.col("shortcode"), "_code")


def enrich_posts(posts: DataFrame, metadata: DataFrame) -> DataFrame:
    """Posts enriched from a metadata export; unmatched metadata becomes a post.

    Metadata finds its post by exact id, id prefix or shortcode, in this order.
    Description and upload date are replaced, counts only filled when missing.
    The result has one row per post id, so that both the post's own id and the
    metadata's exact id can be used to match comments.
    """
    tiers = _metadata_tiers(posts, metadata)
    found = tiers.withColumn("_post", F.coalesce("_exact", "_prefix", "_code")).drop("_exact", "_prefix", "_code")

    # Several metadata rows may meet one post: the last describes it, and the
    # first with a count fills a missing one.
    hits = found.filter("_post is not null").groupBy("_post").agg(
        F.max_by(F.struct("description", "upload_date"), "seq").alias("m"),
        F.min_by("likes", F.when(F.col("likes").isNotNull(), F.col("seq"))).alias("_likes"),
        F.min_by("comments", F.when(F.col("comments").isNotNull(), F.col("seq"))).alias("_comments"),
    )
    matched = posts.join(hits, posts["id"] == hits["_post"], "left").select(
        "id", "shortcode", "url", "caption",
        F.coalesce("m.description", F.lit("")).alias("description"),
        F.col("m.upload_date").alias("upload_date"),
        F.coalesce("likes_count", "_likes").alias("likes_count"),
        F.coalesce("comments_count", "_comments").alias("comments_count"),
        "posted_at", "owner_username", F.col("_post").isNotNull().alias("has_metadata"),
        F.lit(False).alias("from_metadata"), "seq",
    )
    fresh = keep_last(found.filter("_post is null").drop("_post"), "media_id")
    base = posts.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("n")).scalar()
    created = fresh.select(
        F.col("media_id").alias("id"), "shortcode", "url", "caption", "description", "upload_date",
        F.col("likes").alias("likes_count"), F.col("comments").alias("comments_count"),
        F.lit(None).cast("timestamp").alias("posted_at"), "owner_username",
        F.lit(True).alias("has_metadata"), F.lit(True).alias("from_metadata"),
        (F.col("seq") + base + 1).alias("seq"),
    )
    return matched.unionByName(created)


def alternate_ids(posts: DataFrame, metadata: DataFrame) -> DataFrame:
    """(id, alternate of post id) for metadata ids that name a post by prefix or shortcode."""
    tiers = _metadata_tiers(posts, metadata)
    named = tiers.filter("_exact is null").select(
        F.col("media_id").alias("id"), F.coalesce("_prefix", "_code").alias("post_id"), "seq"
    ).filter("post_id is not null")
    return keep_last(named, "id").select("id", "post_id")


def match_stats(matched: DataFrame) -> DataFrame:
    """Totals and match rate of ``match_rounded`` output, in one aggregation."""
    hit = F.col("match_tier") != "none"
    return matched.agg(
        F.count(F.lit(1)).alias("total_comments"),
        F.count_if(hit).alias("matched_comments"),
        F.count_if(F.col("match_tier") == "exact").alias("exact_matches"),
        F.count_if(F.col("match_tier") == "prefix").alias("prefix_matches"),
        F.bround(F.try_divide(F.count_if(hit).cast("double"), F.count(F.lit(1))) * 100, 1).alias("match_rate"),
    )


def post_stats(posts: DataFrame) -> DataFrame:
    """Loaded posts, those with metadata, distinct prefixes and shortcodes."""
    return posts.agg(
        F.count(F.lit(1)).alias("posts_loaded"),
        F.count_if("has_metadata").alias("posts_with_metadata"),
        F.countDistinct(rounded_id_prefix(F.col("id"))).alias("unique_prefixes"),
        F.countDistinct(F.nullif("shortcode", F.lit(""))).alias("shortcodes_indexed"),
    )


def attach_urls(df: DataFrame, urls: DataFrame | None, media_id: str = "media_id") -> DataFrame:
    """``post_url`` from a (media_id, post_url) map, else built from the id.

    The map is staged at once; rows of ``df`` do not move while it fits beside them (``sizing.beside``).
    """
    built = F.concat(F.lit("https://www.instagram.com/p/"), F.col(media_id), F.lit("/"))
    if urls is None:
        return df.withColumn("post_url", built)
    known = urls.select(F.col("media_id").alias("_mid"), F.col("post_url").alias("_url")).dropDuplicates(["_mid"])
    return df.join(beside(known), F.col(media_id) == F.col("_mid"), "left").withColumn(
        "post_url", F.coalesce(F.nullif("_url", F.lit("")), built)
    ).drop("_mid", "_url")


def assign_requests(items: DataFrame, requests: DataFrame) -> DataFrame:
    """The requested url each feed item answers.

    ``requests``: (ord, url). The first url, in order, that is part of the
    item's url or contains its media id; without one, the first url of all.

    Containment is an equi-join: the pieces of a text that are as long as some
    sought string meet that string itself. Urls differ little in length, so a
    url has few such pieces. Distinct urls and ids are matched, not items.
    """
    item_url = F.coalesce(F.nullif("post_url", F.lit("")), F.nullif("url", F.lit("")))
    keyed = items.withColumn("_url", item_url)
    first = F.struct(F.col("ord"), F.col("url").alias("request"))
    wanted = requests.groupBy("url").agg(F.min("ord").alias("ord"))

    def pieces(texts: DataFrame, text: str, sought: DataFrame, column: str) -> DataFrame:
        lengths = sought.agg(F.collect_set(F.length(column)).alias("n")).scalar()
        each = texts.withColumn("_lengths", lengths).withColumn("_n", F.explode("_lengths")).filter(F.col("_n") <= F.length(text))
        starts = F.sequence(F.lit(1), F.length(text) - F.col("_n") + 1)
        cut = F.transform(starts, lambda at: F.col(text).substr(at, F.col("_n")))
        return each.withColumn(column, F.explode(cut)).drop("_lengths", "_n")

    urls = keyed.select("_url").filter("_url is not null").distinct()
    parts = pieces(urls, "_url", wanted, "url")
    by_url = parts.join(wanted, "url").groupBy("_url").agg(F.min(first).alias("_by_url"))
    ids = keyed.select(F.col("media_id").alias("_mid")).filter("_mid <> ''").distinct()
    parts = pieces(wanted, "url", ids, "_mid")
    by_id = parts.join(ids, "_mid").groupBy("_mid").agg(F.min(first).alias("_by_id"))

    default = requests.agg(F.min_by("url", "ord").alias("u")).scalar()
    found = keyed.join(by_url, "_url", "left").join(by_id, F.col("media_id") == F.col("_mid"), "left")
    request = F.coalesce(F.least("_by_url", "_by_id")["request"], default)
    return found.withColumn("request_url", request).select(*items.columns, "request_url")


def due_for_refresh(posts: DataFrame, tracker: DataFrame, as_of: Column, max_age_hours: int = 24) -> DataFrame:
    """Posts never visited, or visited longer ago than ``max_age_hours``."""
    seen = tracker.select("url", "last_scraped")
    old = F.col("last_scraped") < as_of - F.expr(f"INTERVAL {int(max_age_hours)} HOURS")
    return posts.join(seen, "url", "left").filter(F.col("last_scraped").isNull() | old)


def recently_visited(tracker: DataFrame, limit: int = 10) -> DataFrame:
    return tracker.orderBy(F.desc("last_scraped"), "url").limit(limit)


def shared_urls(posts: DataFrame) -> DataFrame:
    """Posts whose url is stored under several ids, one row per post.

    The ids of a url are not gathered into one row: a missing url may be shared
    by very many posts.
    """
    counts = posts.groupBy(F.col("url").alias("_url")).agg(F.count(F.lit(1)).alias("n_posts"))
    shared = counts.filter("n_posts > 1")
    return posts.join(shared, F.col("url").eqNullSafe(F.col("_url"))).select("url", "n_posts", "external_id")


def id_kinds(posts: DataFrame, numeric_prefix: str = "37") -> DataFrame:
    """How many posts are stored under shortcodes and under numeric ids."""
    numeric = F.col("external_id").startswith(numeric_prefix)
    return posts.agg(
        F.count(F.lit(1)).alias("total_posts"),
        F.count_if(~numeric).alias("shortcode_posts"),
        F.count_if(numeric).alias("numeric_posts"),
    )


def expected_against_present(expected: DataFrame, posts: DataFrame) -> DataFrame:
    """Ids that are missing from the posts, and ids nobody expected."""
    want = expected.select(F.col("external_id").alias("id")).distinct()
    have = posts.select(F.col("external_id").alias("id")).distinct()
    return want.subtract(have).withColumn("status", F.lit("missing")).unionByName(
        have.subtract(want).withColumn("status", F.lit("extra"))
    )


def post_code(posts: DataFrame) -> DataFrame:
    """Posts with the code in their url, for matching exports by url."""
    return posts.withColumn("code", post_id_from_url(F.col("url")))
