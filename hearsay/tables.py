"""The set of stored tables, and partition-wise reading and writing of them."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearsay.schemas import TABLE_SCHEMAS

# Physical layout. Facts are laid out by day, so a time window prunes files and a
# merge rewrites only the days it hits; posts have no useful day and are laid out
# by a hash of their id instead.
LAYOUT = {
    "posts": ["bucket"],
    "comments": ["created_date"],
    "extracted_signals": ["signal_type", "comment_date"],
}


FILES_PER_PARTITION = 32
POST_BUCKETS = 64


@dataclass(frozen=True)
class Tables:
    """The stored tables as DataFrames; absent tables are ``None``."""

    posts: DataFrame | None = None
    comments: DataFrame | None = None
    monitored_entities: DataFrame | None = None
    extracted_signals: DataFrame | None = None
    discovered_entities: DataFrame | None = None
    review_queue: DataFrame | None = None
    post_tracker: DataFrame | None = None
    metrics: DataFrame | None = None
    # Signals already joined to their comments (see ``plans.facts.stage_facts``).
    facts: DataFrame | None = None

    def with_(self, **frames: DataFrame) -> "Tables":
        return replace(self, **frames)

    @property
    def active_entities(self) -> DataFrame:
        entities = self.monitored_entities
        if "is_active" in entities.columns:
            entities = entities.filter("is_active")
        return entities


def read_tables(spark: SparkSession, root: str, names: list[str] | None = None) -> Tables:
    """Open the stored tables below ``root`` with their declared schemas."""
    names = names or [f.name for f in fields(Tables) if f.name in TABLE_SCHEMAS]
    found = {}
    for name in names:
        schema = TABLE_SCHEMAS[name]
        for part in LAYOUT.get(name, []):
            if part not in schema.fieldNames():
                kind = T.IntegerType() if part == "bucket" else T.DateType()
                schema = type(schema)(list(schema.fields)).add(part, kind)
        found[name] = spark.read.schema(schema).parquet(f"{root}/{name}")
    return Tables(**found)


def write_table(df: DataFrame, root: str, name: str) -> None:
    """Write a table whole (first load, or a small dimension)."""
    _laid_out(df, name).mode("overwrite").parquet(f"{root}/{name}")


def overwrite_partitions(df: DataFrame, root: str, name: str) -> None:
    """Replace only the partitions present in ``df``; a repeat gives the same files."""
    (
        _laid_out(df, name)
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .parquet(f"{root}/{name}")
    )


def post_bucket():
    return F.pmod(F.xxhash64("post_id"), F.lit(POST_BUCKETS)).cast("int")


def _laid_out(df: DataFrame, name: str):
    parts = LAYOUT.get(name, [])
    if "created_date" in parts and "created_date" not in df.columns:
        df = df.withColumn("created_date", F.to_date("created_at"))
    if "bucket" in parts:
        return df.withColumn("bucket", post_bucket()).repartition("bucket").write.partitionBy("bucket")
    if not parts:
        return df.write
    # Spread each partition over several tasks by a hash of the row key, so that
    # a busy day is neither one task nor thousands of tiny files.
    salt = F.pmod(F.xxhash64("comment_id"), F.lit(FILES_PER_PARTITION))
    return df.repartition(*[F.col(p) for p in parts], salt).write.partitionBy(*parts)
