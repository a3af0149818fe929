"""The seed file of monitored entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.keys import natural_id
from hearsay.schemas import struct

_SEED = struct("name string, canonical_name string, entity_type string, aliases strings")


def read_entity_seed(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of entities, in file order, as catalog rows."""
    seeds = spark.read.schema(_SEED).option("multiLine", True).json(path)
    return seeds.select(
        natural_id(F.col("name")).alias("entity_id"),
        "name",
        "canonical_name",
        F.lower("entity_type").alias("entity_type"),
        F.lit(True).alias("is_active"),
        F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"),
        F.monotonically_increasing_id().alias("load_order"),
    )
