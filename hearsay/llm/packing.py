"""Operator 5: best-fit packing under conflicts.

Documents are cut into segments of at most ``capacity`` tokens; full ones have a bin
to themselves. The others go, longest first, to the open bin with the least room
left that holds them and has no conflict: bins are ordered by residual, each carries
a bitmap of its sources and one of its duplicate clusters, and the search goes from
the first bin with room on to its successors until one is compatible. A bin takes at
most ``per_source`` segments of one source and one segment of a cluster.

Packing is sequential, so it is done in shards of bounded size, dealt by a hash of
the id, cluster and number among equal rows: a hot source or cluster, and a row that is
repeated any number of times, is spread over all shards. Equal rows are counted
map-side before they move. Only lengths, sources and clusters travel, no text. A bin is
named by shard and number.

Cases: NULL and empty text have no token and no cluster; they take no room, yet a place, and count for
their source. A NULL source or cluster conflicts with nothing. Rows that repeat an
id are packed each; which of them has which place is the same in every run. A very long text fills bins of
its own and packs what is left over. Equal lengths go by id, missing ids last, then by cluster.
Empty tables give empty results; further columns, whatever their names, are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARD_ROWS = 8192
REPEATS = 4096


def token_count(text: Column) -> Column:
    """Words, numbers and other signs of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]")), F.lit(0)).cast("long")


def best_fit(lengths: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int) -> tuple[list[int], list[int]]:
    """The bin and offset of each item, items taken in the given order; -1 as source or cluster never conflicts.

    Bit s * per_source + k of a bin's source bitmap says that it holds more than k segments of source s.
    """
    open_bins: list[tuple[int, int]] = []  # (residual, bin), ascending
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    bins, offsets = [], []
    for length, source, cluster in zip(lengths, sources, clusters, strict=True):
        last = 1 << (source * per_source + per_source - 1) if source >= 0 else 0
        twin = 1 << cluster if cluster >= 0 else 0
        at = bisect_left(open_bins, (length, -1))
        while at < len(open_bins) and (source_bits[open_bins[at][1]] & last or cluster_bits[open_bins[at][1]] & twin):
            at += 1
        if at < len(open_bins):
            residual, chosen = open_bins.pop(at)
        else:
            residual, chosen = capacity, len(source_bits)
            source_bits.append(0)
            cluster_bits.append(0)
        bins.append(chosen)
        offsets.append(capacity - residual)
        if source >= 0:
            bit = 1 << (source * per_source)
            while source_bits[chosen] & bit:
                bit <<= 1
            source_bits[chosen] |= bit
        cluster_bits[chosen] |= twin
        insort(open_bins, (residual - length, chosen))
    return bins, offsets


def _numbers(values: pd.Series) -> np.ndarray:
    return pd.factorize(values, use_na_sentinel=True)[0].astype(np.int64)


def pack(
    docs: DataFrame, capacity: int = 4096, per_source: int = 4, length: Column | None = None, cluster: Column | None = None,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """Rows (id, ``segment``, ``n_tokens``, ``shard``, ``bin``, ``bin_offset``).

    ``cluster`` names a document's duplicates, by default its text without regard
    to case and white space; ``length`` is its number of tokens.
    """
    if length is None:
        length = token_count(F.col(text_col))
    if cluster is None:
        cluster = F.xxhash64(F.regexp_replace(F.lower(F.col(text_col)), r"\s+", " "))
    shards = max(1, -(-docs.count() // shard_rows))
    facts = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), cluster.cast("long").alias("cluster"), length.cast("long").alias("length"),
    )
    facts = facts.withColumn("cluster", F.when(F.col("length") > 0, F.col("cluster")))
    times = facts.groupBy("id", "source", "cluster", "length").agg(F.count(F.lit(1)).alias("times"))
    # In two steps, so that no array grows with the number of equal rows beyond a fraction of it.
    chunks = times.select("*", F.explode(F.expr(f"sequence(0L, (times - 1) div {REPEATS})")).alias("chunk"))
    first = F.col("chunk") * REPEATS
    nth = F.explode(F.sequence(first, F.least(first + (REPEATS - 1), F.col("times") - 1))).alias("nth")
    rows = chunks.select("id", "source", "cluster", "length", nth).withColumn("shard", F.pmod(F.xxhash64("id", "cluster", "nth"), F.lit(shards))).drop("nth")
    # pandas makes floats of a column of numbers with a NULL, so NULLs travel in columns of their own.
    for name in ("id", "cluster"):
        rows = rows.withColumn(f"no_{name}", F.col(name).isNull()).withColumn(name, F.coalesce(name, F.lit(0).cast("long")))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "no_id", "id", "no_cluster", "cluster"], ascending=[False, True, True, True, True], kind="stable")
        lengths = frame["length"].to_numpy(np.int64)
        full = lengths // capacity
        rest = np.nonzero((lengths % capacity > 0) | (lengths == 0))[0]
        rest = rest[np.argsort(-(lengths[rest] % capacity), kind="stable")]
        clusters = np.where(frame["no_cluster"].to_numpy(bool), -1, _numbers(frame["cluster"]))
        bins, offsets = best_fit(
            (lengths[rest] % capacity).tolist(), _numbers(frame["source"])[rest].tolist(), clusters[rest].tolist(), capacity, per_source,
        )
        whole = np.repeat(np.arange(len(frame)), full)
        nth = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        opened = max(bins, default=-1) + 1
        at = np.concatenate((whole, rest))
        return pd.DataFrame({
            "id": frame["id"].to_numpy()[at], "no_id": frame["no_id"].to_numpy(bool)[at], "segment": np.concatenate((nth, full[rest])),
            "n_tokens": np.concatenate((np.full(len(whole), capacity), lengths[rest] % capacity)), "shard": key[0],
            "bin": np.concatenate((opened + np.arange(len(whole)), np.array(bins, np.int64))),
            "bin_offset": np.concatenate((np.zeros(len(whole), np.int64), np.array(offsets, np.int64))),
        })

    out = rows.groupBy("shard").applyInPandas(run, "id long, no_id boolean, segment long, n_tokens long, shard long, bin long, bin_offset long")
    return out.withColumn("id", F.when(~F.col("no_id"), F.col("id"))).drop("no_id").withColumnRenamed("id", id_col)
