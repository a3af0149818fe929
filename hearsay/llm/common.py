"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.session import scratch_path

# ASCII white space, the separators of the word rule [^\x20\x09-\x0D]+.
ASCII_SPACE = "\\x20\\x09-\\x0D"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: a cut in the lineage that lost executors survive."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each piece hold about ``most_bytes``, and one row at least."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the fast general function, which does the same there."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )


def ascii_lower_bytes(raw: bytes) -> bytes:
    """``bytes.lower`` changes A-Z and nothing else."""
    return raw.lower()


def text_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; NULL as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def crc_fold(doc_id: Column, folds: int) -> Column:
    """The fold of a document: crc32 of its id as text, modulo ``folds``; NULL ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)
