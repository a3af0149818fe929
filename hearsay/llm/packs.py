"""Packed rows: many small values of one destination travel as one row of arrays.

A task fills a buffer and cuts it by destination; one row then carries thousands
of values without the cost of a row each. The number of destinations follows the
size of the input, so what meets in one destination is bounded at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm.words import finish

BYTES_PER_PART = 8 << 20


def count_parts(docs: DataFrame, text_col: str, part_bytes: int = BYTES_PER_PART) -> int:
    """Destinations for a table of texts: one for each ``part_bytes`` of text."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(1, -(-total // part_bytes))


def part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    return (finish(ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(parts)).astype(np.int64)


def pack_ids(ids: np.ndarray) -> bytes:
    """Integers as the first one and differences in the narrowest type that holds them."""
    steps = np.diff(ids)
    for kind in ("i1", "i2", "i4", "i8"):
        if not len(steps) or (steps.min() >= np.iinfo(kind).min and steps.max() <= np.iinfo(kind).max):
            break
    return kind.encode() + ids[:1].astype("<i8").tobytes() + steps.astype("<" + kind).tobytes()


def unpack_ids(data: bytes) -> np.ndarray:
    first = np.frombuffer(data, "<i8", 1 if len(data) > 2 else 0, 2)
    return np.cumsum(np.concatenate((first, np.frombuffer(data, "<" + data[:2].decode(), -1, 10).astype(np.int64)))) if len(first) else first


def cut(parts: np.ndarray) -> tuple[np.ndarray, Iterator[tuple[int, slice]]]:
    """An order that puts destinations together, and the span of each in it."""
    order = np.argsort(parts, kind="stable")
    there = parts[order]
    bounds = np.concatenate(([0], np.nonzero(np.diff(there))[0] + 1, [len(there)]))
    spans = ((int(there[a]), slice(int(a), int(b))) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b > a)
    return order, spans


def packed_rows(docs: DataFrame, id_col: str, parts: int, most_bytes: int = 24 << 20) -> DataFrame:
    """Rows (part, rows): whole input rows dealt by id, many to a row, as compressed Arrow streams."""
    at = docs.columns.index(id_col)

    def send(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        ids = table.column(at).cast(pa.int64())
        # Rows without an id meet nothing, so any destination does: they are dealt evenly.
        evenly = np.arange(table.num_rows) % parts
        order, spans = cut(np.where(ids.is_null().to_numpy(), evenly, part_of(ids.fill_null(0).to_numpy(), parts)))
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for part, span in spans:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=options) as stream:
                stream.write_table(table.take(pa.array(order[span])))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["part", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            step = max(1, int(batch.num_rows * most_bytes // max(1, batch.nbytes)))
            for begin in range(0, batch.num_rows, step):
                piece = batch.slice(begin, step)
                held.append(piece)
                size += piece.nbytes
                if size >= most_bytes:
                    yield from send(held)
                    held, size = [], 0
        if held:
            yield from send(held)

    return docs.mapInArrow(run, "part long, rows binary")


def unpacked(column: pa.ChunkedArray) -> Iterator[pa.Table]:
    for chunk in column.chunks:
        for value in chunk:
            yield pa.ipc.open_stream(value.as_buffer()).read_all()
