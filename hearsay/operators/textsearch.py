"""Which of many terms occur in which texts: one plan for any number of terms.

The terms become an Aho-Corasick automaton (``automaton``), broadcast in tables of
bounded size; a list beyond one table has several, which the same Arrow pass walks in
turn. Texts are neither joined nor shuffled: each row gets the array of the terms it
holds. ``find_terms`` joins a list that outgrows a catalog instead (``termjoin``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.operators.automaton import TABLE_BYTES, build, split_terms, walk
from hearsay.operators.termjoin import join_terms
from hearsay.sizing import unnest, within

# Bytes of texts that one step of the walk handles.
BATCH_BYTES = 8 << 20
# Rows of terms up to which every task can hold the whole list; it may grow with the texts beyond.
CATALOG_TERMS = 60_000


def _pairs(machine, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs (row, term) of one batch, by row, then term."""
    texts = (pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts).cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    # A NULL text holds nothing, whatever its bytes.
    ends = np.where(np.asarray(texts.is_null()), offsets[:-1], offsets[1:])
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row, term, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BATCH_BYTES)) - 1)
        base = offsets[at]
        some = walk(machine, data[base:offsets[stop]], offsets[at:stop] - base, ends[at:stop] - base)
        row.append(some[0] + at)
        term.append(some[1])
        at = stop
    return np.concatenate(row), np.concatenate(term)


def _lists(row: np.ndarray, values: pa.Array, n: int) -> pa.Array:
    places = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(places), values)


def _machines(spark, terms: list[str], table_bytes: int) -> list:
    """The broadcast automata of different, non-empty terms, each reporting places in ``terms``."""
    listed = [t.encode() for t in terms]
    groups = split_terms(listed, table_bytes) if listed else []
    return [spark.sparkContext.broadcast(build([listed[k] for k in group.tolist()], group)) for group in groups]


def term_numbers(df: DataFrame, text: Column, terms: list[str], table_bytes: int = TABLE_BYTES) -> Column:
    """The numbers (places in ``terms``, different and not empty) of the terms that ``text`` holds, ascending; exact bytes, case included.

    A NULL text holds none. ``df`` only names the session.
    """

    def of(machine):
        @F.arrow_udf("array<int>")
        def numbers(texts: pa.Array) -> pa.Array:
            row, term = _pairs(machine.value, texts)
            return _lists(row, pa.array(term.astype(np.int32)), len(texts))

        return numbers(text)

    return _together([of(machine) for machine in _machines(df.sparkSession, terms, table_bytes)], "array<int>")


def _together(found: list[Column], kind: str) -> Column:
    if not found:
        return F.array().cast(kind)
    return found[0] if len(found) == 1 else F.array_sort(F.concat(*found))


def with_terms(df: DataFrame, text: Column, terms: DataFrame, to: str, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``df`` with the array ``to``: the rows of ``terms`` whose ``term`` the text holds, by ``ord``.

    The terms and what goes with them are broadcast to the tasks, so they grow with catalogs, not
    with texts; the arrays come out of the walk itself.
    """
    columns = ["ord", *[c for c in terms.columns if c != "ord"]]
    table = terms.filter("term <> ''").select(columns).orderBy("ord", "term").toArrow().combine_chunks()
    kind = f"array<{terms.select(columns).schema.simpleString()}>"
    names, of = np.unique(np.array(table.column("term").to_pylist(), dtype=object), return_inverse=True) if table.num_rows else (np.zeros(0, object), np.zeros(0, np.int64))
    by_name = np.argsort(of, kind="stable")
    begins = np.searchsorted(of[by_name], np.arange(len(names) + 1))
    rows = pa.StructArray.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns], fields=list(table.schema))
    spark = df.sparkSession
    payload = spark.sparkContext.broadcast((rows, by_name, begins))

    def of_machine(machine):
        @F.arrow_udf(kind)
        def held(texts: pa.Array) -> pa.Array:
            rows, by_name, begins = payload.value
            row, term = _pairs(machine.value, texts)
            counts = begins[term + 1] - begins[term]
            place = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
            row, each = np.repeat(row, counts), by_name[np.repeat(begins[term], counts) + place]
            # Rows of ``terms`` stand in their order.
            each = each[np.lexsort((each, row))]
            return _lists(row, rows.take(pa.array(each)), len(texts))

        return held(text)

    return df.withColumn(to, _together([of_machine(m) for m in _machines(spark, names.tolist(), table_bytes)], kind))


def find_terms(texts: DataFrame, text: str, terms: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Rows of ``texts`` (without ``text``) joined to the ``terms`` they contain.

    ``terms`` has a lower-case ``term`` column, an order column ``ord`` and any
    further columns; matching ignores the case of the text. Empty terms match nothing.
    A list of more than ``CATALOG_TERMS`` rows is joined to the texts, as it may grow with them.
    """
    if not within(terms, CATALOG_TERMS):
        return join_terms(texts, text, terms)
    keys = [c for c in texts.columns if c != text]
    found = unnest(with_terms(texts, F.lower(text), terms, "_found", table_bytes), keys, F.col("_found"), "_hit")
    return found.select(*keys, *[F.col(f"_hit.{c}").alias(c) for c in terms.columns])
