"""Which terms occur in which texts, for lists of terms that grow with the texts.

An automaton of all terms would walk every text, so its work is the product of both. Here
texts are dealt in chunks of bounded size, and a chunk gets the terms only whose first bytes
occur in it: a join on grams (runs of 8 bytes; 4, 2 or 1 for shorter terms). Within a chunk the candidates
are found by their first and last grams and compared byte by byte, so the result is exact.

Grams, terms and candidates move as compressed blobs of many rows, those of like terms side by side, and a task
opens one at a time: it holds the texts of one chunk or the grams of one part, whatever the number of terms.
Nothing is collected or broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Bytes of texts of a chunk, and steps of a walk over its places held at once.
CHUNK_BYTES = 2 << 20
STEPS = 1 << 20
# Bytes of rows that a task gathers before it packs them.
PACK_BYTES = 8 << 20
SIZES = (1, 2, 4, 8)


def grams(data: np.ndarray) -> np.ndarray:
    """At every place the 8 bytes from there on as one number, the first byte lowest; zeros follow the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    windows = np.lib.stride_tricks.sliding_window_view(padded, 8)[:len(data)]
    return np.ascontiguousarray(windows).view("<u8").ravel()


def _mask(size: int) -> np.uint64:
    return np.uint64((1 << 8 * size) - 1)


def _bytes(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of different texts, and where each starts and ends; a NULL text is empty."""
    texts = (pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) and texts.num_chunks else texts)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    return data, offsets[:-1], np.where(np.asarray(texts.is_null()), offsets[:-1], offsets[1:])


def _places(starts: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At every place its text and the bytes left of it (0 outside all texts)."""
    lengths = ends - starts
    owner, room = np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = np.repeat(starts, lengths) + _counted(lengths)
    owner[at] = np.repeat(np.arange(len(starts)), lengths)
    room[at] = np.repeat(ends, lengths) - at
    return owner, room


def _counted(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each of ``counts``, one after the other."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def _sizes(lengths: np.ndarray) -> np.ndarray:
    """The gram size of terms of these lengths: the largest that is no longer."""
    return np.array(SIZES)[np.searchsorted(SIZES, lengths, side="right") - 1]


class Texts:
    """The bytes of some texts, and their places in the order of the grams there."""

    def __init__(self, texts) -> None:
        data, starts, ends = _bytes(texts)
        self.here = grams(data)
        self.owner, self.room = _places(starts, ends, len(data))
        self._ordered: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def ordered(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Grams of this size, ascending, and the place of each."""
        if size not in self._ordered:
            places = np.nonzero(self.room >= size)[0]
            found = self.here[places] & _mask(size)
            by_gram = np.argsort(found, kind="stable")
            self._ordered[size] = found[by_gram], places[by_gram]
        return self._ordered[size]

    def find(self, terms) -> tuple[np.ndarray, np.ndarray]:
        """Different pairs (text, term) for an Arrow array of strings, by text, then term; terms are not empty."""
        names, begins, stops = _bytes(terms)
        if not len(self.here) or not len(names):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        there, lengths = grams(names), stops - begins
        sizes, pairs = _sizes(lengths), [np.zeros(0, np.int64)]
        for size in SIZES:
            some = np.nonzero(sizes == size)[0]
            if len(some):
                pairs += _find_of_size(size, some, self, there, begins[some], lengths[some], len(lengths))
        found = np.unique(np.concatenate(pairs))
        return found // len(lengths), found % len(lengths)


def find(texts, terms) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs (text, term) for two Arrow arrays of strings, by text, then term; terms are not empty."""
    return Texts(texts).find(terms)


def _find_of_size(size, some, texts, there, begins, lengths, n_terms):
    here, owner, room = texts.here, texts.owner, texts.room
    firsts, first = np.unique(there[begins] & _mask(size), return_inverse=True)
    lasts, last = np.unique(there[begins + lengths - size] & _mask(size), return_inverse=True)
    # The different lengths of the terms of each first gram.
    span = int(lengths.max()) + 1
    kinds, kind = np.unique(first * span + lengths, return_inverse=True)
    kind_begins = np.searchsorted(kinds // span, np.arange(len(firsts) + 1))
    keys = kind * len(lasts) + last
    by_key = np.argsort(keys, kind="stable")
    keys = keys[by_key]

    found, at = texts.ordered(size)
    left = np.searchsorted(found, firsts, side="left")
    times = np.searchsorted(found, firsts, side="right") - left
    rank = np.repeat(np.arange(len(firsts)), times)
    places = at[np.repeat(left, times) + _counted(times)]
    counts = kind_begins[rank + 1] - kind_begins[rank]
    for places, kind in _steps(counts, places, kind_begins[rank]):
        length = kinds[kind] % span
        fits = room[places] >= length
        places, kind, length = places[fits], kind[fits], length[fits]
        ending = here[places + length - size] & _mask(size)
        rank_of = np.minimum(np.searchsorted(lasts, ending), len(lasts) - 1)
        same = lasts[rank_of] == ending
        places, wanted = places[same], kind[same] * len(lasts) + rank_of[same]
        left = np.searchsorted(keys, wanted, side="left")
        many = np.searchsorted(keys, wanted, side="right") - left
        for at, nth in _steps(many, places, left):
            term = by_key[nth]
            # Both ends agree; what lies between is compared 8 bytes at a time.
            inner = 8
            open_ = np.nonzero(lengths[term] > inner + size)[0]
            good = np.ones(len(term), bool)
            while len(open_):
                good[open_] = here[at[open_] + inner] == there[begins[term[open_]] + inner]
                inner += 8
                open_ = open_[good[open_]]
                open_ = open_[lengths[term[open_]] > inner + size]
            yield np.unique(owner[at[good]] * n_terms + some[term[good]])


def _steps(counts, places, firsts):
    """Every pair (place, first) as (place, first + 0, 1, ... below its count), some ``STEPS`` at once."""
    total = np.cumsum(counts)
    lo = 0
    while lo < len(counts):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + STEPS, side="right")))
        some = counts[lo:hi]
        yield np.repeat(places[lo:hi], some), np.repeat(firsts[lo:hi], some) + _counted(some)
        lo = hi


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_table(table)
    return sink.getvalue().to_pybytes()


def _opened(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def _part(found: np.ndarray, parts: int) -> np.ndarray:
    """The part that joins a gram with the terms that start with it."""
    mixed = (found ^ (found >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)


def _runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Every run of equal values as (value, from, to)."""
    cuts = np.nonzero(np.diff(values))[0] + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)], strict=True):
        if hi > lo:
            yield int(values[lo]), lo, hi


def _ends(terms) -> tuple[np.ndarray, np.ndarray]:
    """The gram size and the first gram of each term."""
    names, begins, stops = _bytes(terms)
    sizes = _sizes(stops - begins)
    masks = np.array([int(_mask(s)) for s in range(9)[1:]], np.uint64)[sizes - 1]
    return sizes, grams(names)[begins] & masks


_BLOBS = "_part int, _chunk int, _blob binary"


def _blobs(rows: list[tuple[int, int | None, bytes]]) -> pa.Table:
    parts, chunks, blobs = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"_part": pa.array(parts, pa.int32()), "_chunk": pa.array(chunks, pa.int32()), "_blob": pa.array(blobs, pa.binary())})


def _chunk_grams(parts: int):
    """The different grams of the texts of one chunk, of every size, packed for each part."""

    def of(table: pa.Table) -> pa.Table:
        texts, chunk, rows = Texts(table.column("_text")), table.column("_chunk")[0].as_py(), []
        sizes, values = [], []
        for size in SIZES:
            values.append(np.unique(texts.here[texts.room >= size] & _mask(size)))
            sizes.append(np.full(len(values[-1]), size, np.int8))
        found, sizes = np.concatenate(values), np.concatenate(sizes)
        part = _part(found, parts)
        by_part = np.argsort(part, kind="stable")
        part, found, sizes = part[by_part], found[by_part], sizes[by_part]
        for value, lo, hi in _runs(part):
            rows.append((value, chunk, _packed(pa.table({"size": sizes[lo:hi], "gram": found[lo:hi]}))))
        return _blobs(rows)

    return of


def _gathered(tables: Iterator[pa.Table]) -> Iterator[pa.Table]:
    """The same rows in tables of ``PACK_BYTES`` or so."""
    held, room = [], 0
    for table in tables:
        held.append(table)
        room += table.nbytes
        if room >= PACK_BYTES:
            yield pa.concat_tables(held).combine_chunks()
            held, room = [], 0
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _packed_terms(parts: int):
    """Terms packed for each part, by size and first gram."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(pa.Table.from_batches([b]) for b in batches if b.num_rows):
            sizes, first = _ends(table.column("term"))
            part = _part(first, parts)
            order = np.lexsort((first, sizes, part))
            table = table.take(pa.array(order))
            yield from _blobs([(value, None, _packed(table.slice(lo, hi - lo))) for value, lo, hi in _runs(part[order])]).to_batches()

    return of


def _index(blobs: list[tuple[int, bytes]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each size the different grams, where the chunks of each begin, and the chunks."""
    opened = [(chunk, _opened(blob)) for chunk, blob in blobs]
    sizes, found = (np.concatenate([t.column(c).to_numpy() for _, t in opened]) for c in ("size", "gram"))
    chunks = np.concatenate([np.full(len(t), chunk, np.int32) for chunk, t in opened])
    index = {}
    for size in SIZES:
        some = np.nonzero(sizes == size)[0]
        some = some[np.argsort(found[some], kind="stable")]
        different, begins = np.unique(found[some], return_index=True)
        index[size] = different, np.append(begins, len(some)), chunks[some]
    return index


def _met(index, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of ``table``, chunk) where the chunk holds the first gram of the row's term."""
    sizes, first = _ends(table.column("term"))
    rows, chunks = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for size, (different, begins, held) in index.items():
        some = np.nonzero(sizes == size)[0]
        if len(some) and len(different):
            rank = np.minimum(np.searchsorted(different, first[some]), len(different) - 1)
            same = different[rank] == first[some]
            some, rank = some[same], rank[same]
            times = begins[rank + 1] - begins[rank]
            rows.append(np.repeat(some, times))
            chunks.append(held[np.repeat(begins[rank], times) + _counted(times)])
    return np.concatenate(rows), np.concatenate(chunks)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms packed for each chunk that holds their first gram; the grams of a part come before its terms."""

    def met(grams_of: list[tuple[int, bytes]], blobs: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        index = _index(grams_of) if grams_of else {}
        for table in _gathered(map(_opened, blobs)):
            rows, chunks = _met(index, table)
            by_chunk = np.argsort(chunks, kind="stable")
            rows, chunks = rows[by_chunk], chunks[by_chunk]
            for chunk, lo, hi in _runs(chunks):
                yield from _blobs([(0, chunk, _packed(table.take(pa.array(rows[lo:hi]))))]).to_batches()

    rows = (tuple(batch.column(i)[at].as_py() for i in range(3)) for batch in batches for at in range(batch.num_rows))
    for _, of_part in groupby(rows, key=lambda row: row[0]):
        grams_of, first = [], None
        for _, chunk, blob in of_part:
            if chunk is None:
                first = blob
                break
            grams_of.append((chunk, blob))
        if first is not None:
            yield from met(grams_of, chain([first], (blob for _, _, blob in of_part)))


def join_terms(texts: DataFrame, text: str, terms: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """As ``textsearch.find_terms``: rows of ``texts`` (without ``text``) joined to the ``terms`` that the lower-case text contains.

    Rows are dealt to chunks by all columns besides ``text``, so these should differ from row to row.
    """
    keys = [c for c in texts.columns if c != text]
    lowered = texts.filter(F.col(text) != "").select(*keys, F.lower(text).alias("_text"))
    held = lowered.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    chunks = max(texts.sparkSession.sparkContext.defaultParallelism, -(-held // chunk_bytes))
    dealt = lowered.withColumn("_chunk", F.pmod(F.xxhash64(*keys), F.lit(chunks)).cast("int"))

    # A chunk has its grams in every part, and a part the terms whose first grams are its own. There are as many parts as chunks.
    index = dealt.select("_chunk", "_text").groupBy("_chunk").applyInArrow(_chunk_grams(chunks), _BLOBS)
    listed = terms.filter("term <> ''").mapInArrow(_packed_terms(chunks), _BLOBS)
    parted = index.unionByName(listed).repartition(chunks, "_part").sortWithinPartitions("_part", F.col("_chunk").isNull())
    candidates = parted.mapInArrow(_candidates, _BLOBS).select("_chunk", "_blob")

    schema = T.StructType([*lowered.select(*keys).schema, *terms.schema])
    names = terms.columns
    large = texts.sparkSession.conf.get("spark.sql.execution.arrow.useLargeVarTypes") == "true"
    listed_fields = to_arrow_schema(terms.schema, prefers_large_types=large)

    def held_terms(some: pa.Table, packed: pa.Table) -> pa.Table:
        held, found = Texts(some.column("_text")), []
        columns = some.select(keys).combine_chunks()
        # Each blob gives a table of its own, which moves on as a batch of its own.
        for blob in packed.column("_blob"):
            listed = _opened(blob.as_py())
            row, term = held.find(listed.column("term"))
            left, right = columns.take(pa.array(row)), listed.select(names).take(pa.array(term))
            found.append(pa.Table.from_arrays([*left.columns, *right.columns], names=[*keys, *names]))
        return pa.concat_tables(found) if found else pa.schema([*columns.schema, *listed_fields]).empty_table()

    return dealt.groupBy("_chunk").cogroup(candidates.groupBy("_chunk")).applyInArrow(held_terms, schema)
