"""Operator 3: dedup of shared passages by difference-cover anchors.

A window is ``size`` consecutive words of one document. A word goes when a
window over it also starts in a document with a smaller id; all windows are
judged on the input.

Method: word positions p with p mod 7 in the difference cover {0, 1, 3} are
anchors; each is hashed as a run of ``size`` - 6 words. For any two places of
equal windows there is a shift below 7 that puts both on cover positions, so
equal windows always share an anchor run, with under half the positions hashed.
Anchors that two documents share are told to their documents; there the match is
extended: the windows over a shared anchor are hashed whole, and the smallest
document of each window hash decides. A window is compared by 64 bits and by the
destination that another hash chose, whose number follows the input.

Every exchange moves packed rows. Before each, a task keeps one entry for a hash
however often its own documents repeat it, and tells those documents itself; so a
passage in a third of all documents is one entry per task. What meets is bounded
by the number of destinations. Texts travel compressed, by id, to meet their
notices: once to extend, once to cut.

Cases: NULL and empty text have no words. Rows without an id lose nothing and
cost others nothing. Rows that repeat an id are one document: they never cost
each other words. Texts under ``size`` words stay. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hearsay.llm.common import slices
from hearsay.llm.packs import count_parts, cut, pack_ids, packed_rows, part_of, unpack_ids, unpacked
from hearsay.llm.words import Words, finish, hash_words, runs, text_values

PERIOD = 7
COVER = np.array([True, True, False, True, False, False, False])  # {0, 1, 3}: every difference modulo 7 occurs
COMPARE, TELL = 0, 1
ENTRY = "part long, kind int, hashes binary, docs binary, told binary"


def anchors(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The words where anchors start, in documents that hold a window, and the hashes of the anchors."""
    length = size - PERIOD + 1
    place = words.place
    at = words.whole_runs(length, place)
    at = at[COVER[place[at] % PERIOD] & (np.repeat(words.counts, words.counts)[at] >= size)]
    return at, runs(words.hashes, length)[at]


def entries(kind: int, parts: np.ndarray, hashes: np.ndarray, docs: np.ndarray, told: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per destination."""
    order, spans = cut(parts)
    found = [
        (part, kind, hashes[order[s]].tobytes(), pack_ids(docs[order[s]]), np.packbits(told[order[s]]).tobytes()) for part, s in spans
    ]
    for at in range(0, len(found), 64):
        cells = list(zip(*found[at:at + 64], strict=True))
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], ["part", "kind", "hashes", "docs", "told"])


def groups(keys: list[np.ndarray]) -> np.ndarray:
    """Whether each row of sorted keys differs from the row before."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = False
        for key in keys:
            new[1:] |= key[1:] != key[:-1]
    return new


def anchor_entries(docs: DataFrame, id_col: str, text_col: str, size: int, parts: int, most: int = 1_500_000) -> DataFrame:
    """Anchors to compare, and notices for those that a task has already seen in two documents."""

    def send(hashes: list[np.ndarray], ids: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h, d = np.concatenate(hashes), np.concatenate(ids)
        order = np.argsort(h)
        h, d = h[order], d[order]
        first = np.nonzero(groups([h]))[0]
        least = np.minimum.reduceat(d, first)
        many = least != np.maximum.reduceat(d, first)
        seen = np.repeat(many, np.diff(np.append(first, len(h))))
        low = h.astype("<u4")
        # Entries go by document, so that differences of ids are small.
        by_doc = np.argsort(least)
        first, least, many = first[by_doc], least[by_doc], many[by_doc]
        yield from entries(COMPARE, ((h[first] >> np.uint64(32)) % np.uint64(parts)).astype(np.int64), low[first], least, many)
        low, d = low[seen], d[seen]
        by_doc = np.argsort(d)
        low, d = low[by_doc], d[by_doc]
        yield from entries(TELL, part_of(d, parts), low, d, np.ones(len(d), bool))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ids, held = [], [], 0
        for piece in slices(batches, 1):
            piece = piece.filter(piece.column(0).is_valid())
            words = hash_words(text_values(piece.column(1)))
            at, found = anchors(words, size)
            hashes.append(found)
            ids.append(piece.column(0).to_numpy(zero_copy_only=False)[words.text[at]])
            held += len(found)
            if held >= most:
                yield from send(hashes, ids)
                hashes, ids, held = [], [], 0
        if held:
            yield from send(hashes, ids)

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, ENTRY)


def told(entry_rows: DataFrame, parts: int, by_smallest: bool) -> DataFrame:
    """Notices (part of the document, hashes, docs) of the entries that have an equal one.

    ``by_smallest``: only documents above the smallest of a hash hear of it;
    otherwise all but those that know.
    """
    width = "<u8" if by_smallest else "<u4"

    def run(table: pa.Table) -> pa.Table:
        found = []
        hashes, docs, known = [], [], []
        for kind, h, d, t in zip(*(table.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
            ids = unpack_ids(d)
            if kind == TELL:
                found.append((np.frombuffer(h, width), ids))
            else:
                hashes.append(np.frombuffer(h, width))
                docs.append(ids)
                known.append(np.unpackbits(np.frombuffer(t, np.uint8), count=len(ids)).astype(bool))
        if hashes:
            h, d, k = np.concatenate(hashes), np.concatenate(docs), np.concatenate(known)
            order = np.argsort(h)
            h, d, k = h[order], d[order], k[order]
            first = np.nonzero(groups([h]))[0]
            size = np.diff(np.append(first, len(h)))
            if by_smallest:
                hear = d > np.repeat(np.minimum.reduceat(d, first), size) if len(h) else k
            else:
                hear = np.repeat(size > 1, size) & ~k
            found.append((h[hear], d[hear]))
        out = []
        if found:
            h, d = (np.concatenate(x) for x in zip(*found, strict=True))
            by_doc = np.argsort(d, kind="stable")
            h, d = h[by_doc], d[by_doc]
            order, spans = cut(part_of(d, parts))
            out = [(part, h[order[s]].tobytes(), pack_ids(d[order[s]])) for part, s in spans]
        cells = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.table([pa.array(c, k) for c, k in zip(cells, (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["part", "hashes", "docs"])

    return entry_rows.groupBy("part").applyInArrow(run, "part long, hashes binary, docs binary")


def pair(hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """One value for a hash and its document."""
    return finish(finish(docs.astype(np.int64).view(np.uint64) + np.uint64(1)) + hashes.astype(np.uint64))


def pairs(table: pa.Table, width: str) -> np.ndarray:
    """The (hash, document) pairs of notices. A chance equality only adds a window to compare."""
    each = [pair(np.frombuffer(h, width), unpack_ids(d)) for h, d in zip(*(table.column(c).to_pylist() for c in ("hashes", "docs")), strict=True)]
    return np.concatenate(each) if each else np.zeros(0, np.uint64)


def notices(table: pa.Table, width: str) -> dict[int, np.ndarray]:
    """Hashes that each document heard of."""
    if not table.num_rows:
        return {}
    h = np.concatenate([np.frombuffer(x, width) for x in table.column("hashes").to_pylist()])
    d = np.concatenate([unpack_ids(x) for x in table.column("docs").to_pylist()])
    order = np.argsort(d, kind="stable")
    h, d = h[order], d[order]
    head = np.nonzero(groups([d]))[0]
    return dict(zip(d[head].tolist(), np.split(h, head[1:]), strict=True)) if len(d) else {}


def window_entries(rows: DataFrame, shared: DataFrame, id_col: str, text_col: str, size: int, parts: int) -> DataFrame:
    """Extend: the windows over shared anchors, to compare or, where the task already knows, to tell."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        heard = pairs(right, "<u4")
        one, two, ids = [], [], []
        for table in unpacked(left.column("rows")) if len(heard) else ():
            table = table.filter(table.column(id_col).is_valid())
            names = table.column(id_col).cast(pa.int64()).to_numpy()
            words = hash_words(text_values(table.column(text_col)), both=True)
            at, found = anchors(words, size)
            at = at[np.isin(pair(found.astype("<u4"), names[words.text[at]]), heard)]
            # A window lies over an anchor if it starts up to 6 words before it; its text must hold it whole.
            change = np.zeros(len(words.hashes) + 1, np.int64)
            place = words.place
            np.add.at(change, at - np.minimum(place[at], PERIOD - 1), 1)
            np.add.at(change, at + 1, -1)
            fits = words.whole_runs(size, place)
            over = fits[np.cumsum(change)[fits] > 0]
            one.append(runs(words.hashes, size)[over])
            two.append(runs(words.other, size, 1)[over])
            ids.append(names[words.text[over]])
        batches = []
        if one:
            a, b, d = np.concatenate(one), np.concatenate(two), np.concatenate(ids)
            order = np.argsort(a)
            a, b, d = a[order], b[order], d[order]
            first = np.nonzero(groups([a, b]))[0]
            least = np.minimum.reduceat(d, first) if len(d) else d
            later = d > np.repeat(least, np.diff(np.append(first, len(d))))
            by_doc = np.argsort(least)
            first, least = first[by_doc], least[by_doc]
            batches += entries(COMPARE, (b[first] % np.uint64(parts)).astype(np.int64), a[first], least, np.zeros(len(first), bool))
            a, d = a[later], d[later]
            by_doc = np.argsort(d)
            a, d = a[by_doc], d[by_doc]
            batches += entries(TELL, part_of(d, parts), a, d, np.zeros(len(d), bool))
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        empty = pa.schema(zip(("part", "kind", "hashes", "docs", "told"), kinds, strict=True))
        return pa.Table.from_batches(batches, schema=empty)

    return rows.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(run, ENTRY)


def cut_rows(rows: DataFrame, gone: DataFrame, schema: T.StructType, id_col: str, text_col: str, size: int) -> DataFrame:
    """Cut covered words: input columns, then the number of words, how many are removed, and the kept ones joined by one space."""
    empty = to_arrow_schema(schema).empty_table()
    columns, added = schema.names[:-3], schema.names[-3:]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        heard = notices(right, "<u8")
        out = []
        for table in unpacked(left.column("rows")):
            texts, names = text_values(table.column(text_col)), table.column(id_col).to_pylist()
            n_words, n_removed, kept = [], [], []
            for doc, text in zip(names, texts, strict=True):
                words = text.split()
                n_words.append(len(words))
                removed = 0
                if doc in heard and len(words) >= size:
                    starts = np.nonzero(np.isin(runs(hash_words([text]).hashes, size), heard[doc]))[0]
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, starts, 1)
                    np.add.at(change, starts + size, -1)
                    covered = np.cumsum(change)[:-1] > 0
                    removed = int(covered.sum())
                    words = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
                n_removed.append(removed)
                kept.append(b" ".join(words))
            more = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            arrays = [table.column(c) for c in columns] + [pa.chunked_array([m]) for m in more]
            out.append(pa.table(arrays, [*columns, *added]))
        return pa.concat_tables(out) if out else empty

    return rows.groupBy("part").cogroup(gone.groupBy("part")).applyInArrow(run, schema)


def remove_shared(
    docs: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (),
    names: tuple[str, str, str] = ("n_words", "n_removed", "kept"), part_bytes: int = 8 << 20,
) -> DataFrame:
    """Rows (id, *carry, *names) for all rows of ``docs``: words, words removed, and the kept words joined by one space.

    ``size`` is 13 or another number from 8; ``names`` must differ from the carried columns.
    """
    if size <= PERIOD:
        raise ValueError(f"windows need more than {PERIOD} words")
    parts = count_parts(docs, text_col, part_bytes)
    ids_and_texts = docs.select(id_col, text_col)
    shared = told(anchor_entries(docs, id_col, text_col, size, parts), parts, by_smallest=False)
    gone = told(window_entries(packed_rows(ids_and_texts, id_col, parts), shared, id_col, text_col, size, parts), parts, by_smallest=True)
    columns = list(dict.fromkeys([id_col, *carry]))
    whole = docs.select(*dict.fromkeys([*columns, text_col]))
    schema = docs.select(*columns).schema
    for name, kind in zip(names, (T.LongType(), T.LongType(), T.StringType()), strict=True):
        schema = schema.add(name, kind)
    return cut_rows(packed_rows(whole, id_col, parts), gone, schema, id_col, text_col, size)
