"""Operator 1: byte-level BPE encoding and decoding by a rank file.

Method: a segment tree over the byte positions of a piece holds, in each node,
the leftmost position of the lowest rank among the pairs below it. The root
names the next merge; a merge changes the pair that starts at the merged token,
the pair before it and the pair it swallowed, each by a point update of
logarithmic cost. Short pieces, almost all of them, are merged side by side: one
numpy step does the next merge of every piece of equal tree width. Long pieces
use the same tree one at a time, so a run of n letters costs n log n.

Cases: NULL text is empty and gives no ids; so does empty text. Rows with equal
ids are encoded separately, a NULL id is passed on, empty tables give empty
results and further columns of the input are not read. A piece that is one token
of the vocabulary is that token.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm.common import slices
from hearsay.llm.pieces import PieceCoder

NONE = np.iinfo(np.int64).max
MIX = np.uint64(0x9E3779B97F4A7C15)


class Merges:
    """Ranks of pairs of tokens, in an open-addressed table that numpy probes for many pairs at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.mask = np.int64((1 << self.bits) - 1)
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, NONE, dtype=np.int64)
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        values = np.fromiter(pairs.values(), np.int64, len(pairs))
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == -1
            _, first = np.unique(slot, return_index=True)
            place = np.zeros(len(keys), bool)
            place[first] = True
            place &= free
            self.keys[slot[place]], self.values[slot[place]] = keys[place], values[place]
            keys, values, slot = keys[~place], values[~place], (slot[~place] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE if it does not merge."""
        keys = (left << 32) | right
        slot = self._slot(keys)
        out = np.full(len(keys), NONE, dtype=np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            here = self.keys[slot[open_]]
            hit = here == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (here != -1)]
            slot[open_] = (slot[open_] + 1) & self.mask
        return out

    def encode_side_by_side(self, raw: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of 2 to ``width`` bytes (a power of two): flat ids, and how many each piece has."""
        n = len(raw)
        lengths = np.fromiter(map(len, raw), np.int64, n)
        row = np.arange(n)
        live = np.arange(width) < lengths[:, None]
        ids = np.zeros((n, width + 1), dtype=np.int64)
        ids[:, :width][live] = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        after = np.tile(np.arange(1, width + 2), (n, 1))
        after[row, lengths - 1] = width
        before = np.tile(np.arange(-1, width), (n, 1))
        # A leaf holds rank * width + position, so the minimum is the leftmost of the lowest rank.
        tree = np.full((n, 2 * width), NONE, dtype=np.int64)
        at = np.nonzero(live[:, 1:])
        rank = self.look(ids[at[0], at[1]], ids[at[0], at[1] + 1])
        tree[at[0], width + at[1]] = np.where(rank == NONE, NONE, rank * width + at[1])
        for node in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])

        def point(rows: np.ndarray, position: np.ndarray, value: np.ndarray) -> None:
            node = position + width
            tree[rows, node] = value
            while width > 1 and node[0] > 1:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        while True:
            row = row[tree[row, 1] != NONE]
            if not len(row):
                break
            merged, position = np.divmod(tree[row, 1], width)
            swallowed = after[row, position]
            following = after[row, swallowed]
            ids[row, position] = merged
            after[row, position] = following
            before[row, following] = position
            live[row, swallowed] = False
            point(row, swallowed, np.full(len(row), NONE))
            rank = np.full(len(row), NONE)
            has = following < width
            rank[has] = self.look(merged[has], ids[row[has], following[has]])
            point(row, position, np.where(rank == NONE, NONE, rank * width + position))
            previous = before[row, position]
            has = previous >= 0
            if has.any():
                rows, previous = row[has], previous[has]
                rank = self.look(ids[rows, previous], merged[has])
                point(rows, previous, np.where(rank == NONE, NONE, rank * width + previous))
        return ids[:, :width][live], live.sum(axis=1)

    def encode_long(self, raw: bytes) -> list[int]:
        """Ids of one piece by the same tree, one merge at a time."""
        n = len(raw)
        width = 1 << max(1, (n - 1).bit_length())
        ids: list[int] = self.of_byte[np.frombuffer(raw, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        none, pairs = NONE, self.pairs
        tree = [none] * (2 * width)

        def leaf(i: int, j: int) -> int:
            rank = pairs.get(ids[i] << 32 | ids[j])
            return none if rank is None else rank * width + i

        for i in range(n - 1):
            tree[width + i] = leaf(i, i + 1)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def point(i: int, value: int) -> None:
            node = width + i
            tree[node] = value
            while node > 1:
                node >>= 1
                best = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == best:
                    break
                tree[node] = best

        while tree[1] != none:
            merged, i = divmod(tree[1], width)
            swallowed = after[i]
            following = after[swallowed]
            ids[i], ids[swallowed], after[i] = merged, -1, following
            point(swallowed, none)
            if following < n:
                before[following] = i
                point(i, leaf(i, following))
            else:
                point(i, none)
            if before[i] >= 0:
                point(before[i], leaf(before[i], i))
        return [x for x in ids if x >= 0]

    def encode_many(self, raw: list[bytes], widest: int = 64, rows: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, flat and in order, and the number of ids of each."""
        counts = np.zeros(len(raw), dtype=np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        by_width: dict[int, list[int]] = {}
        for i, r in enumerate(raw):
            whole = self.ranks.get(r)
            if whole is not None:
                by_width.setdefault(0, []).append(i)
            else:
                by_width.setdefault(1 << (len(r) - 1).bit_length(), []).append(i)
        for width, members in by_width.items():
            for at in range(0, len(members), rows):
                some = members[at:at + rows]
                if width == 0:
                    flat, n = np.array([self.ranks[raw[i]] for i in some], dtype=np.int64), np.ones(len(some), np.int64)
                elif width <= widest:
                    flat, n = self.encode_side_by_side([raw[i] for i in some], width)
                else:
                    each = [self.encode_long(raw[i]) for i in some]
                    flat, n = np.array([x for e in each for x in e], dtype=np.int64), np.array(list(map(len, each)))
                counts[some] = n
                found.append((np.array(some), flat, n))
        starts = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), dtype=np.uint32)
        for members, flat, n in found:
            out[np.arange(len(flat)) + np.repeat(starts[members] - (np.cumsum(n) - n), n)] = flat
        return out, counts


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}


@lru_cache(maxsize=4)
def coder(path: str) -> PieceCoder:
    """The encoder of this Python worker; later tasks of the worker find its cache filled."""
    return PieceCoder(Merges(load_ranks(path)).encode_many)


@lru_cache(maxsize=4)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all tokens, and where those of each token start and how many they are."""
    by_id = {rank: token for token, rank in load_ranks(path).items()}
    tokens = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
    sizes = np.array(list(map(len, tokens)), dtype=np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes, sizes


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ``ids``): the ids of the whole text as little-endian unsigned 32-bit integers.

    One narrow pass; nothing is shuffled. ``path`` must name the rank file on
    every worker.
    """
    rows = docs.select(id_col, text_col)
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = coder(path)
        for part in slices(batches, 1):
            ids, ends = mine.encode(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), ragged(ids, ends)], [id_col, "ids"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, ids binary")


def ragged(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One binary value per text, without a copy."""
    offsets = np.concatenate(([0], ends * 4)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4"))])


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """Add ``to``: the bytes that the ids stand for. NULL ids give no bytes."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + f", `{to}` binary"
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, starts, sizes = token_bytes(path)
        for part in slices(batches, at):
            texts = [x or b"" for x in part.column(at).to_pylist()]
            ids = np.frombuffer(b"".join(texts), "<u4")
            n = sizes[ids]
            ends = np.cumsum(n)
            take = np.repeat(starts[ids] - (ends - n), n)
            take += np.arange(len(take))
            text_ends = np.concatenate(([0], ends))[np.cumsum([len(t) // 4 for t in texts], dtype=np.int64)]
            offsets = np.concatenate(([0], text_ends)).astype(np.int32)
            out = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(pool[take])])
            yield pa.RecordBatch.from_arrays([*part.columns, out], [*part.schema.names, to])

    return encoded.mapInArrow(run, schema)
