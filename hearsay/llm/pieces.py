"""Splitting text into the pieces that byte-level BPE encodes separately, and caching what a piece encodes to.

Texts are split many at a time with array operations over their code points. The
result is that of the pattern of the rank files (``public_tokenizers.PATTERN``),
whose character classes are tabulated once per worker from the pattern's own
``\\s``, ``\\p{L}`` and ``\\p{N}``; the tests compare both over all code points.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

SPACE, LETTER, NUMBER, OTHER = range(4)
BLANK, APOSTROPHE = 0x20, 0x27


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point."""
    every = "".join(map(chr, range(0x110000)))
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for name, value in ((r"\s", SPACE), (r"\p{L}", LETTER), (r"\p{N}", NUMBER)):
        for run in regex.finditer(f"{name}+", every):
            out[run.start():run.end()] = value
    return out


def split(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """All pieces of all texts in order, as bytes, and how many pieces each text has."""
    whole = "".join(texts)
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
    n = len(points)
    text_ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    first = np.zeros(n + 1, dtype=bool)  # where a text starts, and the end
    first[text_ends] = True
    first[0] = first[n] = True
    kind = np.append(classes()[points], OTHER)
    starts = first.copy()
    starts[1:n] |= kind[1:n] != kind[: n - 1]
    if n:
        # The last white space before something else stands alone, and a blank goes with what follows.
        last = np.nonzero((kind[:n] == SPACE) & (kind[1:] != SPACE) & ~first[1:])[0]
        starts[last] = True
        starts[last[points[last] == BLANK] + 1] = False
        # 's 't 'm 'd 're 've 'll at the start of a piece; what is left of the letters is a piece of its own.
        at = np.nonzero((points == APOSTROPHE) & starts[:n] & (kind[1:] == LETTER) & ~first[1:])[0]
        padded = np.append(points, [0, 0])
        one, two = padded[at + 1], padded[at + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        pair = np.isin(one * 256 + np.minimum(two, 255), [ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")])
        pair &= (one < 128) & (two < 128) & ~first[np.minimum(at + 2, n)]
        for some, size in ((at[short], 1), (at[pair], 2)):
            starts[some + 1] = False
            starts[some + 1 + size] = True
    begin = np.nonzero(starts[:n])[0]
    counts = np.diff(np.searchsorted(begin, np.concatenate(([0], text_ends))))
    size = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
    byte_at = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
    offsets = byte_at[np.append(begin, n)].astype(np.int32)
    data = whole.encode("utf-8", "surrogatepass")
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), counts


class PieceCoder:
    """Encodes texts piece by piece, each distinct piece once while the bounded cache holds it.

    ``encode_many`` maps a list of distinct pieces to their ids, flat, and the
    number of ids of each.
    """

    def __init__(self, encode_many: Callable, most_cached: int = 500_000):
        self.encode_many = encode_many
        self.most_cached = most_cached
        self.cache: dict[bytes, bytes] = {}

    def _encoded(self, distinct: list[bytes]) -> list[bytes]:
        missing = [p for p in distinct if p not in self.cache]
        if len(self.cache) + len(missing) > self.most_cached:
            self.cache = {}
            missing = distinct
        if missing:
            flat, counts = self.encode_many(missing)
            raw, at = flat.astype("<u4").tobytes(), 0
            for piece, n in zip(missing, (counts * 4).tolist(), strict=True):
                self.cache[piece] = raw[at:at + n]
                at += n
        return list(map(self.cache.__getitem__, distinct))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and where the ids of each text end."""
        parts, counts = split([t or "" for t in texts])
        flat = parts.dictionary_encode()
        coded = self._encoded(flat.dictionary.to_pylist())
        lengths = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        pool = np.frombuffer(b"".join(coded), "<u4")
        starts = np.cumsum(lengths) - lengths
        which = flat.indices.to_numpy(zero_copy_only=False)
        n = lengths[which]
        ends = np.cumsum(n)
        # Token t of a piece lies at the start of the piece + t.
        take = np.repeat(starts[which] - (ends - n), n)
        take += np.arange(len(take))
        return pool[take], np.concatenate(([0], ends))[np.cumsum(counts)]
