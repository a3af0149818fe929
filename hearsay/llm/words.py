"""Words by the rule [^\\x20\\x09-\\x0D]+, hashed many texts at a time, and hashes of runs of words.

A word is read in chunks of 8 bytes; each chunk is mixed with its place by a
nonlinear function and the results are summed, so no pattern of letters (as in a
polynomial, whose values for Thue-Morse words agree) makes different words alike.
The two lanes mix with constants of their own from the first byte on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Odd multipliers of the words of a run, and seeds of the chunks of a word, in either lane.
LANES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
SEEDS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344))
# What a last chunk of so many bytes keeps.
KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
# Runs up to this many words are sums of products; longer ones are mixed at each doubling.
PLAIN = 16
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

def finish(h: np.ndarray) -> np.ndarray:
    """Spread the low bits of a sum of products over the whole word."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def mixed(chunks: np.ndarray, place: np.ndarray, lane: int) -> np.ndarray:
    """Each chunk of 8 bytes with its place in the word, spread over 64 bits by two multiplications."""
    h = chunks ^ finish((place.astype(np.uint64) + np.uint64(1)) * LANES[lane] + SEEDS[lane])
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs(words: np.ndarray, size: int, lane: int = 0) -> np.ndarray:
    """A hash of each run of ``size`` words, by the place where it starts; built from runs of powers of two.

    ``words`` are hashes of the same lane.
    """
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    part, out, done, length = words, None, 0, 1
    while True:
        power = np.uint64(pow(int(LANES[lane]), length, 1 << 64))
        if size & length:
            piece = part[done:done + n]
            out = piece if out is None else out * power + piece
            if length >= PLAIN:
                out = finish(out)
            done += length
        if length * 2 > size:
            return finish(out)
        part = part[:-length] * power + part[length:]
        if length >= PLAIN:
            part = finish(part)
        length *= 2


@dataclass
class Words:
    """Word hashes of several texts, one after the other."""

    hashes: np.ndarray
    counts: np.ndarray  # words of each text
    other: np.ndarray | None = None  # the second lane, where it is asked for

    @property
    def text(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    @property
    def place(self) -> np.ndarray:
        """The place of each word within its text."""
        return np.arange(len(self.hashes)) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)

    def whole_runs(self, size: int, place: np.ndarray) -> np.ndarray:
        """The words where a run of ``size`` starts that its text holds whole; ``place`` as above."""
        last = np.repeat(self.counts, self.counts) - size
        return np.nonzero(place <= last)[0]


def hash_words(texts: list[bytes], lower: bool = False, both: bool = False) -> Words:
    """Hash all words of all texts; ``lower`` lower-cases A-Z first, ``both`` fills the second lane too."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n" * 9, np.uint8)
    if lower:
        raw = LOWER[raw]
    whole = len(raw) - 8
    space = IS_SPACE[raw[:whole]]
    edges = np.empty(whole, bool)
    edges[0] = not space[0]
    np.not_equal(space[1:], space[:-1], out=edges[1:])
    at = np.nonzero(edges)[0]
    starts, ends = at[::2], at[1::2]
    lengths = ends - starts
    eight = np.ndarray(whole, "<u8", raw, strides=(1,))  # the 8 bytes from each place on
    first = eight[starts] & KEEP[np.minimum(lengths, 8)]
    # Further chunks of long words, all words side by side.
    long = np.nonzero(lengths > 8)[0]
    more = (lengths[long] - 1) // 8
    begins = np.cumsum(more) - more
    place = np.arange(int(more.sum())) - np.repeat(begins, more) + 1
    of = np.repeat(long, more)
    rest = eight[starts[of] + 8 * place] & KEEP[np.minimum(lengths[of] - 8 * place, 8)]

    def lane(k: int) -> np.ndarray:
        sums = mixed(first, np.zeros(1, np.int64), k) + lengths.astype(np.uint64) * LANES[1 - k]
        if len(long):
            sums[long] += np.add.reduceat(mixed(rest, place, k), begins)
        return finish(sums)

    text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, text_ends))))
    return Words(lane(0), counts, lane(1) if both else None)


def text_values(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts as UTF-8 bytes; NULL as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
