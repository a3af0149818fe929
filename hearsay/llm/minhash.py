"""Operator 9: near-dedup by min-max hashing, with every link confirmed on full sets.

A document's set is its distinct shingles of ``shingle`` words, lower-cased A-Z.
Each of ``permutations`` hash functions gives two signature values, the smallest
and the largest, so half the evaluations give a signature of the same length;
``rows`` values make a band. A pair at similarity s shares no band with probability
(1 - s**rows) ** bands: about one in a million at 0.8 with the defaults.

Copies with equal sets are one class, found by a 128-bit digest of the sorted
set; only classes are compared. Then, in two steps:

1. In each bucket every class is paired with one class of the bucket, by a star in
   each task and a star over the tasks' centres, so a bucket of n costs n pairs.
   Pairs that sizes allow are confirmed on full sets; links give components.
2. A bucket whose classes lie in one component is done. In the others, every pair
   of classes of different components is still compared, in blocks of bounded size
   that keep a large component apart: first by size and by the share of equal
   signature values, an unbiased estimate of the similarity that has to reach the
   threshold less five standard deviations, then on full sets. Tasks emit only
   links; a chance of 3 in 10 million is all that one can be lost by.

Result: the smallest id that each document reaches, and whether it is that one.

Cases: NULL or empty text, or white space alone, gives an empty set, linked with
nothing. Fewer words than a shingle are one shingle, the whole sequence. Rows
without an id are linked with nothing and stay. Rows that repeat an id are one
document, linked by any of its rows, and share its answer. Empty tables give
empty results; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm.common import slices, staged
from hearsay.llm.components import components
from hearsay.llm.packs import unpack_ids
from hearsay.llm.substring_dedup import COMPARE, ENTRY, TELL, entries, groups
from hearsay.llm.words import Words, finish, hash_words, runs, text_values

BLOCK_CLASSES = 256


def shingles(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts in order, repeats included, and how many each text has."""
    words = hash_words(texts, lower=True)
    full = np.maximum(words.counts - size + 1, 0)
    at = words.whole_runs(size, words.place)
    hashes = np.zeros(int(full.sum() + ((words.counts > 0) & (full == 0)).sum()), np.uint64)
    counts = np.where(full > 0, full, (words.counts > 0).astype(np.int64))
    begins, word_begins = np.cumsum(counts) - counts, np.cumsum(words.counts) - words.counts
    where = np.repeat(begins - (np.cumsum(full) - full), full) + np.arange(int(full.sum()))
    hashes[where] = runs(words.hashes, size)[at]
    for row in np.nonzero((full == 0) & (words.counts > 0))[0]:
        n = int(words.counts[row])
        own = words.hashes[word_begins[row]:word_begins[row] + n]
        hashes[begins[row]] = finish(runs(own, n) + np.uint64(n))
    return hashes, counts


def multipliers(permutations: int, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**32, permutations, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, permutations, dtype=np.uint32)


def signature(hashes: np.ndarray, begins: np.ndarray, permutations: int) -> np.ndarray:
    """The smallest and largest value of each set under each permutation; ``begins`` are the starts of the sets, none empty."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(begins), 2 * permutations), np.uint32)
    for i, (a, b) in enumerate(zip(*multipliers(permutations), strict=True)):
        moved = low * a + b
        moved ^= moved >> np.uint32(15)
        out[:, 2 * i] = np.minimum.reduceat(moved, begins)
        out[:, 2 * i + 1] = np.maximum.reduceat(moved, begins)
    return out


def band_keys(values: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    keys = np.arange(bands, dtype=np.uint64)[None, :] + np.zeros((len(values), 1), np.uint64)
    for k in range(values.shape[1] // bands):
        # Values of one band come from different permutations.
        keys = finish(keys * np.uint64(0x9E3779B97F4A7C15) + values[:, k * bands:(k + 1) * bands].astype(np.uint64))
    return keys


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int, permutations: int, bands: int) -> DataFrame:
    """Rows (id, n, key, bands): size and digest of the set, and its band keys; NULL for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, 1, 1 << 20):
            hashes, counts = shingles(text_values(piece.column(1)), shingle)
            ends = np.cumsum(counts)
            sizes, digests = np.zeros(len(counts), np.int64), [None] * len(counts)
            filled = np.nonzero(counts)[0]
            for row in filled.tolist():
                own = np.unique(hashes[ends[row] - counts[row]:ends[row]])
                sizes[row] = len(own)
                digests[row] = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
            keys = [None] * len(counts)
            if len(filled):
                for row, own in zip(filled.tolist(), band_keys(signature(hashes, (ends - counts)[filled], permutations), bands), strict=True):
                    keys[row] = own.tobytes()
            arrays = [piece.column(0), pa.array(sizes), pa.array(digests, pa.binary()), pa.array(keys, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n", "key", "bands"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(run, "id long, n long, key binary, bands binary")


def stars(classes: DataFrame, parts: int, most: int = 1_000_000) -> DataFrame:
    """Rows (bucket, a, b): the classes of a bucket, each with the centre of its task or of all tasks."""

    def send(bands: list[bytes], labels: list[int]) -> Iterator[pa.RecordBatch]:
        per = len(bands[0]) // 8
        keys = np.frombuffer(b"".join(bands), "<u8")
        names = np.repeat(np.array(labels, np.int64), per)
        order = np.argsort(keys)
        keys, names = keys[order], names[order]
        first = np.nonzero(groups([keys]))[0]
        size = np.diff(np.append(first, len(keys)))
        centre = np.minimum.reduceat(names, first)
        by_name = np.argsort(centre)
        yield from entries(COMPARE, (keys[first] % np.uint64(parts)).astype(np.int64)[by_name], keys[first][by_name], centre[by_name], np.zeros(len(first), bool))
        of = np.repeat(centre, size)
        other = np.nonzero(names != of)[0]
        if len(other):
            # Known pairs: the bucket, then the class and its centre.
            yield from entries(TELL, (keys[other] % np.uint64(parts)).astype(np.int64), np.column_stack((keys[other], of[other].view(np.uint64))), names[other], np.zeros(len(other), bool))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands: list[bytes] = []
        labels: list[int] = []
        for batch in batches:
            bands += batch.column(1).to_pylist()
            labels += batch.column(0).to_pylist()
            if bands and len(bands) * len(bands[0]) // 8 >= most:
                yield from send(bands, labels)
                bands, labels = [], []
        if bands:
            yield from send(bands, labels)

    def meet(table: pa.Table) -> pa.Table:
        found, keys, names = [], [], []
        for kind, h, d in zip(*(table.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            if kind == TELL:
                both = np.frombuffer(h, "<u8").reshape(-1, 2)
                found.append((both[:, 0].view(np.int64), unpack_ids(d), both[:, 1].view(np.int64)))
            else:
                keys.append(np.frombuffer(h, "<u8"))
                names.append(unpack_ids(d))
        if keys:
            k, d = np.concatenate(keys), np.concatenate(names)
            order = np.argsort(k)
            k, d = k[order], d[order]
            first = np.nonzero(groups([k]))[0]
            centre = np.repeat(np.minimum.reduceat(d, first), np.diff(np.append(first, len(k))))
            other = d != centre
            found.append((k[other].view(np.int64), d[other], centre[other]))
        cells = [np.concatenate(c) for c in zip(*found, strict=True)]
        return pa.table([pa.array(c, pa.int64()) for c in cells], ["bucket", "a", "b"])

    return classes.select("label", "bands").mapInArrow(run, ENTRY).groupBy("part").applyInArrow(meet, "bucket long, a long, b long")


def sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """Rows (label, members): the sorted set of each document whose id is a ``label`` of ``wanted``."""
    rows = docs.select(F.col(id_col).cast("long").alias("label"), text_col).join(wanted.select("label"), "label", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, 1):
            hashes, counts = shingles(text_values(piece.column(1)), shingle)
            ends = np.cumsum(counts)
            members = [np.unique(hashes[e - c:e]).tobytes() for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(members, pa.binary())], ["label", "members"])

    return rows.mapInArrow(run, "label long, members binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= ``percent`` * union."""
    one = sets.select(F.col("label").alias("a"), F.col("members").alias("left"))
    two = sets.select(F.col("label").alias("b"), F.col("members").alias("right"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(left, "<u8"), np.frombuffer(right, "<u8")
                place = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
                common = int((y[place] == x).sum()) if len(y) else 0
                keep.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def sized(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes allow a link; ids that several rows share have a range of sizes."""
    a = sizes.select(F.col("label").alias("a"), F.col("least").alias("a_least"), F.col("most").alias("a_most"))
    b = sizes.select(F.col("label").alias("b"), F.col("least").alias("b_least"), F.col("most").alias("b_most"))
    allowed = (100 * F.col("a_most") >= percent * F.col("b_least")) & (100 * F.col("b_most") >= percent * F.col("a_least"))
    return pairs.join(a, "a").join(b, "b").filter(allowed).select("a", "b")


def left_over(
    star_rows: DataFrame, reached: DataFrame, sizes: DataFrame, sets: DataFrame, percent: int, permutations: int, block: int
) -> DataFrame:
    """Links between classes that share a bucket and lie in different components after the first step."""
    of = reached.select(F.col("node"), F.col("component"))
    a = star_rows.join(of.withColumnsRenamed({"node": "a", "component": "ca"}), "a", "left")
    both = a.join(of.withColumnsRenamed({"node": "b", "component": "cb"}), "b", "left")
    mixed = both.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("bucket").distinct()
    rows = star_rows.join(mixed, "bucket", "left_semi")
    members = rows.select("bucket", F.col("a").alias("label")).union(rows.select("bucket", F.col("b").alias("label"))).distinct()
    members = members.join(of.withColumnRenamed("node", "label"), "label", "left").withColumn("component", F.coalesce("component", "label"))
    members = staged(members.join(sizes, "label"), "mixed-buckets")
    # A component of over ``block`` classes in a bucket has blocks of its own; the others share blocks.
    per = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("classes"))
    small = per.filter(F.col("classes") <= block).groupBy("bucket").agg(F.sum("classes").alias("small"))
    counted = members.join(per, ["bucket", "component"]).join(small, "bucket", "left").withColumn("big", F.col("classes") > block)
    own = F.pmod(F.xxhash64("label"), F.ceil(F.col("classes") / block))
    shared = F.pmod(F.xxhash64("component"), F.ceil(F.col("small") / block))
    families = members.groupBy("bucket").agg(F.min("label").alias("family"))
    group = F.when(F.col("big"), F.struct("big", "component", own.alias("nth"))).otherwise(F.struct("big", F.lit(0).cast("long").alias("component"), shared.alias("nth")))
    placed = staged(counted.withColumn("block", group).select("bucket", "block", "label", "component", "least", "most"), "placed-classes")
    blocks = placed.select("bucket", "block").distinct()
    one, two = blocks.withColumnRenamed("block", "one"), blocks.withColumnRenamed("block", "two").withColumnRenamed("bucket", "bucket2")
    same = F.col("one.big") & F.col("two.big") & (F.col("one.component") == F.col("two.component"))
    cells = one.join(two, (F.col("bucket") == F.col("bucket2")) & (F.col("one") <= F.col("two")) & ~same)
    # Buckets of one family share the destinations of their cells, so a pair is mostly compared once.
    part = F.pmod(F.xxhash64("family", "one", "two"), F.lit(max(1, members.count() // 4_000 + 1)))
    cells = cells.join(families, "bucket").select("bucket", "one", "two", F.xxhash64("bucket", "one", "two").alias("cell"), part.alias("part"))
    sides = cells.select("bucket", F.col("one").alias("block"), "part", "cell", F.when(F.col("one") == F.col("two"), 2).otherwise(0).alias("side")).union(
        cells.filter("one <> two").select("bucket", F.col("two").alias("block"), "part", "cell", F.lit(1).alias("side"))
    )
    rows = staged(placed.join(sides, ["bucket", "block"]).select("part", "cell", "side", "label", "component", "least", "most"), "cells")
    needed = rows.select(F.col("part").alias("of_part"), F.col("label").alias("owner")).distinct()
    own_sets = needed.join(sets.filter(F.length("members") > 0), F.col("owner") == F.col("label")).select("of_part", "owner", "members")
    return rows.groupBy("part").cogroup(own_sets.groupBy("of_part")).applyInArrow(_compare_cells(percent, permutations), "a long, b long").distinct()


def _linked(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> bool:
    """Whether any set of one document has the similarity with any set of the other."""
    for x in left:
        for y in right:
            common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            if 100 * common >= percent * (len(x) + len(y) - common):
                return True
    return False


def _compare_cells(percent: int, permutations: int):
    similar, values = percent / 100, 2 * permutations
    least_equal = values * similar - 5 * np.sqrt(values * similar * (1 - similar))

    def run(table: pa.Table, own: pa.Table) -> pa.Table:
        none = pa.table([pa.array([], pa.int64())] * 2, ["a", "b"])
        if not table.num_rows or not own.num_rows:
            return none
        names = own.column("owner").to_numpy()
        members = [np.frombuffer(m, "<u8") for m in own.column("members").to_pylist()]
        sets_of_label: dict[int, list[np.ndarray]] = {}
        for name, m in zip(names.tolist(), members, strict=True):
            sets_of_label.setdefault(name, []).append(m)
        marks = np.empty((len(members), values), np.uint8)
        for at in range(0, len(members), 200):
            some = members[at:at + 200]
            ends = np.cumsum([len(m) for m in some])
            found = signature(np.concatenate(some), ends - [len(m) for m in some], permutations)
            marks[at:at + 200] = finish(found.astype(np.uint64)) & np.uint64(255)
        by_name = np.argsort(names, kind="stable")
        cell, side, label, component, least, most = (table.column(c).to_numpy() for c in ("cell", "side", "label", "component", "least", "most"))
        mark = by_name[np.searchsorted(names[by_name], label)]
        alone = np.array([len(sets_of_label[n]) == 1 for n in label.tolist()])
        order = np.lexsort((side, cell))
        bounds = np.concatenate(([0], np.nonzero(np.diff(cell[order]))[0] + 1, [len(order)]))
        one, two = [], []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            rows = order[lo:hi]
            left = rows[side[rows] != 1]
            right = rows if len(left) == len(rows) else rows[side[rows] == 1]
            for x in left.tolist():
                y = right[component[right] != component[x]]
                y = y[(100 * most[y] >= percent * least[x]) & (100 * most[x] >= percent * least[y])]
                if len(y):
                    # An id with several sets is compared on full sets at once.
                    y = y[((marks[mark[y]] == marks[mark[x]]).sum(axis=1) >= least_equal) | ~alone[y] | ~alone[x]]
                one.append(np.maximum(label[y], label[x]))
                two.append(np.minimum(label[y], label[x]))
        pairs = np.unique(np.column_stack((np.concatenate(one), np.concatenate(two))), axis=0)
        keep = [_linked(sets_of_label[a], sets_of_label[b], percent) for a, b in pairs.tolist()]
        pairs = pairs[np.array(keep, bool)]
        return pa.table([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], ["a", "b"])

    return run


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80,
    permutations: int = 135, bands: int = 45, block: int = BLOCK_CLASSES, parts: int | None = None,
) -> DataFrame:
    """One row per input row: (id, ``n_shingles``, ``component_id``, ``kept``)."""
    if 2 * permutations % bands:
        raise ValueError("bands must divide the signature")
    signed = staged(signatures(docs, id_col, text_col, shingle, permutations, bands), "signatures")
    linkable = signed.filter(F.col("key").isNotNull() & F.col("id").isNotNull())
    classes = staged(linkable.groupBy("key", "n", "bands").agg(F.min("id").alias("label")), "classes")
    if parts is None:
        parts = max(1, classes.count() * bands // 500_000 + 1)
    star_rows = staged(stars(classes, parts), "stars")
    sizes = classes.groupBy("label").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    pairs = staged(sized(star_rows.select("a", "b").distinct(), sizes, percent), "star-pairs")
    wanted = star_rows.select(F.col("a").alias("label")).union(star_rows.select(F.col("b").alias("label"))).distinct()
    sets = staged(sets_of(docs, wanted, id_col, text_col, shingle), "sets")
    links = staged(confirm(pairs, sets, percent), "links")
    reached = components(links)
    further = staged(left_over(star_rows, reached, sizes, sets, percent, permutations, block), "links")
    if not further.isEmpty():
        reached = components(links.union(further))
    # Rows of one id in several classes join those classes through the id itself.
    by_key = classes.select("key", "label").join(reached.withColumnRenamed("node", "label"), "label", "left")
    by_key = by_key.select("key", F.coalesce("component", "label").alias("component"))
    found = signed.select("id", "n", "key").join(by_key, "key", "left")
    component = F.when(F.col("id").isNull(), None).otherwise(F.coalesce("component", "id"))
    return found.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )
