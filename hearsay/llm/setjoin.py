"""Operator 11: a set-similarity self join on word n-grams, exact, by set relations on two levels.

A document's set is its distinct shingles of ``shingle`` words, lower-cased A-Z. Sets link when
100 * intersection >= ``percent`` * union; the result is the smallest id that each document reaches by links.

Copies with equal sets are one class, named by 64 bits of a digest of the sorted set. All shingles
have one order, rare ones first: by the rank of a count over ``BUCKETS`` hash buckets, a table of fixed size, then by
hash. Two sets that link share a shingle among the first n - ceil(percent * n / 100) + 1 of each, so only these go to
the index, with their positions. Three steps follow.

1. In each index list every class is paired with one class of the list, by a star in each task and a star over
   the tasks' centres: a list of n costs n pairs. Pairs that size, position and parity bitmaps allow are
   compared on full sets; two bitmaps never differ in more bits than their sets in elements. A class and those linked to it are a family, its head being the centre.
2. Index level. Lists that still hold different components are cut into blocks by size and by position; two
   blocks are skipped whole if no two sets of such sizes and positions can link. In the others, families are compared by their heads:
   sizes, positions and bitmaps must leave room for a link of any two members. No pair that links is lost, as each filter is a bound.
3. Answer level. For the pairs of families that stay, the overlap of the heads is counted once; a member's overlap is derived
   from it by what the member has more and less than its head. Where the change is
   too small to matter no member is looked at. Families meet in chunks of bounded size; one link joins two components.

Cases: NULL or empty text, or white space alone, gives an empty set, linked with nothing. Fewer words than
a shingle are one shingle, the whole sequence. Very long texts are read whole. Rows without an id are linked with nothing and have no component.
Rows that repeat an id are one document: what links one of them links all that are not empty. Equal sets are ties: all get the smallest id.
Empty tables give empty results; further columns are not read. Different sets of one name, at a chance of n**2 / 2**65 for n classes, would be taken for equal.
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
from hearsay.llm.minhash import confirm, shingles
from hearsay.llm.packs import cut
from hearsay.llm.substring_dedup import groups
from hearsay.llm.words import finish, text_values

BITS = 20
BUCKETS = 1 << BITS
COUNTS = 4096  # counts in a row of the table
MARK_BITS = 512
FILTER_BITS = 1 << 25
ENTRY = np.dtype([("token", "<u8"), ("name", "<i8"), ("n", "<i4"), ("p", "<i4")])
PAIR = np.dtype([("token", "<u8"), ("a", "<i8"), ("b", "<i8"), ("na", "<i4"), ("nb", "<i4"), ("pa", "<i4"), ("pb", "<i4")])
STARS = "token long, a long, b long, na int, nb int, pa int, pb int"


def own_sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """The sorted set of each text."""
    hashes, counts = shingles(texts, shingle)
    ends = np.cumsum(counts)
    return [np.unique(hashes[e - c:e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]


def name_of(members: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(members.tobytes(), digest_size=8).digest(), "little", signed=True)


def least_overlap(n, m, percent: int):
    """The smallest overlap at which sets of ``n`` and ``m`` elements link."""
    return -(-percent * (n + m) // (100 + percent))


def prefix(n, percent: int):
    """How many of the first elements can be the first that two linked sets share."""
    return n + percent * n // -100 + 1


def read_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """Rows (id, n, name, marks) for all documents; and rows (block, counts) of bucket counts, one of each block a task."""
    columns = ["id", "n", "name", "marks", "block", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for piece in slices(batches, 1, 1 << 20):
            sets = own_sets(text_values(piece.column(1)), shingle)
            sizes = [len(s) for s in sets]
            if sum(sizes):
                counts += np.bincount((np.concatenate(sets) >> np.uint64(64 - BITS)).astype(np.int64), minlength=BUCKETS)
            nothing = pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())
            names = pa.array([name_of(s) if len(s) else None for s in sets], pa.int64())
            marks = pa.array([marks_of(s) if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(sizes, pa.int64()), names, marks, *nothing], columns)
        some = [k for k in range(BUCKETS // COUNTS) if counts[k * COUNTS:(k + 1) * COUNTS].any()]
        bodies = [counts[k * COUNTS:(k + 1) * COUNTS].tobytes() for k in some]
        nothing = [*[pa.nulls(len(some), pa.int64())] * 3, pa.nulls(len(some), pa.binary())]
        yield pa.RecordBatch.from_arrays([*nothing, pa.array(some, pa.int32()), pa.array(bodies, pa.binary())], columns)

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "id long, n long, name long, marks binary, block int, counts binary")


def bucket_ranks(read: DataFrame) -> np.ndarray:
    """The rank of each bucket by its count, in 16 bits: a table of fixed size, whatever the input."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[k] = held.get(k, 0) + np.frombuffer(body, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["block", "counts"])

    parts = read.filter("block IS NOT NULL").select("block", "counts").repartition(F.col("block")).mapInArrow(add, "block int, counts binary")
    counts = np.zeros(BUCKETS, np.int64)
    for row in parts.collect():
        counts[row["block"] * COUNTS:(row["block"] + 1) * COUNTS] = np.frombuffer(row["counts"], "<i8")
    # Equal counts have equal ranks, so that ranks follow counts and nothing else.
    _, rank = np.unique(counts, return_inverse=True)
    return np.minimum(rank * 65535 // max(1, int(rank.max())), 65535).astype(np.uint16)


def star(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centres of the lists in ``found`` (ENTRY), and the pairs of all others with them."""
    found = found[np.lexsort((found["name"], found["token"]))]
    found = found[groups([found["token"], found["name"]])]
    first = np.nonzero(groups([found["token"]]))[0]
    centre = np.repeat(first, np.diff(np.append(first, len(found))))
    other = np.nonzero(centre != np.arange(len(found)))[0]
    pairs = np.empty(len(other), PAIR)
    for column, of, rows in (("token", "token", other), ("a", "name", other), ("na", "n", other), ("pa", "p", other), ("b", "name", centre[other]), ("nb", "n", centre[other]), ("pb", "p", centre[other])):
        pairs[column] = found[of][rows]
    return found[first], pairs


def pair_columns(pairs: np.ndarray) -> pa.RecordBatch:
    columns = [np.ascontiguousarray(pairs[c]) for c in PAIR.names]
    return pa.RecordBatch.from_arrays([pa.array(columns[0].view(np.int64)), *map(pa.array, columns[1:])], list(PAIR.names))


def index_stars(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, ranks: np.ndarray, parts: int, most: int = 1_000_000) -> DataFrame:
    """Rows STARS: the classes of each list of the prefix index with a centre, sizes and positions."""

    def send(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        centres, pairs = star(np.concatenate(held))
        order, spans = cut(((centres["token"] >> np.uint64(32)) % np.uint64(parts)).astype(np.int64))
        bodies = [(part, centres[order[s]].tobytes()) for part, s in spans]
        # Pairs known already need not meet anything: they are written as they are.
        bodies += [(-1, pairs[at:at + 65_536].tobytes()) for at in range(0, len(pairs), 65_536)]
        for at in range(0, len(bodies), 64):
            where, what = zip(*bodies[at:at + 64], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array(what, pa.binary())], ["part", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for piece in slices(batches, 1, 1 << 20):
            for members in own_sets(text_values(piece.column(1)), shingle):
                if not len(members):
                    continue
                n = len(members)
                length = prefix(n, percent)
                # Members come in the order of their hashes; a stable sort by rank keeps that order among equals.
                own = np.empty(length, ENTRY)
                own["token"] = members[np.argsort(ranks[(members >> np.uint64(64 - BITS)).astype(np.int64)], kind="stable")[:length]]
                own["name"], own["n"], own["p"] = name_of(members), n, np.arange(length)
                held.append(own)
                size += length
                if size >= most:
                    yield from send(held)
                    held, size = [], 0
        if held:
            yield from send(held)

    def meet(table: pa.Table) -> pa.Table:
        found = np.concatenate([np.frombuffer(b, ENTRY) for b in table.column("body").to_pylist()])
        return pa.Table.from_batches([pair_columns(star(found)[1])])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0).to_pylist():
                yield pair_columns(np.frombuffer(body, PAIR))

    with_id = docs.filter(F.col(id_col).isNotNull()).select(id_col, text_col)
    sent = staged(with_id.mapInArrow(run, "part long, body binary"), "join-index")
    return sent.filter("part >= 0").groupBy("part").applyInArrow(meet, STARS).union(sent.filter("part < 0").select("body").mapInArrow(unpack, STARS))


def marks_of(members: np.ndarray) -> bytes:
    """A parity bitmap: two sets differ in at least as many elements as their bitmaps in bits."""
    return np.packbits(np.bincount((finish(members) % np.uint64(MARK_BITS)).astype(np.int64), minlength=MARK_BITS) & 1).tobytes()


def bits_of(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size, whatever the input: the bit of each ``id`` is set, and of few others as long as ids are fewer than bits."""
    place = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)) + 1  # buckets count from 1, as their numbers do
    blocks = ids.select(place.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in blocks.collect():
        out[(row["block"] - 1) * 4096:row["block"] * 4096] = np.frombuffer(row["bits"], np.uint8)
    return out


def sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """Rows (label, members) for the classes of ``wanted`` (name, id): the set of one document of each.

    Texts stay where they are: a bitmap of the wanted ids tells which may be read, and
    only their sets travel.
    """
    bits = bits_of(wanted)
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).alias("bit")
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text_col).select("id", text_col, bit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy()
            some = batch.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            for piece in slices([some], 1):
                sets = own_sets(text_values(piece.column(1)), shingle)
                full = [k for k, s in enumerate(sets) if len(s)]
                arrays = [pa.array([name_of(sets[k]) for k in full], pa.int64()), pa.array([sets[k].tobytes() for k in full], pa.binary())]
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(full, pa.int64())), *arrays], ["id", "name", "members"])

    # Another row of the id may hold another text; rows that repeat both give one set.
    found = rows.mapInArrow(run, "id long, name long, members binary").join(wanted, ["id", "name"])
    return found.groupBy(F.col("name").alias("label")).agg(F.first("members").alias("members"))


def may_link(stars: DataFrame, percent: int) -> DataFrame:
    """Pairs of a list that size and position leave room for."""
    sizes = (100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na"))
    rest = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    return stars.filter(sizes & ((100 + percent) * rest >= percent * (F.col("na") + F.col("nb"))))


def near_marks(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose bitmaps differ in no more bits than linked sets of their sizes may differ in elements."""
    one, two = (classes.select(F.col("name").alias(c), F.col("n").alias(f"n{c}"), F.col("marks").alias(f"m{c}")) for c in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u8").reshape(batch.num_rows, -1) for c in ("ma", "mb")]
            sizes = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            near = (100 + percent) * np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1).astype(np.int64) <= (100 - percent) * sizes
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return pairs.join(one, "a").join(two, "b").mapInArrow(run, "a long, b long")


def families(links: DataFrame) -> DataFrame:
    """Rows (name, head, component) for all classes of ``links`` (a, b): b is the head if it has none itself."""
    heads = links.join(links.select(F.col("a").alias("b")).distinct(), "b", "left_anti").groupBy("a").agg(F.min("b").alias("head"))
    reached = components(links)
    return reached.join(heads, F.col("node") == F.col("a"), "left").select(F.col("node").alias("name"), F.coalesce("head", "node").alias("head"), "component")


def open_pairs(stars: DataFrame, of: DataFrame, classes: DataFrame, percent: int, block: int, part_rows: int) -> DataFrame:
    """Distinct pairs (x, z) of heads of families in different components that may hold a link: the index level."""
    # A list of one pair has been compared whole; the others move once by their token, as entries, and once by name.
    several = stars.groupBy("token").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("token")
    sides = [F.struct(F.col(s).alias("name"), F.col(f"n{s}").alias("n"), F.col(f"p{s}").alias("p")) for s in "ab"]
    ends = stars.join(several, "token", "left_semi").select("token", F.inline(F.array(*sides))).distinct()
    known = staged(ends.join(of, "name", "left").select(
        "token", "name", "n", "p", F.coalesce("head", "name").alias("head"), F.coalesce("component", "name").alias("component")), "join-known")
    mixed = known.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("token")
    heads = classes.select(F.col("name").alias("head"), F.col("n").alias("head_n"), "marks")
    entries = known.join(mixed, "token", "left_semi").join(heads, "head")
    away = F.when(F.col("name") == F.col("head"), 0).otherwise(F.col("n") + F.col("head_n"))
    inside = staged(entries.groupBy("token", "head", "component", "marks").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("p")).alias("rest"), F.max(away).alias("away")
    ), "join-families")
    size_class = F.floor(F.log(F.col("least").cast("double")) / float(np.log(100 / percent) if percent < 100 else 1.0)).cast("int")
    place_class = F.floor(F.log2((F.col("most") - F.col("rest") + 1).cast("double"))).cast("int")
    classed = inside.withColumns({"size": size_class, "place": place_class})
    per = classed.groupBy("token", "size", "place").agg(
        F.ceil(F.count(F.lit(1)) / block).cast("long").alias("cuts"), F.min("least").alias("bl"), F.max("most").alias("bm"), F.max("rest").alias("br")
    )
    placed = staged(classed.join(per.select("token", "size", "place", "cuts"), ["token", "size", "place"]).withColumn("nth", F.pmod(F.xxhash64("head"), F.col("cuts"))).drop("cuts"), "join-placed")
    blocks = per.select("*", F.explode(F.expr("sequence(0L, cuts - 1)")).alias("nth")).select("token", F.struct("size", "place", "nth").alias("one"), "bl", "bm", "br")
    others = blocks.select("token", F.col("one").alias("two"), F.col("bl").alias("cl"), F.col("bm").alias("cm"), F.col("br").alias("cr"))
    sizes = (100 * F.col("bm") >= percent * F.col("cl")) & (100 * F.col("cm") >= percent * F.col("bl"))
    room = (100 + percent) * F.least("br", "cr") >= percent * (F.col("bl") + F.col("cl"))
    cells = staged(blocks.join(others, "token").filter((F.col("one") <= F.col("two")) & sizes & room).select("token", "one", "two", F.xxhash64("token", "one", "two").alias("cell")), "join-cells")
    same = F.col("one") == F.col("two")
    which = cells.select("token", F.col("one").alias("block"), "cell", F.when(same, 2).otherwise(0).alias("side")).union(
        cells.filter(~same).select("token", F.col("two").alias("block"), "cell", F.lit(1).alias("side"))
    ).select("token", "block.*", "cell", "side")
    dealt = placed.join(which, ["token", "size", "place", "nth"]).select("cell", "side", "head", "component", "marks", "least", "most", "rest", "away")
    dealt = staged(dealt, "join-dealt")
    parts = max(1, dealt.count() // part_rows + 1)

    def run(table: pa.Table) -> pa.Table:
        cell, side, head, component, least, most, rest, away = (table.column(c).to_numpy() for c in ("cell", "side", "head", "component", "least", "most", "rest", "away"))
        bits = np.frombuffer(b"".join(table.column("marks").to_pylist()), "<u8").reshape(len(cell), MARK_BITS // 64)
        order = np.lexsort((side, cell))
        bounds = np.concatenate(([0], np.nonzero(np.diff(cell[order]))[0] + 1, [len(order)]))
        found = []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            rows = order[lo:hi]
            left = rows[side[rows] != 1]
            right = rows[side[rows] != 0]
            for x in left.tolist():
                y = right[component[right] != component[x]]
                y = y[(100 * most[y] >= percent * least[x]) & (100 * most[x] >= percent * least[y])]
                y = y[(100 + percent) * np.minimum(rest[y], rest[x]) >= percent * (least[y] + least[x])]
                if len(y):
                    # Two members link, and each lies within a link of its head.
                    far = (100 - percent) * (most[y] + most[x] + away[y] + away[x])
                    y = y[(100 + percent) * np.bitwise_count(bits[y] ^ bits[x]).sum(axis=1).astype(np.int64) <= far]
                if len(y):
                    found.append(np.column_stack((np.minimum(head[y], head[x]), np.maximum(head[y], head[x]))))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["x", "z"])

    return dealt.withColumn("part", F.pmod("cell", F.lit(parts))).groupBy("part").applyInArrow(run, "x long, z long").distinct()


def common(one: np.ndarray, two: np.ndarray) -> int:
    """The overlap of two sorted sets."""
    if not len(one) or not len(two):
        return 0
    return int((two[np.minimum(np.searchsorted(two, one), len(two) - 1)] == one).sum())


Change = tuple[int, int, np.ndarray, np.ndarray]  # name, size, elements beyond the head, elements of the head that lack


def derived_link(x: np.ndarray, z: np.ndarray, base: int, ys: list[Change], ws: list[Change], percent: int) -> tuple[int, int] | None:
    """A link between members ``ys`` of the family of x and ``ws`` of that of z, or None: the answer level.

    ``base`` is the overlap of x and z; all others are derived from it and from
    what members have more and less than their heads.
    """
    most, least = max(len(w[2]) for w in ws), min(w[1] for w in ws)
    for name, n, gained, lost in ys:
        if base + len(gained) + most < least_overlap(n, least, percent):
            continue
        with_z = base + common(gained, z) - common(lost, z)
        y = None
        for other, m, w_gained, w_lost in ws:
            need = least_overlap(n, m, percent)
            if with_z + len(w_gained) < need:
                continue
            y = np.union1d(np.setdiff1d(x, lost, True), gained) if y is None else y
            if with_z + common(w_gained, y) - common(w_lost, y) >= need:
                return max(name, other), min(name, other)
    return None


def members_of(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """Rows (head, name): all members of the families of ``pairs`` (x, z), heads included."""
    heads = pairs.select(F.col("x").alias("head")).union(pairs.select(F.col("z").alias("head"))).distinct()
    return heads.join(of.filter("name <> head").select("head", "name"), "head").union(heads.select("head", F.col("head").alias("name")))


def derived_links(pairs: DataFrame, members: DataFrame, sets: DataFrame, percent: int, chunk: int) -> DataFrame:
    """Links (a, b) between members of the families of ``pairs`` (x, z), one at most for each two chunks.

    Each member is compared with its head once and stored as its changes, many
    members to a chunk; chunks meet only where the heads' overlap leaves room.
    """
    own = sets.select(F.col("label").alias("name"), F.col("members").alias("own"))
    heads = sets.select(F.col("label").alias("head"), F.col("members").alias("given"))

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gained, lost = [], [], []
            for y, x in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                y, x = np.frombuffer(y, "<u8"), np.frombuffer(x, "<u8")
                sizes.append(len(y))
                gained.append(np.setdiff1d(y, x, True).tobytes())
                lost.append(np.setdiff1d(x, y, True).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(gained, pa.binary()), pa.array(lost, pa.binary())], ["head", "name", "n", "gained", "lost"])

    kind = "head long, name long, n long, gained binary, lost binary"
    changes = members.join(own, "name").join(heads, "head").select("head", "name", "own", "given").mapInArrow(change, kind)
    cuts = members.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("cuts"))
    placed = changes.join(cuts, "head").withColumn("nth", F.pmod(F.xxhash64("name"), F.col("cuts")))
    # A chunk holds about ``chunk`` members' changes.
    chunks = staged(placed.groupBy("head", "nth").agg(
        F.collect_list(F.struct("name", "n", "gained", "lost")).alias("inside"), F.max(F.length("gained") / 8).cast("long").alias("gain"), F.min("n").alias("least")
    ), "join-chunks")

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            base = [common(np.frombuffer(x, "<u8"), np.frombuffer(z, "<u8")) for x, z in both]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(base, pa.int64())], ["x", "z", "base"])

    sides = [heads.select(F.col("head").alias(c), F.col("given").alias(f"s{c}")) for c in "xz"]
    based = pairs.join(sides[0], "x").join(sides[1], "z").select("x", "z", "sx", "sz").mapInArrow(overlap, "x long, z long, base long")
    meta = [chunks.select(F.col("head").alias(c), F.col("nth").alias(f"n{c}"), F.col("gain").alias(f"g{c}"), F.col("least").alias(f"l{c}")) for c in "xz"]
    room = (100 + percent) * (F.col("base") + F.col("gx") + F.col("gz")) >= percent * (F.col("lx") + F.col("lz"))
    cells = staged(staged(based, "join-based").join(meta[0], "x").join(meta[1], "z").filter(room).select("x", "nx", "z", "nz", "base"), "join-cells")
    bodies = [chunks.select(F.col("head").alias(c), F.col("nth").alias(f"n{c}"), F.col("inside").alias(f"i{c}")) for c in "xz"]
    whole = cells.join(bodies[0], ["x", "nx"]).join(bodies[1], ["z", "nz"]).join(sides[0], "x").join(sides[1], "z")

    def run(table: pa.Table) -> pa.Table:
        found = []
        for row in table.to_pylist():
            ys, ws = ([(m["name"], m["n"], np.frombuffer(m["gained"], "<u8"), np.frombuffer(m["lost"], "<u8")) for m in row[c]] for c in ("ix", "iz"))
            link = derived_link(np.frombuffer(row["sx"], "<u8"), np.frombuffer(row["sz"], "<u8"), row["base"], ys, ws, percent)
            found += [link] if link else []
        return pa.table([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return whole.groupBy("x", "nx", "z", "nz").applyInArrow(run, "a long, b long").distinct()


def join_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, block: int = 512, chunk: int = 128,
    part_rows: int = 20_000, part_entries: int = 500_000,
) -> DataFrame:
    """One row per input row: (id, ``n_shingles``, ``component_id``). ``percent`` is from 1 to 100; the other sizes bound what a task holds."""
    read = staged(read_sets(docs, id_col, text_col, shingle), "join-sets")
    signed = read.filter("block IS NULL").select("id", "n", "name", "marks")
    linkable = signed.filter("id IS NOT NULL AND name IS NOT NULL")
    entries = linkable.agg(F.sum(F.col("n") - F.ceil(percent * F.col("n") / 100) + 1)).first()[0] or 0
    stars = staged(index_stars(docs, id_col, text_col, shingle, percent, bucket_ranks(read), max(1, int(entries) // part_entries + 1)), "join-stars")
    classes = staged(linkable.groupBy("name").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("marks").alias("marks")), "join-classes")
    labels = classes.select("name", "id")

    def members(names: DataFrame) -> DataFrame:
        return staged(sets_of(docs, names.distinct().join(labels, "name"), id_col, text_col, shingle), "join-members")

    pairs = staged(near_marks(may_link(stars, percent).select("a", "b").distinct(), classes, percent), "join-pairs")
    sets = members(pairs.select(F.col("a").alias("name")).union(pairs.select(F.col("b").alias("name"))))
    links = staged(confirm(pairs, sets, percent).distinct(), "join-links")
    of = staged(families(links), "join-of")
    left = staged(open_pairs(stars, of, classes, percent, block, part_rows), "join-open")
    inside = staged(members_of(left, of), "join-inside")
    further = staged(derived_links(left, inside, members(inside.select("name")), percent, chunk), "join-links")
    # Rows of one id with different sets are one document.
    several = linkable.groupBy("id").agg(F.min("name").alias("b"), F.max("name").alias("top")).filter("b <> top").select("id", "b")
    by_id = linkable.join(several, "id").filter("name <> b").select(F.col("name").alias("a"), "b")
    every = staged(links.union(further).union(by_id), "join-links")
    reached = components(every).withColumnRenamed("node", "name")
    named = reached.join(labels, "name")
    lowest = named.join(named.groupBy("component").agg(F.min("id").alias("component_id")), "component").select("name", "component_id")
    answers = labels.join(lowest, "name", "left").select("name", F.coalesce("component_id", "id").alias("component_id"))
    found = signed.drop("marks").join(answers, "name", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
