"""Operator 12: a Merkle manifest of a dataset, with a proof for each row, by lag and lead windows.

A row's leaf is the SHA-256 of its fields. The leaves of a group (a language),
in the order of their ids, are hashed in pairs, level by level, up to a subroot;
the subroots, in the order of the groups, likewise give the root. A node without
a neighbour becomes the hash of itself alone. A proof lists the siblings of a row from
its leaf to the root; ``fold`` recomputes the root from a leaf and its proof.

Method: leaves get slots, consecutive within their group. ``CHUNK`` leaves of
consecutive slots are one window partition, a whole subtree. A node lives in the row of its
first leaf, so at level k the rows whose slot is divisible by 2**k hold nodes: a lead by 2**k
gives a first child its sibling, a lag by 2**k gives it to the second one, masked by the slot and
by the length of the run, and first-child rows hash parents. A node hands its sibling
on to its leaves as the last value at or before them. All levels of a chunk share
one shuffle and one sort; the roots of the chunks are the leaves of the next pass, until each
group has one node. The slots come from a range partitioning by group and id, so neither a group
nor the table ever meets in one task; only counts per range and group do.

Cases: empty texts differ from NULL ones (``0:`` and ``-``). Equal ids are
ordered by their leaves; rows that are equal throughout are interchangeable, each keeps a place. NULL ids
come first and NULL groups are a group of their own, before the others; names order by their UTF-8 bytes. Very long texts are hashed
as they are. An empty table gives an empty manifest. Columns that are not among ``fields`` are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.llm.common import staged

LEVELS = 8
CHUNK = 1 << LEVELS


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_of(fields: dict[str, Column]) -> Column:
    """The leaf: each field as byte count, colon and value; ``-`` for NULL."""
    told = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in fields.values()]
    return digest(*told)


def with_slots(nodes: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``nodes`` with ``slot``, from 0 within each group, and ``n``, the rows of the group; written to the shared folder.

    Rows are sorted within ranges; a row's place in its range and the counts of the
    ranges before give the slot.
    """
    # Equal rows have a place of their own among the ranges, so that no range has to hold them all.
    own = nodes.withColumn("__own", F.monotonically_increasing_id())
    # Without a number the session's setting holds, and small ranges may be put together.
    ranged = own.repartitionByRange(group, *order, "__own").sortWithinPartitions(group, *order, "__own").drop("__own")
    placed = staged(ranged.withColumn("__range", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "merkle-ranges")
    counts = placed.groupBy(group, "__range").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col(group).alias("__group"), F.col("__range").alias("__of"), "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"),
        F.sum("__n").over(Window.partitionBy(group)).alias("n"),
    )
    joined = placed.join(starts, (F.col(group) == F.col("__group")) & (F.col("__range") == F.col("__of")))
    return joined.withColumn("slot", F.col("__start") + F.col("__at") - F.col("__first")).drop("__range", "__at", "__group", "__of", "__first", "__start")


def levels(nodes: DataFrame, group: str, height: int) -> DataFrame:
    """``nodes`` (group, n, slot, hash, ..) with ``chunk``, the ``siblings`` of each row below the root of its chunk, and ``top``, that root.

    A sibling is a struct (``hash``, ``left``): '' for a node alone in its run.
    ``height`` is that of the tallest chunk.
    """
    by_slot = Window.partitionBy(group, "chunk").orderBy("slot")
    upto = by_slot.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = nodes.select("*", F.shiftright("slot", LEVELS).alias("chunk"), F.col("hash").alias("__node0"))
    for k in range(height):
        width, nth, node = 1 << k, F.shiftright("slot", k), F.col(f"__node{k}")
        # Nodes of this level in the whole group: 2**k leaves each, the last perhaps fewer.
        count = F.shiftright(F.col("n") + F.lit(width - 1), k)
        goes_on, is_node, is_first = count > 1, F.col("slot") % width == 0, nth % 2 == 0
        after, back = F.lead(node, width).over(by_slot), F.lag(node, width).over(by_slot)
        sibling = F.when(~is_first, back).when(nth == count - 1, F.lit("")).otherwise(after)
        rows = rows.select("*", F.when(is_node & goes_on, sibling).alias(f"__beside{k}"))
        # The last node at or before a row is the one that holds it.
        held = F.when(goes_on, F.last(f"__beside{k}", ignorenulls=True).over(upto))
        parent = F.when(is_node & is_first & goes_on, digest(node, F.col(f"__beside{k}"))).when(is_node & ~goes_on, node)
        rows = rows.select("*", held.alias(f"__held{k}"), parent.alias(f"__node{k + 1}"))
    told = F.array(*[F.struct(F.col(f"__held{k}").alias("hash"), (F.shiftright("slot", k) % 2 == 1).alias("left")) for k in range(height)])
    siblings = F.filter(told, lambda s: s["hash"].isNotNull()) if height else F.expr("CAST(array() AS array<struct<hash string, left boolean>>)")
    return rows.select(*nodes.columns, "chunk", siblings.alias("siblings"), F.first(f"__node{height}").over(upto).alias("top"))


def proofs(nodes: DataFrame, group: str, most: int | None = None) -> DataFrame:
    """``nodes`` (group, n, slot, hash, ..) with all ``siblings`` up to the root of the group, and that ``root``."""
    if most is None:
        most = nodes.agg(F.max("n")).first()[0] or 0
    rows = levels(nodes, group, min(LEVELS, max(most - 1, 0).bit_length()))
    if most <= CHUNK:
        return rows.drop("chunk").withColumnRenamed("top", "root")
    tops = rows.filter(F.col("slot") % CHUNK == 0).select(
        group, F.shiftright(F.col("n") + F.lit(CHUNK - 1), LEVELS).alias("n"), F.col("chunk").alias("slot"), F.col("top").alias("hash")
    )
    above = proofs(staged(tops, "merkle-nodes"), group, -(-most // CHUNK))
    above = above.select(F.col(group).alias("__group"), F.col("slot").alias("__chunk"), F.col("siblings").alias("__more"), "root")
    both = rows.join(above, (F.col(group) == F.col("__group")) & (F.col("chunk") == F.col("__chunk")))
    return both.withColumn("siblings", F.concat("siblings", "__more")).drop("chunk", "top", "__group", "__chunk", "__more")


def fold(leaf: Column, siblings: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(siblings, leaf, lambda h, s: digest(F.when(s["left"], s["hash"]).otherwise(F.lit("")), h, F.when(s["left"], F.lit("")).otherwise(s["hash"])))


def manifest(
    docs: DataFrame, group_col: str = "lang", id_col: str = "doc_id", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    tampered: dict[str, Column] | None = None, where: Column | None = None,
) -> DataFrame:
    """One row per input row: (id, ``leaf``, ``subroot``, ``root``, ``siblings``, ``tampered_leaf``).

    ``tampered`` replaces fields in the rows of ``where``; their ``tampered_leaf``
    is the leaf that they would have, NULL in all other rows.
    """
    given = {f: F.col(f) for f in fields}
    other = F.when(F.coalesce(where, F.lit(False)), leaf_of(given | tampered)) if tampered else F.lit(None).cast("string")
    # A NULL group is a name that sorts before all others, as text, so that groups are equal by ``=``.
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    leaves = docs.select(F.col(id_col).alias("id"), group.alias("group"), leaf_of(given).alias("hash"), other.alias("tampered_leaf"))
    nodes = staged(with_slots(leaves, "group", ["id", "hash"]), "merkle-leaves")
    rows = staged(proofs(nodes, "group"), "merkle-proofs")
    subroots = rows.filter("slot = 0").select(F.lit(0).alias("all"), "group", F.col("root").alias("hash"))
    top = proofs(staged(with_slots(subroots, "all", ["group"]), "merkle-subroots"), "all")
    top = top.select(F.col("group").alias("__group"), F.col("siblings").alias("__more"), F.col("root").alias("__root"))
    both = rows.join(top, F.col("group") == F.col("__group"))
    return both.select(
        F.col("id").alias(id_col), F.col("hash").alias("leaf"), F.col("root").alias("subroot"), F.col("__root").alias("root"),
        F.concat("siblings", "__more").alias("siblings"), "tampered_leaf",
    )


def proof_digest(siblings: Column) -> Column:
    """One digest of all siblings of a proof."""
    return digest(F.array_join(F.transform(siblings, lambda s: s["hash"]), ""))
