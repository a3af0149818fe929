"""Operator 13: hard negatives by inner product, from cover trees over norm-augmented candidates.

A row's positives are the best other rows of its label. For each positive, the negatives
are the best rows of other labels whose score lies in a window, from ``low`` to
``high`` percent of the positive's score. Vectors become integers, floor(scale * x).

Candidates are dealt to shards of bounded size, by label: a label's rows share shards, many
small labels share one, a large label has several. In a shard all candidates get one more
coordinate that lifts them to the same length M, so that an inner product follows from a
distance: 2 q.x = |q|**2 + M**2 - d**2. A cover tree holds them: a node has a candidate as its
centre and a covering radius; its children cover what is within ``SHRINK`` of
that radius, level by level, and what no child covers lies in rings around the centre. So a node bounds the
scores below it from both sides; best-first descent takes the highest bound, skips nodes that lie
outside the window, or below the kth score so far, of every anchor still open, and leaves are scored exactly in integers.

Anchors go in blocks of one shard of labels. The first search, for positives, only meets the
shards of their labels. Before the second, a small table of shard centres and radii is compared with
each block. The shard with the highest bound is searched first; the kth scores found there then
remove shards from the list of each block before anything is sent to them, and start the search of those that
stay. Each search emits at most k rows a window.

Cases: rows without an id or a label, and vectors that are NULL or hold NULL or non-finite components, take no
part; empty vectors score 0. Vectors meet those of their own length only. Rows that repeat an id are separate
rows; a row never meets itself. Ties go to the smaller id. A negative score of a positive
has an empty window, a score of 0 the window from 0 to 0. Anchors without positives or negatives give no
rows. Scores beyond 64 bits are cut to the range. Empty tables give empty results; further columns are not read, whatever their names.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.llm.common import staged
from hearsay.llm.topk import LONG, exact_scores, usable

SHRINK = 0.7
LEAF = 64
MOST_CHILDREN = 32
KEY = ["bucket", "nth", "dim"]


def lifted(points: np.ndarray) -> np.ndarray:
    """Points with one more coordinate, which gives all the same length."""
    real = points.astype(np.float64)
    squares = (real**2).sum(axis=1)
    return np.column_stack((real, np.sqrt(np.maximum(squares.max(initial=0) - squares, 0))))


def cover_tree(points: np.ndarray) -> dict[str, np.ndarray]:
    """Nodes over an order of the rows: span, children, centre (a place in the order), inner and covering radius."""
    at = lifted(points)
    order = np.arange(len(points))
    nodes = [[0, len(points), 0, 0, 0, 0.0, 0.0]]  # begin, end, first child, last child, centre row, inner, radius
    done = 0
    while done < len(nodes):
        begin, end, _, _, centre, inner, _ = nodes[done]
        rows = order[begin:end]
        away = np.sqrt(((at[rows] - at[centre]) ** 2).sum(axis=1))
        radius = float(away.max(initial=0))
        nodes[done][6] = radius
        if len(rows) > LEAF and radius > 0 and inner == 0:
            children, scattered, left, middle = [], [], rows, centre
            while len(left) and len(children) < MOST_CHILDREN and len(scattered) < 8 * MOST_CHILDREN:
                near = np.sqrt(((at[left] - at[middle]) ** 2).sum(axis=1)) <= SHRINK * radius
                near |= left == middle
                if near.sum() > LEAF // 2:
                    children.append((left[near], middle))
                else:
                    scattered.append(left[near])
                left = left[~near]
                middle = left[0] if len(left) else -1
            rest = np.concatenate([*scattered, left]).astype(np.int64)
            nodes[done][2], nodes[done][3] = len(nodes), len(nodes)
            for group, own in children:
                order[begin:begin + len(group)] = group
                nodes.append([begin, begin + len(group), 0, 0, own, 0.0, 0.0])
                begin += len(group)
            # What no child covers: rings around the centre, each a leaf.
            far = np.sqrt(((at[rest] - at[centre]) ** 2).sum(axis=1))
            by_distance = np.argsort(far, kind="stable")
            for cut in range(0, len(rest), LEAF):
                ring = by_distance[cut:cut + LEAF]
                order[begin:begin + len(ring)] = rest[ring]
                nodes.append([begin, begin + len(ring), 0, 0, centre, float(far[ring[0]]), 0.0])
                begin += len(ring)
            nodes[done][3] = len(nodes)
        done += 1
    columns = list(zip(*nodes, strict=True))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    tree = {name: np.array(c, np.int64) for name, c in zip(("begin", "end", "child", "last"), columns[:4], strict=True)}
    return tree | {"centre": place[np.array(columns[4], np.int64)], "inner": np.array(columns[5]), "radius": np.array(columns[6]), "order": order}


def bounds(queries: np.ndarray, centres: np.ndarray, lengths: np.ndarray, inner: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lowest and highest score that each query can reach below each node; ``lengths`` are the common lengths M."""
    q = queries.astype(np.float64)
    own = (q**2).sum(axis=1)[:, None]
    middle = q @ centres.astype(np.float64).T
    both = own + lengths**2
    away = np.sqrt(np.maximum(both - 2 * middle, 0))
    near = np.maximum(0, np.maximum(away - radius, inner - away))
    reach = np.sqrt(own) * radius
    slack = 1e-9 * (both + np.abs(middle) + reach) + 1e-6  # rounding errs on the safe side
    slack += 1e-7 * np.sqrt(both) * (away + radius)
    low = np.maximum(middle - reach, (both - (away + radius) ** 2) / 2) - slack
    high = np.minimum(middle + reach, (both - near**2) / 2) + slack
    # Scores are cut to 64 bits, so bounds are too.
    return np.minimum(low, float(LONG.max)), np.maximum(high, float(LONG.min))


def search(tree: dict, windows: dict[str, np.ndarray], same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best (window, id, score), at most k a window, among rows of the ``same`` label or of other ones.

    A window has a vector, the row and label of its anchor, ``lo`` and ``hi``, and ``floor``: a
    score that k candidates elsewhere reach already.
    """
    points, queries = tree["points"], windows["vec"]
    # Windows of one anchor share its vector, so bounds and scores are taken once an anchor.
    of, low, high = windows["anchor"], *bounds(queries, points[tree["centre"]], tree["length"], tree["inner"], tree["radius"])
    lo, hi, own, label = windows["lo"], windows["hi"], windows["row"], windows["label"]
    kth = np.maximum(windows["floor"], lo)
    n = len(lo)
    score, row, real = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64), np.zeros((n, k), bool)
    heap = [(0.0, 0)]
    while heap:
        _, node = heapq.heappop(heap)
        active = np.nonzero((high[of, node] >= kth) & (low[of, node] <= hi))[0]
        if not len(active):
            continue
        if tree["last"][node] > tree["child"][node]:
            for child in range(tree["child"][node], tree["last"][node]):
                heapq.heappush(heap, (-float(np.minimum(high[of[active], child], hi[active]).max()), child))
            continue
        span = slice(tree["begin"][node], tree["end"][node])
        anchors, back = np.unique(of[active], return_inverse=True)
        found = exact_scores(queries[anchors], points[span])[back]
        fits = (found >= kth[active][:, None]) & (found <= hi[active][:, None]) & (tree["rows"][span][None, :] != own[active][:, None])
        fits &= (tree["labels"][span][None, :] == label[active][:, None]) == same
        hit = fits.any(axis=1)
        active, found, fits = active[hit], found[hit], fits[hit]
        if not len(active):
            continue
        members = np.broadcast_to(np.arange(span.start, span.stop), found.shape)
        all_score, all_row = np.concatenate((score[active], found), axis=1), np.concatenate((row[active], members), axis=1)
        all_real = np.concatenate((real[active], fits), axis=1)
        # Real ones first, then score downwards, then id upwards; ~s turns the order without overflow.
        best = np.lexsort((tree["ids"][all_row], ~all_score, ~all_real), axis=1)[:, :k]
        score[active], row[active], real[active] = (np.take_along_axis(x, best, axis=1) for x in (all_score, all_row, all_real))
        full = active[real[active, k - 1]]
        kth[full] = np.maximum(kth[full], score[full, k - 1])
    which, place = np.nonzero(real)
    return which, tree["ids"][row[which, place]], score[which, place]


def matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.int64).reshape(len(column), dim)


BLOBS = {"ids": "<i8", "rows": "<i8", "labels": "<i8", "begin": "<i8", "end": "<i8", "child": "<i8", "last": "<i8", "centre": "<i8", "inner": "<f8", "radius": "<f8"}
TREE = "bucket long, nth long, dim int, root array<long>, reach double, length double, points binary, " + ", ".join(f"{b} binary" for b in BLOBS)


def pack_tree(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["id", "row"])
    points = matrix(frame["vec"], key[2])
    tree = cover_tree(points)
    order = tree.pop("order")
    # The shortest integers that hold all components.
    narrow = next(t for t in ("<i1", "<i2", "<i4", "<i8") if points.min(initial=0) >= np.iinfo(t).min and points.max(initial=0) <= np.iinfo(t).max)
    tree |= {"ids": frame["id"].to_numpy()[order], "rows": frame["row"].to_numpy()[order], "labels": frame["label"].to_numpy()[order]}
    points = points[order]
    out = dict(zip(KEY, key, strict=True)) | {"root": points[tree["centre"][0]].tolist(), "reach": tree["radius"][0], "length": float(np.sqrt((points.astype(np.float64) ** 2).sum(axis=1).max()))}
    out |= {"points": narrow.encode() + points.astype(narrow).tobytes()} | {b: tree[b].astype(kind).tobytes() for b, kind in BLOBS.items()}
    return pd.DataFrame([out])


def unpack_tree(row: pd.Series) -> dict:
    tree = {b: np.frombuffer(row[b], kind) for b, kind in BLOBS.items()}
    tree["points"] = np.frombuffer(row["points"][3:], row["points"][:3].decode()).reshape(len(tree["ids"]), int(row["dim"]))
    return tree | {"length": row["length"]}


def unpack_windows(frame: pd.DataFrame, dim: int) -> dict[str, np.ndarray]:
    """All windows of all anchors, side by side; ``which`` is the place of a window within its anchor."""
    counts = frame["lo"].map(len).to_numpy(np.int64)
    anchor = np.repeat(np.arange(len(frame)), counts)
    found = {c: np.concatenate([np.asarray(x, np.int64) for x in frame[c]]) for c in ("lo", "hi", "floor")}
    found |= {c: frame[c].to_numpy(np.int64)[anchor] for c in ("row", "label")}
    return found | {"anchor": anchor, "which": np.arange(len(anchor)) - np.repeat(np.cumsum(counts) - counts, counts), "vec": matrix(frame["vec"], dim)}


FOUND = "row long, which int, vec_id long, score long"
KINDS = {"row": "int64", "which": "int32", "vec_id": "int64", "score": "int64"}
OPEN = {"of_bucket": "int64", "block": "int64", "bucket": "int64", "nth": "int64", "dim": "int32", "high": "float64"}


def empty(kinds: dict[str, str]) -> pd.DataFrame:
    """No rows of these types: columns that stay integers when more rows follow."""
    return pd.DataFrame({c: np.zeros(0, kind) for c, kind in kinds.items()})


def searched(cells: DataFrame, trees: DataFrame, same: bool, k: int) -> DataFrame:
    """Rows FOUND of all ``cells``: anchors with windows, a block of them against a shard."""

    def run(key: tuple, anchors: pd.DataFrame, shards: pd.DataFrame) -> pd.DataFrame:
        found = [empty(KINDS)]
        if len(anchors):
            windows = unpack_windows(anchors, int(anchors["dim"].iloc[0]))
            for _, shard in shards.iterrows():
                at, ids, score = search(unpack_tree(shard), windows, same, k)
                found.append(pd.DataFrame({"row": windows["row"][at], "which": windows["which"][at], "vec_id": ids, "score": score}))
        return pd.concat(found).astype(KINDS)

    by = [*KEY, "of_bucket", "block"]
    needed = cells.select(*[F.col(c).alias(f"its_{c}") for c in by]).distinct()
    copies = trees.join(needed, [trees[c] == needed[f"its_{c}"] for c in KEY])
    return cells.groupBy(*by).cogroup(copies.groupBy(*[f"its_{c}" for c in by])).applyInPandas(run, FOUND)


def reachable(anchors: DataFrame, shards: DataFrame) -> DataFrame:
    """Rows (of_bucket, block, *KEY, high): the shards that a window of a block can still have an answer in.

    Blocks meet the small table of shards in cells of bounded size.
    """
    per_block, per_shards = 64, 4096
    blocks = anchors.select("of_bucket", "block").distinct().count()
    n = shards.count()
    groups, parts = max(1, -(-blocks // per_block)), max(1, -(-n // per_shards))
    every = lambda most: F.explode(F.expr(f"sequence(0L, {most - 1}L)"))
    left = anchors.select("*", F.pmod(F.xxhash64("of_bucket", "block"), F.lit(groups)).alias("g"), every(parts).alias("p"))
    right = shards.select("*", F.pmod(F.xxhash64(*KEY), F.lit(parts)).alias("p"), every(groups).alias("g"))

    def run(key: tuple, frame: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        out = [empty(OPEN)]
        for (of_bucket, block), own in frame.groupby(["of_bucket", "block"]) if len(table) else ():
            dim = int(own["dim"].iloc[0])
            windows = unpack_windows(own, dim)
            low, high = bounds(windows["vec"], matrix(table["root"], dim), table["length"].to_numpy(), np.zeros(len(table)), table["reach"].to_numpy())
            at = windows["anchor"]
            meets = (high[at] >= np.maximum(windows["floor"], windows["lo"])[:, None]) & (low[at] <= windows["hi"][:, None])
            most = np.where(meets, np.minimum(high[at], windows["hi"][:, None]), -np.inf).max(axis=0, initial=-np.inf)
            open_ = table[meets.any(axis=0)].assign(high=most[meets.any(axis=0)], of_bucket=of_bucket, block=block)
            out.append(open_[list(OPEN)])
        return pd.concat(out).astype(OPEN)

    schema = "of_bucket long, block long, bucket long, nth long, dim int, high double"
    return left.groupBy("g", "p", "dim").cogroup(right.groupBy("g", "p", "dim")).applyInPandas(run, schema)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0,
    id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = 4096, block_anchors: int = 1024,
) -> DataFrame:
    """Rows (``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``).

    ``is_anchor`` is a condition and ``label`` an integer expression on the columns of ``vectors``; ``low`` and ``high`` are percents
    from 0 to 100. Sizes of shards and blocks are bounds on what one task holds; their numbers follow the input.
    """
    kept = vectors.filter(F.col(id_col).isNotNull() & label.isNotNull() & usable(F.col(vec_col)))
    whole = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long"))
    base = kept.select(
        F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("vec"), F.size(vec_col).alias("dim"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.monotonically_increasing_id().alias("row"),
    )
    base = staged(base, "negatives-vectors")  # fixes the row numbers
    buckets = max(1, -(-base.count() // shard_rows))
    # A label over a shard's size is dealt to several; there are fewer of these than shards.
    large = base.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shard_rows)
    pieces = F.coalesce(F.ceil(F.col("n") / shard_rows), F.lit(1))
    placed = base.join(large, "label", "left").withColumns({"bucket": F.pmod(F.xxhash64("label"), F.lit(buckets)), "nth": F.pmod(F.xxhash64("row"), pieces)})
    trees = staged(placed.drop("n", "anchor").groupBy(*KEY).applyInPandas(pack_tree, TREE), "negatives-trees")
    shards = staged(trees.select(*KEY, "root", "reach", "length"), "negatives-shards")

    own = F.pmod(F.xxhash64("label"), F.lit(buckets)).alias("of_bucket")
    given = base.filter("anchor").select("id", "row", "label", "vec", "dim", own)
    per_bucket = given.groupBy("of_bucket", "dim").agg(F.ceil(F.count(F.lit(1)) / block_anchors).alias("blocks"))
    # A block's vectors have one length, so the length is part of its number.
    block = F.pmod(F.xxhash64("row"), F.col("blocks")) * F.lit(1 << 31) + F.col("dim")
    given = staged(given.join(per_bucket, ["of_bucket", "dim"]).withColumn("block", block).drop("blocks"), "negatives-anchors")

    all_scores = given.withColumns({"lo": F.array(F.lit(int(LONG.min))), "hi": F.array(F.lit(int(LONG.max))), "floor": F.array(F.lit(int(LONG.min)))})
    at_home = shards.select(*KEY).withColumn("home", F.col("bucket"))
    cells = all_scores.join(at_home.withColumnRenamed("dim", "of_dim"), (F.col("of_bucket") == F.col("home")) & (F.col("dim") == F.col("of_dim"))).drop("of_dim", "home")
    best = searched(cells, trees, True, positives)
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc("vec_id"))
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= positives)
    wanted = staged(best.select("row", (F.col("rank") - 1).alias("which"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")

    # Bounds in whole numbers, without leaving 64 bits: a score is 100 * hundreds + rest.
    rest = F.pmod("positive_score", F.lit(100))
    hundreds = F.expr("(CAST(positive_score AS DECIMAL(20, 0)) - pmod(positive_score, 100)) / 100").cast("long")
    lo, hi = hundreds * low + F.ceil(rest * low / 100), hundreds * high + F.floor(rest * high / 100)
    nothing = F.lit(int(LONG.min))
    limits = wanted.select("row", F.struct("which", lo.cast("long").alias("lo"), hi.cast("long").alias("hi")).alias("window"))
    limits = limits.groupBy("row").agg(F.array_sort(F.collect_list("window")).alias("windows"))
    asked = given.join(limits, "row").select(
        "id", "row", "label", "vec", "dim", "of_bucket", "block", F.col("windows.lo").alias("lo"), F.col("windows.hi").alias("hi"), F.transform("windows", lambda w: nothing).alias("floor"),
    )
    asked = staged(asked, "negatives-windows")

    first_shard = Window.partitionBy("of_bucket", "block").orderBy(F.desc("high"), *KEY)
    options = staged(reachable(asked, shards).withColumn("turn", F.row_number().over(first_shard)), "negatives-cells")
    first = staged(searched(asked.join(options.filter("turn = 1").drop("turn", "high", "dim"), ["of_bucket", "block"]), trees, False, negatives), "negatives-first")
    reached = first.groupBy("row", "which").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") >= negatives)
    reached = reached.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("which", "least"))).alias("known"))
    primed = asked.join(reached, "row", "left").withColumn("floor", F.transform("lo", lambda x, k: F.coalesce(F.try_element_at("known", k), nothing))).drop("known")
    primed = staged(primed, "negatives-windows")
    left = reachable(primed, shards).drop("high").join(options.filter("turn = 1").select("of_bucket", "block", *KEY), ["of_bucket", "block", *KEY], "left_anti")
    rest_found = searched(primed.join(left.drop("dim"), ["of_bucket", "block"]), trees, False, negatives)

    order = Window.partitionBy("row", "which").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = first.unionByName(rest_found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    named = given.select(F.col("id").alias("anchor_id"), "row")
    return ranked.join(wanted, ["row", "which"]).join(named, "row").select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
