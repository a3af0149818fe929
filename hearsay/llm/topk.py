"""Operator 10: exact top-k by inner product; ball trees per shard, searched by branch and bound.

Vectors become integers, floor(scale * x). Rows are dealt to shards of bounded
size by a hash; a task builds the ball tree of a shard: nodes halve along the
line between two far points and keep a centre and radius, so no vector below a
node can score more than q.centre + |q| * radius.

Queries go in blocks. A cell is one block against one shard: nodes are visited
in the order of their upper bound, and a node is skipped when its bound lies
below the kth score of every query of the block. The kth score is shared twice:
a block first searches one shard, the home shard of the block, and the scores it
finds there are where the search of all other shards starts. Cells emit at most k rows a
query; the last step keeps k of those by a window whose limit acts in each task
before the shuffle.

Cases: rows without an id, and vectors that are NULL or hold NULL or non-finite
components, take no part. Vectors meet those of their own length only. Rows that repeat an id are
separate candidates, a row never meets itself; ties go to the smaller id. Fewer
than k candidates give all. Scores are exact; those beyond 64 bits are cut to
the range. Empty tables give empty results; further columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.llm.common import staged

LONG = np.iinfo(np.int64)
NOTHING = -np.inf


def usable(vector: Column) -> Column:
    """True for vectors whose components are all finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def build_tree(points: np.ndarray, leaf: int = 64) -> dict[str, np.ndarray]:
    """Ball tree: an order of the rows, and for each node its span in it, children, centre and radius."""
    order = np.arange(len(points))
    begin, end, left, right, centres, radii = [0], [len(points)], [-1], [-1], [], []
    at = 0
    while at < len(begin):
        rows = order[begin[at]:end[at]]
        own = points[rows].astype(np.float64)
        centre = own.mean(axis=0)
        far = np.sqrt(((own - centre) ** 2).sum(axis=1))
        centres.append(centre)
        radii.append(far.max(initial=0.0))
        if len(rows) > leaf and radii[-1] > 0:
            one = own[far.argmax()]
            other = own[((own - one) ** 2).sum(axis=1).argmax()]
            middle = len(rows) // 2
            order[begin[at]:end[at]] = rows[np.argsort(own @ (other - one), kind="stable")]
            for lo, hi in ((begin[at], begin[at] + middle), (begin[at] + middle, end[at])):
                begin.append(lo)
                end.append(hi)
                left.append(-1)
                right.append(-1)
            left[at], right[at] = len(begin) - 2, len(begin) - 1
        at += 1
    return {"order": order, "begin": np.array(begin), "end": np.array(end), "left": np.array(left), "right": np.array(right),
            "centre": np.array(centres), "radius": np.array(radii)}


def exact_scores(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Integer inner products: in floating point where that is exact, else in integers of any length."""
    # In Python integers: the absolute value of the smallest 64-bit integer is none.
    largest = [float(max(int(x.max(initial=0)), -int(x.min(initial=0)))) for x in (queries, points)]
    most = largest[0] * largest[1] * max(1, queries.shape[1])
    if most < 2.0**52:
        return (queries.astype(np.float64) @ points.astype(np.float64).T).astype(np.int64)
    if most < 2.0**62:
        return queries.astype(np.int64) @ points.astype(np.int64).T
    exact = queries.astype(object) @ points.astype(object).T
    return np.clip(exact, LONG.min, LONG.max).astype(np.int64)


def search(
    tree: dict[str, np.ndarray], points: np.ndarray, ids: np.ndarray, rows: np.ndarray,
    queries: np.ndarray, own_rows: np.ndarray, floor: np.ndarray, k: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best (query position, id, score) of one shard for one block, at most k a query.

    ``floor`` holds scores that k candidates elsewhere reach already; only
    candidates that reach it as well can matter.
    """
    lengths = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
    bound = queries.astype(np.float64) @ tree["centre"].T + lengths[:, None] * tree["radius"]
    bound += 1e-9 * (np.abs(bound) + lengths[:, None] * (1 + np.abs(tree["centre"]).max(initial=0))) + 1e-6  # rounding errs on the safe side
    bound = np.maximum(bound, float(LONG.min))  # scores are cut to 64 bits
    kth = floor.astype(np.float64).copy()
    n = len(queries)
    best_score = np.zeros((n, 0), dtype=np.int64)
    best_row = np.zeros((n, 0), dtype=np.int64)
    real = np.zeros((n, 0), dtype=bool)
    heap = [(-float(bound[:, 0].max(initial=NOTHING)), 0)]
    while heap:
        _, node = heapq.heappop(heap)
        active = np.nonzero(bound[:, node] >= kth)[0]
        if not len(active):
            continue
        if tree["left"][node] >= 0:
            for child in (tree["left"][node], tree["right"][node]):
                heapq.heappush(heap, (-float(bound[active, child].max()), int(child)))
            continue
        members = tree["order"][tree["begin"][node]:tree["end"][node]]
        scores = exact_scores(queries[active], points[members])
        allowed = (rows[members][None, :] != own_rows[active][:, None]) & (scores >= kth[active][:, None])
        width = best_score.shape[1]
        if width < k + len(members):
            grow = k + len(members) - width
            best_score = np.pad(best_score, ((0, 0), (0, grow)))
            best_row = np.pad(best_row, ((0, 0), (0, grow)))
            real = np.pad(real, ((0, 0), (0, grow)))
        best_score[active, k:k + len(members)] = scores
        best_row[active, k:k + len(members)] = members
        real[active, k:k + len(members)] = allowed
        real[active, k + len(members):] = False
        # Real ones first, then score downwards, then id upwards.
        part_real, part_score, part_row = real[active], best_score[active], best_row[active]
        rank = np.lexsort((ids[part_row], np.where(part_score == LONG.min, LONG.max, -part_score), ~part_real), axis=1)[:, :k]
        take = np.arange(len(active))[:, None]
        best_score[active, :k], best_row[active, :k] = part_score[take, rank], part_row[take, rank]
        real[active, :k] = part_real[take, rank]
        real[active, k:] = False
        full = real[active, k - 1]
        kth[active[full]] = np.maximum(kth[active[full]], best_score[active[full], k - 1])
    which, place = np.nonzero(real[:, :k])
    return which, ids[best_row[which, place]], best_score[which, place]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.int64) for v in column])


TREE = "shard long, dim int, ids binary, rows binary, points binary, begin binary, end binary, left binary, right binary, centre binary, radius binary"


def _pack_tree(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["id", "row"])
    points = _matrix(frame["vec"])
    tree = build_tree(points)
    order = tree.pop("order")
    narrow = next(t for t in ("int8", "int16", "int32", "int64") if points.min(initial=0) >= np.iinfo(t).min and points.max(initial=0) <= np.iinfo(t).max)
    out = {"shard": key[0], "dim": key[1], "ids": frame["id"].to_numpy("<i8")[order].tobytes(), "rows": frame["row"].to_numpy("<i8")[order].tobytes(),
           "points": narrow.encode().ljust(8) + points[order].astype(narrow).tobytes()}
    out |= {name: values.astype("<f8" if values.dtype.kind == "f" else "<i8").tobytes() for name, values in tree.items()}
    return pd.DataFrame([out])


def _unpack_tree(row: pd.Series) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    dim = int(row["dim"])
    ids, rows = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["rows"], "<i8")
    points = np.frombuffer(row["points"][8:], row["points"][:8].decode().strip()).reshape(len(ids), dim)
    tree = {name: np.frombuffer(row[name], "<i8") for name in ("begin", "end", "left", "right")}
    tree["centre"] = np.frombuffer(row["centre"], "<f8").reshape(len(tree["begin"]), dim)
    tree["radius"] = np.frombuffer(row["radius"], "<f8")
    return tree | {"order": np.arange(len(ids))}, points, ids, rows


def _search_cells(k: int):
    def run(key: tuple, queries: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(trees):
            block = _matrix(queries["vec"])
            rows, floor = queries["row"].to_numpy(np.int64), queries["floor"].to_numpy(np.float64)
            for _, tree in trees.iterrows():
                unpacked, points, ids, point_rows = _unpack_tree(tree)
                which, got, scores = search(unpacked, points, ids, point_rows, block, rows, floor, k)
                found.append(pd.DataFrame({"row": rows[which], "vec_id": got, "score": scores}))
        return pd.concat(found) if found else pd.DataFrame({"row": [], "vec_id": [], "score": []}).astype("int64")

    return run


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding",
    shard_rows: int = 8192, block_queries: int = 512,
) -> DataFrame:
    """Rows (``query_id``, ``rank``, ``vec_id``, ``score``): the k best candidates of each query row.

    ``is_query`` is a condition on the columns of ``vectors``. Sizes of shards
    and blocks are bounds on what one task holds; their numbers follow the input.
    """
    kept = vectors.filter(F.col(id_col).isNotNull() & usable(F.col(vec_col)))
    whole = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long"))
    base = kept.select(
        F.col(id_col).cast("long").alias("id"), whole.alias("vec"), F.size(vec_col).alias("dim"),
        F.coalesce(is_query, F.lit(False)).alias("query"), F.monotonically_increasing_id().alias("row"),
    )
    base = staged(base, "topk-vectors")  # fixes the row numbers
    sizes = {r["dim"]: (r["n"], r["q"]) for r in base.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("query").alias("q")).collect()}
    n, q = sum(s[0] for s in sizes.values()), sum(s[1] for s in sizes.values())
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-q // block_queries))
    shard = F.pmod(F.xxhash64("row"), F.lit(shards))
    trees = base.withColumn("shard", shard).groupBy("shard", "dim").applyInPandas(_pack_tree, TREE)
    trees = staged(trees, "topk-trees")
    queries = base.filter("query").select(
        "id", "row", "vec", "dim", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).alias("block"), F.lit(NOTHING).alias("floor")
    )
    home = F.pmod(F.col("block"), F.lit(shards))
    every_shard, every_block = (F.expr(f"sequence(0L, {most - 1}L)") for most in (shards, blocks))
    cell = ["block", "shard", "dim"]
    out = "row long, vec_id long, score long"

    by_block = trees.select("*", F.explode(every_block).alias("block"))
    near = queries.withColumn("shard", home).groupBy(*cell).cogroup(by_block.filter(F.col("shard") == home).groupBy(*cell))
    first = staged(near.applyInPandas(_search_cells(k), out), "topk-first")
    reached = first.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("low"))
    primed = queries.drop("floor").join(reached, "row", "left").withColumn("floor", F.when(F.col("n") >= k, F.col("low")).otherwise(F.lit(NOTHING)))
    far = primed.select("*", F.explode(every_shard).alias("shard")).filter(F.col("shard") != home).groupBy(*cell)
    rest = far.cogroup(by_block.filter(F.col("shard") != home).groupBy(*cell)).applyInPandas(_search_cells(k), out)
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.join(queries.select(F.col("id").alias("query_id"), "row"), "row").select("query_id", "rank", "vec_id", "score")
