"""Hard negatives against a comparison of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearsay.llm import negatives
from hearsay.llm.topk import LONG

SCHEMA = "vec_id long, embedding array<double>, label int, shard int, floor int, `row` string, bucket int"


def slow(rows, scale=256.0):
    good = [(n, i, [int(max(min(np.floor(scale * x), LONG.max), LONG.min)) for x in v], lab) for n, (i, v, lab) in enumerate(rows)
            if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, i, q, lab in good:
        if i % 10:
            continue
        scores = [(-max(min(sum(a * b for a, b in zip(q, v, strict=True)), LONG.max), LONG.min), j, other) for m, j, v, other in good if m != n and len(v) == len(q)]
        for p, j, _ in sorted(s for s in scores if s[2] == lab)[:5]:
            window = sorted(s for s in scores if s[2] != lab and 30 * -p <= 100 * -s[0] <= 90 * -p)
            out += [(i, j, k + 1, s[1], -p, -s[0]) for k, s in enumerate(window[:10])]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    middle = rng.normal(0, 1, (4, 6))
    rows = [(i, (middle[i % 4] * rng.uniform(0.2, 1.5) + rng.normal(0, 0.4, 6)).round(1).tolist(), int(rng.choice([0, 0, 0, 1, 2]))) for i in range(400)]
    rows += [(400 + i, rows[10][1], i % 2) for i in range(150)]  # repeated vectors: ties
    rows += [(20, rows[20][1], 0), (None, rows[1][1], 1), (700, None, 1), (710, [0.1, None, 0.0, 0.0, 0.0, 0.0], 1), (720, [float("nan")] * 6, 1), (730, [float("inf")] * 6, 0), (740, rows[3][1], None)]
    rows += [(750 + i, [0.5 + i, 1.0], i % 2) for i in range(30)] + [(900, [], 0), (901, [], 1), (902, [], 0), (910, [1e17] * 6, 1), (920, [-1e17] * 6, 2), (930, [1e17] * 6, 2)]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 60, "block_anchors": 4}])
def test_hard_negatives(spark, vectors, sizes):
    df = spark.createDataFrame([(*r, 1, 2, "clash", 3) for r in vectors], SCHEMA).repartition(3)
    found = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, F.col("label"), **sizes)
    assert sorted(tuple(r) for r in found.collect()) == slow(vectors)


def test_none(spark, vectors):
    df = spark.createDataFrame([(*r, 1, 2, "clash", 3) for r in vectors], SCHEMA)
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0, F.col("label")).count() == 0
    assert negatives.hard_negatives(df, F.lit(False), F.col("label")).count() == 0


def test_tree_covers_and_skips():
    """Every row lies within the bounds of all nodes above it; near clusters, a search meets few leaves."""
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(c, 2, (400, 8)) for c in rng.normal(0, 100, (10, 8))]).round().astype(np.int64)
    tree = negatives.cover_tree(points)
    ordered = points[tree["order"]]
    assert sorted(tree["order"].tolist()) == list(range(len(points)))
    queries = points[::97] * 2
    length = np.sqrt((points.astype(float) ** 2).sum(axis=1)).max()
    low, high = negatives.bounds(queries, ordered[tree["centre"]], length, tree["inner"], tree["radius"])
    scores = queries @ ordered.T
    for node, (begin, end) in enumerate(zip(tree["begin"], tree["end"], strict=True)):
        assert (low[:, [node]] <= scores[:, begin:end]).all() and (scores[:, begin:end] <= high[:, [node]]).all()
    leaves = tree["child"] == tree["last"]
    kth = np.sort(scores, axis=1)[:, -10]
    assert (high[:, leaves] >= kth[:, None]).mean() < 0.5
