"""The Merkle manifest against a tree built in plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from hearsay.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, hash string, n int, slot int, `group` string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """The root, and the siblings of each node with their sides."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, place in enumerate(at):
            other = place ^ 1
            paths[k].append((nodes[other] if other < len(nodes) else "", place % 2 == 1))
        nodes = [sha("".join(nodes[k:k + 2])) for k in range(0, len(nodes), 2)]
        at = [place // 2 for place in at]
    return nodes[0], paths


def slow_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    below = {g: climb([x[2] for x in sorted(groups[g])]) for g in names}
    root, above = climb([below[g][0] for g in names])
    return sorted(
        (str(i if has else None), h, below[g][0], root, str(path + above[k]))
        for k, g in enumerate(names) for (has, i, h), path in zip(sorted(groups[g]), below[g][1], strict=True)
    )


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2, "clash") for r in rows], SCHEMA)


def told(df):
    found = df.select("doc_id", "leaf", "subroot", "root", "siblings").collect()
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, str([(s["hash"], s["left"]) for s in r.siblings])) for r in found)


@pytest.mark.parametrize("n", [1, 3, 700])
def test_manifest(spark, n):
    """Over 256 rows a group is hashed in several passes; a third of the rows share an id."""
    rng = random.Random(n)
    rows = [(rng.choice([i, i, 5]), rng.choice(["s", None]), rng.choice(["en"] * 6 + ["é", "de", None]), i, rng.choice(["", None, f"text {i}", "中" * 30])) for i in range(n)]
    rows += rows[:2] + [(None, None, None, None, None)] * (n % 2 * 3)
    df = frame(spark, rows).repartition(5)
    found = merkle.manifest(df, tampered={"n_chars": F.col("n_chars") + 1}, where=F.col("doc_id") % 2 == 0)
    assert told(found) == slow_manifest(rows)
    checked = found.select("doc_id", "leaf", "root", "tampered_leaf", merkle.fold(F.coalesce("tampered_leaf", "leaf"), F.col("siblings")).alias("folded")).collect()
    for r in checked:
        assert (r.tampered_leaf is not None) == (r.doc_id is not None and r.doc_id % 2 == 0)
        assert (r.folded == r.root) == (r.tampered_leaf is None or r.tampered_leaf == r.leaf)


def test_deep_and_long(spark):
    """One group over the rows of two passes (65,536), one very long text, and rows of one id alone."""
    rows = [(i, "s", "en", i, "t") for i in range(66_000)] + [(3, "s", "de", 1, "long " * 200_000)] + [(9, "s", "fr", 1, "same")] * 300
    found = merkle.manifest(frame(spark, rows).repartition(3))
    want = slow_manifest(rows)
    assert found.select("root").distinct().collect() == [(want[0][3],)]
    assert told(found.filter("doc_id % 997 = 3 OR subroot <> root")) == [w for w in want if int(w[0]) % 997 == 3 or w[2] != w[3]]


def test_empty(spark):
    assert merkle.manifest(frame(spark, [])).count() == 0
