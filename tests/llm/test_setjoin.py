"""The set-similarity join against a comparison of all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearsay.llm import setjoin

SCHEMA = "doc_id long, text string, name string, n int, token long, id long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1, 2, 3) for i, t in rows], SCHEMA)


def slow(rows, size, percent):
    def members(text):
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
        return {tuple(words[k:k + size]) for k in range(len(words) - size + 1)} or ({tuple(words)} if words else set())

    sets = [(i, members(t)) for i, t in rows]
    label = {i: i for i, _ in rows if i is not None}
    live = [(i, x) for i, x in sets if i is not None and x]
    links = {(i, j) for i, x in live for j, y in live if i < j and 100 * len(x & y) >= percent * len(x | y)}
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    return sorted((str(i), len(x), str(label.get(i))) for i, x in sets), links


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=40)
    out, at = [], 0
    for k in range(10):
        base = rng.choices(vocabulary, k=rng.choice([30, 90, 200]))
        if k % 2:
            base[5:5] = passage
        for _ in range(14):
            # Chains: each text changes the one before, so that far ends are linked only by reach.
            base = [w if rng.random() > 0.004 * rng.randint(0, 4) else rng.choice(vocabulary) for w in base]
            out.append((at * 7 % 997, " ".join(base)))
            at += 1
    out += [(2000 + k, " ".join(passage[:30] + rng.choices(vocabulary, k=20))) for k in range(20)]
    out += [(3000, None), (3001, ""), (3002, "one two"), (3003, "One  two"), (3004, " \t"), (None, out[0][1]), (3005, out[5][1].upper()), (3006, "two one"), (3007, "x " * 30_000)]
    return out


@pytest.mark.parametrize(("percent", "sizes"), [(90, {}), (90, {"block": 2, "chunk": 2, "part_rows": 10, "part_entries": 300}), (60, {"block": 3, "chunk": 3})])
def test_join_groups(spark, rows, percent, sizes):
    want, links = slow(rows, 3, percent)
    assert len(links) > 50
    found = setjoin.join_groups(frame(spark, rows).repartition(4), shingle=3, percent=percent, **sizes).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == want


def test_repeated_ids_and_empty(spark, rows):
    some = [(5, rows[0][1]), (5, rows[70][1]), (9, rows[70][1]), (3, rows[0][1]), (5, None)]
    found = setjoin.join_groups(frame(spark, some), shingle=3, percent=90).collect()
    assert sorted((r.doc_id, r.n_shingles > 0, r.component_id) for r in found) == [(3, True, 3), (5, False, 5), (5, True, 3), (5, True, 3), (9, True, 3)]
    assert setjoin.join_groups(frame(spark, [])).count() == 0


def test_the_filter_holds_every_wanted_id(spark):
    ids = spark.range(200_000).select((F.col("id") * 7 - 90_000).alias("id"))
    bits = setjoin.bits_of(ids)
    at = ids.select(F.pmod(F.xxhash64("id"), F.lit(setjoin.FILTER_BITS)).alias("bit")).toPandas()["bit"].to_numpy()
    assert ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all()
    assert np.bitwise_count(bits).sum() == len(np.unique(at))


def test_derived_overlaps_are_the_counted_ones():
    """Links of members come out of the heads' overlap and the differences alone."""
    rng = np.random.default_rng(4)
    for _ in range(300):
        x = np.unique(rng.integers(0, 300, rng.integers(5, 80)).astype(np.uint64))
        z = np.unique(np.concatenate((x[rng.random(len(x)) < 0.9], rng.integers(0, 300, 6).astype(np.uint64))))

        def near(s, k):
            return np.unique(np.concatenate((s[rng.random(len(s)) < 0.95], rng.integers(0, 300, k).astype(np.uint64))))

        ys, ws = ([(at + k, near(s, k)) for k in range(5)] for at, s in ((0, x), (10, z)))
        changes = [[(name, len(m), np.setdiff1d(m, head), np.setdiff1d(head, m)) for name, m in some] for some, head in ((ys, x), (ws, z))]
        real = {(b, a) for a, y in ys for b, w in ws if 100 * len(np.intersect1d(y, w)) >= 80 * len(np.union1d(y, w))}
        link = setjoin.derived_link(x, z, setjoin.common(x, z), *changes, 80)
        assert link in real if real else link is None


def test_lists_of_one_pair_are_not_labelled_again(spark, monkeypatch):
    held = {}
    monkeypatch.setattr(setjoin, "staged", lambda df, name, staged=setjoin.staged: held.setdefault(name, staged(df, name)))
    rows = [(1, 10, 20), (2, 10, 20), (2, 30, 20), (3, 10, 40), (3, 20, 40)]
    stars = spark.createDataFrame([(t, a, b, 9, 9, 0, 0) for t, a, b in rows], setjoin.STARS)
    of = spark.createDataFrame([(10, 20, 10), (20, 20, 10), (40, 20, 10)], "name long, head long, component long")
    marks = bytearray(setjoin.MARK_BITS // 8)
    classes = spark.createDataFrame([(k, 9, marks) for k in (10, 20, 30, 40)], "name long, n long, marks binary")
    found = setjoin.open_pairs(stars, of, classes, 90, 512, 100).collect()
    # List 1 has one pair, list 3 one component; of list 2, each class stands once.
    assert sorted((r.token, r.name, r.head, r.component) for r in held["join-known"].filter("token < 3").collect()) == [(2, 10, 20, 10), (2, 20, 20, 10), (2, 30, 30, 30)]
    assert [tuple(sorted(r)) for r in found] == [(20, 30)]
