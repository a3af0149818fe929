"""Chat windows, top-k, classifiers and the pipeline."""

import hashlib
import os
import sys

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline
from hearsay.llm import chat, language, quality, queries, topk

SMALL = "/root/testdata/sf0.001"


def test_windows_hold_each_turn_once(spark):
    rows = [(1, 0, "system", "be & <|im_end|>\n kind"), (2, 0, "user", None), (2, 1, "assistant", "&lt;| ok"), (3, 0, "system", "alone"), (None, 5, "user", "no conversation")]
    rows += [(1, k, "assistant" if k % 2 == 0 else "user", f"turn {k} " + "word " * (k * 7 % 23)) for k in range(1, 1400)]
    rows += [(4, 1, "us\ner", "tie"), (4, 1, "assistant", "tie"), (4, 1, "assistant", "tie"), (4, None, None, "")]
    turns = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, tokens int, kind string")
    found = chat.parse(chat.windows(turns, budget=120, history=40)).collect()
    told, learned = {}, {}
    for r in sorted(found, key=lambda r: (str(r.conv_id), r.window_start)):
        assert r.n_tokens <= 120 or len(r.turns) - r.context_turns == 1 or r.conv_id == 1
        own = r.turns[r.context_turns:]
        if r.window_start == 0 and r.context_turns and r.turns[0].role == "system":
            own = [r.turns[0], *own]
        told.setdefault(r.conv_id, []).extend((t.role, t.text) for t in own)
        learned.setdefault(r.conv_id, []).extend(r.loss_texts)
        if r.conv_id == 1:
            assert r.turns[0].text == "be & <|im_end|>\n kind"
    want = {}
    for c, n, role, text in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert told == want
    assert {c: [t for role, t in w if role == "assistant"] for c, w in want.items()} == {c: learned.get(c, []) for c in want}
    assert chat.windows(turns.limit(0)).count() == 0


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.3, 6).round(1).tolist()) for i in range(300)]
    rows += [(300, None), (301, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (20, rows[20][1]), (None, rows[1][1]), (305, [1.0, 2.0]), (320, [1e12] * 6), (340, [-1e18] * 6)]
    vectors = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, shard int")
    good = [(n, i, [int(max(np.floor(64 * x), -2.0**63)) for x in v]) for n, (i, v) in enumerate(rows)
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for n, i, q in good:
        if i % 20 == 0:
            scores = sorted((-min(max(sum(a * b for a, b in zip(q, v, strict=True)), -2**63), 2**63 - 1), j) for m, j, v in good if m != n and len(v) == len(q))
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scores[:5])]
    for sizes in ({}, {"shard_rows": 40, "block_queries": 4}):
        found = topk.top_k(vectors, F.col("vec_id") % 20 == 0, k=5, **sizes).collect()
        assert sorted(tuple(r) for r in found) == sorted(want)
    assert topk.top_k(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_quality_on_held_out_rows(spark):
    found = queries.QUERIES["op2_quality"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    held = found.filter("held_out").toPandas()
    assert (held.predicted == held.quality).mean() > 0.9
    assert held.predicted[held.quality == 1].mean() > 0.98


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (1, "", 0.5), (None, "words here", 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(9, None), (1, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels, F.lit(True))
    found = quality.score(docs.drop("score"), model).collect()
    assert len(found) == 3 and all(r.score == 0.5 and r.predicted == 1 for r in found)
    assert quality.score(docs.drop("score").limit(0), model).count() == 0


def test_word_vectors_cover_rows_without_label(spark):
    """The sums are those of all documents to learn from, by brute force; one row is labelled, one held out."""
    texts = ["Only this One has a label", "but others, too, say 12 words", None, "", "but others, too: say more", "never learned from"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    found = quality.fit(docs, labels, F.col("doc_id") != 5).vectors
    index = quality.index_vectors()
    want = index.astype(float)
    for text in texts[:5]:
        words, shapes, _ = quality.token_numbers([(text or "").encode()])
        for tokens in (words.tolist(), shapes.tolist()):
            for i, token in enumerate(tokens):
                for j in range(max(0, i - quality.WINDOW), min(len(tokens), i + quality.WINDOW + 1)):
                    if j != i:
                        want[token] += index[tokens[j]]
    assert np.allclose(found, want / np.sqrt((want * want).sum(axis=1, keepdims=True)), atol=1e-5)


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = queries.QUERIES["op4_language"](spark, "/root/testdata/sf0.01").join(docs, "doc_id").filter("held_out").toPandas()
    assert (held.lang_pred == held.lang).mean() > 0.97 and held.score.between(0, 1).all()


def test_languages_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "xx"), (2, "", "xx"), (3, "12 !?", "xx"), (4, "aaa bbb", "xx"), (4, "zzz qqq", "yy"), (None, "aaa", None)], "doc_id long, text string, lang string")
    found = language.predict(docs, language.fit(docs, F.lit(True))).collect()
    assert [r.lang_pred for r in found][:3] == ["und"] * 3 and {r.lang_pred for r in found[3:]} <= {"xx", "yy"}
    assert {r.lang_pred for r in language.predict(docs, language.fit(docs.limit(0), F.lit(True))).collect()} == {"und"}


def test_long_texts_of_large_scripts_keep_their_language(spark):
    """30,000 signs of two alphabets of 6,000: more different n-grams than any small map of features has places."""
    rng = np.random.default_rng(7)
    odds = 1 / np.arange(1, 6001)
    rows = [(i, "".join(map(chr, (0x4E00, 0x20000)[i % 2] + rng.choice(6000, 30_000, p=odds / odds.sum()))), ("one", "two")[i % 2]) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.predict(docs, language.fit(docs, F.col("doc_id") < 6)).collect()
    assert [(r.doc_id, r.lang_pred) for r in sorted(found)] == [(i, lang) for i, _, lang in rows]
    assert min(r.score for r in found) > 0.9


def test_kernels_of_landmarks_are_those_of_sets():
    texts = ["", "a", "abcabc", "Äbc ab", "\U00020000\U00020001x", "zz"]
    sets = [{t.lower()[i:i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in texts]
    want = [[len(a & b) / max(1, len(a) * len(b)) ** 0.5 for b in sets[:4]] for a in sets]
    found = [language.grams(t) for t in texts]
    assert [len(f) for f in found] == [len(s) for s in sets]
    marks = language.Landmarks.of(found[:4])
    assert np.allclose(marks.kernels(found), want) and np.allclose(marks.products(found, np.eye(4)), want)


def test_pipeline_stages_do_what_they_decide(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, SMALL)
        if name != "best-fit packing":
            assert out.columns == docs.columns
            path = str(tmp_path / name.replace(" ", "-"))
            out.write.parquet(path)
            out = spark.read.parquet(path)
        if name == "exact dedup":
            latest = {}
            for r in before.collect():
                key = hashlib.sha256(bytes((r.text or "").encode()).lower()).hexdigest()
                latest[key] = max(latest.get(key, -1), r.doc_id)
            assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(latest.values())
        before = out
    assert before.select("doc_id").distinct().count() == spark.read.parquet(str(tmp_path / "substring-dedup")).count()
