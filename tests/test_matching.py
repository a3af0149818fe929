import numpy as np
import pytest
from pyspark.sql import functions as F

from hearsay.operators import matching as ma
from hearsay.operators import automaton
from hearsay.operators.textsearch import find_terms

TEXTS = [
    (1, 10, "I love Taylor Swift!"),
    (2, 10, "T-Swift is amazing"),
    (3, 10, "Taylor and Ryan are great"),
    (4, 11, "Ryan is great"),
    (5, 11, "she said so"),
    (6, 12, "she said so"),
    (7, 12, "gosling, or reynolds"),
    (8, 12, ""),
    (9, 12, "école Taylorx don't"),
    (10, 10, "tay!"),
]
POSTS = [(10, None), (11, "New film with RYAN GOSLING"), (12, "nothing here")]


@pytest.fixture(scope="module")
def frames(spark):
    return (
        spark.createDataFrame(TEXTS, "comment_id long, post_id long, text string"),
        spark.createDataFrame(POSTS, "post_id long, caption string"),
    )


def test_tiers(spark, rows, catalog, frames):
    comments, posts = frames
    got = {(r[0], r[1]): (r[2], r[3]) for r in rows(ma.catalog_mentions(comments, catalog, posts))}
    assert got == {
        (1, "e1"): ("taylor swift", 1.0),
        (2, "e1"): ("t-swift", 0.9),
        (3, "e1"): ("taylor", 0.65),
        # Two entities are called Ryan: only the one in the caption counts.
        (4, "e3"): ("ryan", 0.75),
        (5, "e3"): ("pronoun", 0.45),
        (7, "e2"): ("reynolds", 0.6),
        # "gosling" starts with the alias "gos".
        (7, "e3"): ("gos", 0.9),
        # The alias belongs to the entity that claimed it last, here inside "Taylor" too.
        (1, "e4"): ("tay", 0.9),
        (3, "e4"): ("tay", 0.9),
        (9, "e4"): ("tay", 0.9),
        (10, "e4"): ("tay", 0.9),
    }


def test_no_context_without_posts(rows, catalog, frames):
    comments, _ = frames
    got = {(r[0], r[1]) for r in rows(ma.catalog_mentions(comments, catalog))}
    assert (4, "e3") not in got and (5, "e3") not in got and (3, "e1") in got


def test_alias_table_last_claim_wins(rows, catalog):
    got = dict(rows(ma.alias_table(catalog)))
    assert got["tay"] == "e4" and got["t-swift"] == "e1" and got["gos"] == "e3"


@pytest.mark.parametrize("table_bytes", [automaton.TABLE_BYTES, 60])
def test_terms_in_texts(spark, rows, table_bytes):
    """Terms inside terms, several rows of a term, and one table or several."""
    texts = spark.createDataFrame(
        [(1, "aXb% the_thing é😀"), (2, "the thing"), (3, None), (4, "ab"), (5, "THE_THING" * 50), (6, "")], "id long, t string"
    )
    terms = spark.createDataFrame(
        [(1, "a"), (2, "xb%"), (3, "the_thing"), (4, "é😀"), (5, "ab"), (6, "thing the"), (7, "a"), (8, "")], "ord int, term string"
    )
    assert {(r[0], r[1], r[2]) for r in rows(find_terms(texts, "t", terms, table_bytes))} == {
        (1, 1, "a"), (1, 7, "a"), (1, 2, "xb%"), (1, 3, "the_thing"), (1, 4, "é😀"), (4, 1, "a"), (4, 7, "a"), (4, 5, "ab"), (5, 3, "the_thing")
    }
    assert rows(find_terms(texts, "t", terms.limit(0), table_bytes)) == []


def test_the_automaton_finds_what_contains_finds():
    """All terms of several lengths over a small alphabet, in texts on both sides of every cut."""
    rng = np.random.default_rng(3)
    for size in (1, 10, 400, 3000):
        terms = sorted({bytes(rng.choice(list(b"ab\xc3\xa9 "), rng.integers(1, 12)).astype(np.uint8)) for _ in range(size)})
        machine = automaton.build(terms)
        texts = [bytes(rng.choice(list(b"ab\xc3\xa9 x"), rng.integers(0, 900)).astype(np.uint8)) for _ in range(20)] + [b""]
        ends = np.cumsum([len(t) for t in texts])
        text, term = automaton.walk(machine, np.frombuffer(b"".join(texts), np.uint8), ends - [len(t) for t in texts], ends)
        assert list(zip(text.tolist(), term.tolist(), strict=True)) == [(i, k) for i, t in enumerate(texts) for k, x in enumerate(terms) if x in t]


def test_a_list_of_many_terms(spark, rows):
    """60,000 terms go through the plan of ten."""
    terms = spark.range(60_000).select(F.col("id").alias("ord"), F.concat(F.lit("name "), F.col("id").cast("string"), F.lit(".")).alias("term"))
    texts = spark.createDataFrame([(1, "Name 5. and name 59999."), (2, "name 60000."), (3, "name 7.name 77.")], "id long, t string")
    assert rows(find_terms(texts, "t", terms), "id", "ord") == [(1, 5), (1, 59999), (3, 7), (3, 77)]
    few, many = (find_terms(texts, "t", terms.limit(n))._jdf.queryExecution().executedPlan().toString().split("Subquery")[0] for n in (10, 60_000))
    assert few.count("pythonUDF0") == many.count("pythonUDF0") > 0 and "pythonUDF1" not in few
    assert "Exchange" not in many and "Join" not in many


def test_long_text_is_searched_whole(spark, rows, catalog):
    text = "word " * 20_000 + "taylor swift"
    comments = spark.createDataFrame([(1, 1, text)], "comment_id long, post_id long, text string")
    assert (1, "e1") in {(r[0], r[1]) for r in rows(ma.catalog_mentions(comments, catalog))}


def test_mined_names_exclude_matches(spark, rows, catalog):
    comments = spark.createDataFrame([(1, "Taylor Swift met Jane Doe")], "comment_id long, text string")
    mined = ma.new_mentions(ma.mine_mentions(comments), ma.full_name_mentions(comments, catalog))
    assert rows(mined, "name") == [("Jane Doe",)]


def test_name_parts(rows, catalog):
    parts = {r[0]: r[1:] for r in rows(ma.catalog_name_parts(catalog), "entity_id", "first", "last", "first_unique", "last_unique")}
    assert parts["e2"] == ("ryan", "reynolds", False, True)
    assert parts["e1"] == ("taylor", "swift", True, True)


def test_names_with_special_characters(spark, rows):
    entities = spark.createDataFrame([("x", "A.B (C+)", 1)], "entity_id string, name string, load_order long")
    comments = spark.createDataFrame([(1, "so a.b (c+) it is"), (2, "axb")], "comment_id long, text string")
    assert rows(ma.full_name_mentions(comments, entities).select("comment_id")) == [(1,)]
    assert rows(ma.mention_arrays(comments, entities).select("comment_id", F.size("mentions"))) == [(1, 1), (2, 0)]


@pytest.mark.parametrize("steps", [1 << 20, 7])
def test_chunks_find_what_contains_finds(monkeypatch, steps):
    """Terms of all gram sizes, equal at both ends or not, in texts that hold them inside, at their ends, or across two."""
    import pyarrow as pa

    from hearsay.operators import termjoin

    monkeypatch.setattr(termjoin, "STEPS", steps)
    rng = np.random.default_rng(5)
    for size in (1, 30, 300):
        terms = ["".join(rng.choice(list("abéx "), rng.integers(1, 30))) for _ in range(size)] + ["aaaaaaaa" + x + "bbbbbbbb" for x in ("", "ab", "ba")]
        texts = ["".join(rng.choice(list("abé "), rng.integers(0, 200))) for _ in range(10)] + ["", None, "a" * 12, "xaaaaaaaababbbbbbbb"]
        texts += [x + terms[0] + y for x in ("", "q") for y in ("", "z")] + [terms[0][:-1]]
        text, term = termjoin.find(pa.array(texts, pa.string())[0:], pa.array(terms))
        assert list(zip(text.tolist(), term.tolist(), strict=True)) == [(i, k) for i, t in enumerate(texts) for k, x in enumerate(terms) if t and x in t]


def test_a_list_that_grows_with_the_texts(spark, rows, monkeypatch):
    """A longer list is joined: no task gets all of it, and the result is that of the automaton."""
    from hearsay.operators import textsearch
    from hearsay.operators.termjoin import join_terms

    said = spark.range(300).select("id", F.concat_ws(" ", *[F.concat(F.lit("Wör"), ((F.col("id") * k) % 40).cast("string")) for k in (1, 7, 11)]).alias("t"))
    said = said.union(spark.createDataFrame([(900, None), (901, ""), (902, "wör1")], "id long, t string"))
    terms = said.select(F.explode(F.array(F.lower("t"), F.substring(F.lower("t"), 3, 9), F.substring(F.lower("t"), 2, 3), F.lit(""))).alias("term"))
    terms = terms.distinct().select((F.hash("term") % 50).alias("ord"), "term")
    by_automaton = rows(find_terms(said, "t", terms))
    assert len(by_automaton) > 1000 and rows(join_terms(said, "t", terms, chunk_bytes=100)) == by_automaton
    monkeypatch.setattr(textsearch, "CATALOG_TERMS", 10)
    found = find_terms(said, "t", terms)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert rows(found) == by_automaton


def test_terms_meet_chunks_in_packs_of_bounded_size(monkeypatch):
    """However many terms a part has, a step opens a bounded pack; together the packs hold every term a chunk may hold."""
    import pyarrow as pa

    from hearsay.operators import termjoin as tj

    monkeypatch.setattr(tj, "PACK_BYTES", 2000)
    rng = np.random.default_rng(6)
    texts = {k: ["".join(rng.choice(list("abé "), 60)) for _ in range(8)] for k in range(3)}
    terms = sorted({"".join(rng.choice(list("abé "), rng.integers(1, 20))) for _ in range(900)})
    grams = [tj._chunk_grams(2)(pa.table({"_chunk": pa.array([k] * 8, pa.int32()), "_text": said})) for k, said in texts.items()]
    batches = pa.table({"term": terms, "place": range(len(terms))}).to_batches(max_chunksize=40)
    listed = [pa.Table.from_batches([b]) for b in tj._packed_terms(2)(iter(batches))]
    assert sum(len(tj._opened(b.as_py())) for t in listed for b in t.column("_blob")) == len(terms) and len(listed) > 5
    rows = [row for t in [*grams, *listed] for row in t.to_pylist()]
    rows.sort(key=lambda row: (row["_part"], row["_chunk"] is None))
    packs = [row for b in tj._candidates(iter(pa.Table.from_pylist(rows, grams[0].schema).to_batches(max_chunksize=3))) for row in b.to_pylist()]
    assert max(tj._opened(row["_blob"]).nbytes for row in packs) < 6000
    found = []
    for row in packs:
        opened = tj._opened(row["_blob"])
        text, term = tj.Texts(pa.array(texts[row["_chunk"]])).find(opened.column("term"))
        found += [(row["_chunk"], t, opened.column("place")[n].as_py()) for t, n in zip(text.tolist(), term.tolist(), strict=True)]
    assert sorted(found) == [(k, t, n) for k, said in texts.items() for t, x in enumerate(said) for n, term in enumerate(terms) if term in x]


def test_texts_without_any_candidate(spark, rows):
    from hearsay.operators.termjoin import join_terms

    said = spark.createDataFrame([(1, "abc"), (2, "de")], "id long, t string")
    assert rows(join_terms(said, "t", spark.createDataFrame([("zz", 1)], "term string, ord int"))) == []
    assert rows(join_terms(said, "t", spark.createDataFrame([], "term string, ord int"))) == []
    assert rows(join_terms(said, "t", spark.createDataFrame([("bc", 1), ("e", 2)], "term string, ord int"))) == [(1, "bc", 1), (2, "e", 2)]
