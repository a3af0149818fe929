"""Operators on texts against brute force and the tokenizer libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from hearsay.llm import bpe, exact_dedup, minhash, packing, queries, substring_dedup, token_files, words
from hearsay.llm.pieces import split
from hearsay.session import scratch_path

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LIBRARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, source string, part int, kept string"


def frame(spark, rows):
    """Texts with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "s", 7, "x") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["the", "Of", "naïve", "x1", "don't", "we'll", "\n", " ", "!!", "中文", "é", " ", "<|endoftext|>"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(40)]
    return rows + [(40, None), (41, ""), (42, "a" * 5000), (43, "\t \n"), (None, "no id"), (7, "the same id again")]


def test_split_equals_the_pattern():
    rng = random.Random(1)
    pattern = regex.compile(public_tokenizers.PATTERN)
    signs = list("  \n\t'stmdrevlLS1²é!?\xa0 中")
    some = ["".join(rng.choices(signs, k=rng.randint(0, 14))) for _ in range(20000)]
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    some += ["".join(f"x{c}{c} {c}1{c} ! {c}" for c in points[at:at + 500]) for at in range(0, len(points), 500)]
    pieces, counts = split(some)
    pieces, at = pieces.to_pylist(), 0
    for text, n in zip(some, counts.tolist(), strict=True):
        assert pieces[at:at + n] == [p.encode() for p in pattern.findall(text)]
        at += n


def test_bpe_equals_the_library_and_comes_back(spark, texts):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    found = bpe.decode(bpe.encode(frame(spark, texts), RANKS), RANKS).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in found) == sorted((str(i), (t or "").encode()) for i, t in texts)
    want = sorted((str(i), library.encode_ordinary(t or "")) for i, t in texts)
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in found) == want
    assert bpe.encode(frame(spark, []), RANKS).count() == 0


def test_long_and_short_pieces_merge_alike():
    merges = bpe.Merges(bpe.load_ranks(RANKS))
    rng = random.Random(3)
    for n in (2, 3, 8, 40, 64):
        some = ["".join(rng.choices("abcin té", k=n)).encode() for _ in range(200)]
        width = 1 << (max(map(len, some)) - 1).bit_length()
        flat, counts = merges.encode_side_by_side(some, width)
        assert np.split(flat, np.cumsum(counts)[:-1])[5].tolist() == merges.encode_long(some[5])
        assert flat.tolist() == [x for s in some for x in merges.encode_long(s)]


def test_token_files_round_trip(spark, texts):
    folder = scratch_path(spark, "tokens")
    token_files.write_token_files(frame(spark, texts), folder, LIBRARY, image_ids=100)
    found = token_files.read_token_files(spark, folder).collect()
    library = Tokenizer.from_file(LIBRARY)
    library.encode_special_tokens = True
    at = 0
    order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    for row, (doc, text) in zip(sorted(found, key=lambda r: r.start), order, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert (row.doc_id, row.start, np.frombuffer(row.ids, "<u4").tolist()) == (doc, at, ids)
        at += len(ids)
    empty = scratch_path(spark, "tokens")
    token_files.write_token_files(frame(spark, []), empty, LIBRARY)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_token_files_match_added_tokens_as_the_library(spark, tmp_path):
    """The query against the library at its defaults, on the whole text."""
    end = "<|endoftext|>"
    some = [f"a b{end} c", end, end * 3, f" {end} ", f"{end}x", f"x{end}", f"don{end}'t  {end}\n\n{end} é中", "<|endoftext|", f"<|{end}|>", "", None, "plain text", "<|ENDOFTEXT|>"]
    rng = random.Random(8)
    some += ["".join(rng.choices([end, " ", "the", " of", "'s", "\n", "<|", "|>", "中"], k=rng.randint(1, 30))) for _ in range(200)]
    frame(spark, list(enumerate(some))).write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.QUERIES["op7_token_files"](spark, str(tmp_path)).collect()
    library = Tokenizer.from_file(LIBRARY)
    at = 0
    for row, text in zip(sorted(found), some, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_blocks_hold_any_ids():
    rng = np.random.default_rng(1)
    for n in (1, 1023, 1024, 5000):
        ids = rng.integers(0, 300, n).astype("<u4")
        ids[rng.integers(0, n, max(1, n // 50))] = rng.integers(0, 2**32, max(1, n // 50))
        names, ends, back = token_files.read_image(token_files.write_image([5, None], np.array([n // 2, n]), ids))
        assert names == [5, None] and ends.tolist() == [n // 2, n] and back.tolist() == ids.tolist()


@pytest.mark.parametrize("bits", [64, 2])
def test_exact_groups(spark, bits):
    """With two bits of hash nearly all chunks collide; the answers are the same."""
    rng = random.Random(2)
    base = [" ".join(rng.choices(["aa", "bb. ", "cc\n", "É"], k=900)) for _ in range(6)]
    rows = [(i, rng.choice(base)) for i in range(60)] + [(100, base[0].upper()), (101, None), (102, ""), (3, base[1]), (3, base[1]), (None, base[2]), (None, "alone")]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = exact_dedup.exact_groups(frame(spark, rows), bits=bits).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(lower), []).append(i)
    want = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        seen = set()
        for i in ids:
            want.append((str(i), str(keep), len(ids), i == keep and i not in seen, hashlib.sha256(text.encode()).hexdigest()))
            seen.add(i)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in found) == sorted(want)
    assert exact_dedup.exact_groups(frame(spark, []), bits=bits).count() == 0


def thue_morse(n):
    """Two words of ``n`` letters on which every polynomial modulo 2**64 agrees from 1,024 letters on."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_different_words_are_not_taken_for_equal(spark):
    common = " ".join(f"w{i}" for i in range(12))
    for n in (1024, 4096):
        one, two = thue_morse(n)
        cut = substring_dedup.remove_shared(frame(spark, [(1, f"{common} {one}"), (2, f"{common} {two}"), (3, f"{common} {one}")]))
        assert sorted((r.doc_id, r.n_removed) for r in cut.collect()) == [(1, 0), (2, 0), (3, 13)]
        found = minhash.near_groups(frame(spark, [(1, one), (2, two), (3, one.upper())]), shingle=4)
        assert sorted((r.doc_id, r.component_id, r.kept) for r in found.collect()) == [(1, 1, True), (2, 2, True), (3, 1, False)]
        spaced = [" ".join(w) for w in (one, two)]
        hashed = words.hash_words([t.encode() for t in spaced], both=True)
        for lane, values in enumerate((hashed.hashes, hashed.other)):
            assert words.runs(values[:n], n, lane)[0] != words.runs(values[n:], n, lane)[0]


def test_word_hashes_follow_the_words():
    rng = random.Random(3)
    some = ["".join(rng.choices("abé中", k=rng.randint(1, 40))) for _ in range(500)]
    texts = [" \t".join(rng.choices(some, k=rng.randint(0, 30))).encode() for _ in range(100)]
    found = words.hash_words(texts, both=True)
    split = [w for t in texts for w in t.split()]
    assert found.counts.tolist() == [len(t.split()) for t in texts] and len(found.hashes) == len(split)
    for values in (found.hashes.tolist(), found.other.tolist()):
        assert len(set(zip(split, values, strict=True))) == len(set(split)) == len(set(values))


def test_substring_dedup(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "A", "a"]
    passages = [rng.choices(vocabulary, k=rng.randint(10, 30)) for _ in range(6)]
    rows = []
    for i in rng.sample(range(1000), 60):
        words = rng.choices(vocabulary, k=rng.randint(0, 40))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(passages)
        rows.append((i, rng.choice(["  ", " ", "\n"]).join(words)))
    rows += [(5000, None), (5001, ""), (rows[0][0], rows[1][1]), (None, rows[2][1])]
    starts = {}
    for i, t in rows:
        words = (t or "").split()
        for at in range(len(words) - 12) if i is not None else ():
            starts.setdefault(tuple(words[at:at + 13]), set()).add(i)
    want = []
    for i, t in rows:
        words = (t or "").split()
        gone = set()
        for at in range(len(words) - 12):
            if i is not None and min(starts[tuple(words[at:at + 13])]) < i:
                gone |= set(range(at, at + 13))
        want.append((str(i), len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    names = ("n_words", "n_removed", "left_words")
    for size in (8 << 20, 2000):
        cut = substring_dedup.remove_shared(frame(spark, rows).repartition(5), carry=("source", "part", "kept"), names=names, part_bytes=size)
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.left_words) for r in cut.collect()) == sorted(want)
    assert substring_dedup.remove_shared(frame(spark, [])).count() == 0


@pytest.mark.parametrize("block", [256, 3])
def test_near_groups(spark, block):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, at = [], 0
    for _ in range(8):
        base = rng.choices(vocabulary, k=60)
        for _ in range(12):
            own = [w if rng.random() > 0.012 * rng.randint(0, 4) else rng.choice(vocabulary) for w in base]
            rows.append((at * 7 % 997, " ".join(own)))
            at += 1
    rows += [(2000, None), (2001, ""), (2002, "one two"), (2003, "One  two"), (2004, " \t"), (None, rows[0][1]), (2005, rows[5][1].upper())]

    def members(text):
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
        return {tuple(words[k:k + 4]) for k in range(len(words) - 3)} or ({tuple(words)} if words else set())

    sets = [(i, members(t)) for i, t in rows]
    label = {i: i for i, _ in rows if i is not None}
    changed = True
    while changed:
        changed = False
        for i, x in sets:
            for j, y in sets:
                if i is None or j is None or not x or not y or 100 * len(x & y) < 80 * len(x | y):
                    continue
                if label[i] > label[j]:
                    label[i] = label[j]
                    changed = True
    want = sorted((str(i), len(x), str(label.get(i)), i == label.get(i)) for i, x in sets)
    found = minhash.near_groups(frame(spark, rows).repartition(3), shingle=4, block=block).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in found) == want
    assert minhash.near_groups(frame(spark, [])).count() == 0


def slow_best_fit(items, capacity, per_source):
    bins, out = [], []
    for n, s, c in items:
        best = None
        for k, b in enumerate(bins):
            room = capacity - sum(x[0] for x in b)
            if room >= n and sum(x[1] == s >= 0 for x in b) < per_source and not any(x[2] == c >= 0 for x in b):
                if best is None or room < best[0]:
                    best = (room, k)
        if best is None:
            bins.append([])
            best = (capacity, len(bins) - 1)
        bins[best[1]].append((n, s, c))
        out.append(best[1])
    return out


def test_best_fit_equals_a_search_of_all_bins():
    rng = random.Random(8)
    for _ in range(30):
        items = sorted(((rng.randint(0, 50), rng.randint(-1, 3), rng.randint(-1, 30)) for _ in range(120)), reverse=True)
        bins, offsets = packing.best_fit(*map(list, zip(*items, strict=True)), 50, 2)
        assert bins == slow_best_fit(items, 50, 2)
        assert all(o + n <= 50 for o, (n, _, _) in zip(offsets, items, strict=True))


def test_pack_keeps_every_token(spark):
    rows = [(i, "w " * (i * 3 % 41)) for i in range(80)] + [(90, None), (91, ""), (3, "again"), (None, "no id")]
    found = packing.pack(frame(spark, rows), capacity=16, per_source=3, shard_rows=30).collect()
    total = {}
    for r in found:
        total[str(r.doc_id)] = total.get(str(r.doc_id), 0) + r.n_tokens
    want = {}
    for i, t in rows:
        want[str(i)] = want.get(str(i), 0) + len((t or "").split())
    assert total == want
    for place in {(r.shard, r.bin) for r in found}:
        inside = sorted((r.bin_offset, r.n_tokens) for r in found if (r.shard, r.bin) == place)
        assert len(inside) <= 3 and all(a[0] + a[1] <= b[0] or a[1] == 0 for a, b in zip(inside, inside[1:], strict=False))
        assert inside[-1][0] + inside[-1][1] <= 16
    assert packing.pack(frame(spark, [])).count() == 0


def test_packing_keeps_large_ids_beside_null(spark):
    """Ids above 2**53 and clusters that differ by one, in a shard with a row that has neither."""
    rows = [(2**62 + 1, "a b", 2**62 + 1), (2**62 + 3, "a b", 2**62 + 2), (-(2**61) - 1, "c", 5), (0, "d", 0), (None, None, None)]
    docs = spark.createDataFrame([(i, t, None, c) for i, t, c in rows], "doc_id long, text string, source string, twins long")
    found = packing.pack(docs, cluster=packing.F.col("twins")).collect()
    assert sorted(map(str, (r.doc_id for r in found))) == sorted(str(i) for i, _, _ in rows)
    assert {r.bin for r in found} == {0} and sum(r.n_tokens for r in found) == 6
    assert packing.pack(docs).columns == ["doc_id", "segment", "n_tokens", "shard", "bin", "bin_offset"]


def test_equal_rows_go_to_many_shards_and_empty_texts_have_no_cluster(spark):
    many = spark.range(9000).select(
        packing.F.lit(None).cast("long").alias("doc_id"), packing.F.lit("one two").alias("text"), packing.F.lit("s").alias("source"), packing.F.lit(1).alias("shard"))
    found = packing.pack(many, capacity=8, shard_rows=100).groupBy("shard").count().collect()
    assert len(found) == 90 and sum(r["count"] for r in found) == 9000 and max(r["count"] for r in found) < 200
    for source, bins in ((None, 1), ("s", 75)):
        empty = spark.createDataFrame([(i, t, source) for i, t in enumerate(["", None, " \n"] * 100)], "doc_id long, text string, source string")
        assert packing.pack(empty, per_source=4).select("shard", "bin").distinct().count() == bins


def test_packing_of_a_very_long_text_and_ties(spark):
    rows = [(1, "w " * 200_003), (2, "a b c"), (3, "d e f"), (4, "a b c")]
    first, again = (sorted(map(tuple, packing.pack(frame(spark, r), capacity=4096, per_source=1).collect())) for r in (rows, rows[::-1]))
    assert first == again
    assert sum(r[2] for r in first if r[0] == 1) == 200_003 and max(r[2] for r in first) == 4096
    same = {r[0]: r[4] for r in first}
    assert same[2] != same[4]
