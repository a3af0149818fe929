"""One query per operator over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.llm import bpe, chat, exact_dedup, language, merkle, minhash, negatives, packing, quality, setjoin, substring_dedup, token_files, topk
from hearsay.llm.common import crc_fold
from hearsay.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(table(spark, sf_dir, "documents"), path)
    return bpe.decode(encoded, path).select(
        "doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    path = public_tokenizers.path("byte_bpe_50k.json")
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder, path, added_tokens=True)
    back = token_files.read_token_files(spark, folder)
    return back.select("doc_id", "start", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL["op8_exact_dedup"] = f"""
    WITH t AS (SELECT doc_id, {LOWER} AS t FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
      doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
    FROM t WINDOW w AS (PARTITION BY t)"""


CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


@query
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = [(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)]
    added = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    read = chat.parse(chat.windows(given.unionByName(added)))
    # The system turn is retained in every window; the first window counts it.
    system_first = F.get(F.col("turns"), F.lit(0))["role"] == "system"
    is_first = F.col("window_start") == 0
    own = F.slice("turns", F.col("context_turns") + 1, F.size("turns"))
    own = F.when(is_first & (F.col("context_turns") > 0) & system_first, F.concat(F.slice("turns", 1, 1), own)).otherwise(own)
    told = F.array_join(F.transform(own, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = read.select(
        "conv_id", F.struct("window_start", told.alias("told"), F.array_join("loss_texts", "").alias("loss")).alias("part"),
        F.size(own).alias("n"), F.char_length("formatted").alias("chars"),
    )
    # The digests are of whole conversations, so the texts of one conversation meet here.
    whole = parts.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.array_sort(F.collect_list("part")).alias("parts"), F.sum("chars").alias("formatted_chars")
    )
    loss = F.array_join(F.transform("parts", lambda p: p["loss"]), "")
    turns = F.array_join(F.transform("parts", lambda p: p["told"]), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(turns.cast("binary"), 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


@query
def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE_SQL["op10_exact_topk"] = """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), pairs AS (
      SELECT q.vec_id AS query_id, c.vec_id,
        CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
    ), ranked AS (
      SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs
    )
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_shared(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"), shingle=4)


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = crc_fold(F.col("doc_id"), 5)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold != 0)
    return quality.score(docs, model).select("doc_id", (fold == 0).alias("held_out"), "score", "predicted")


@query
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = crc_fold(F.col("doc_id"), 3)
    found = language.predict(docs, language.fit(docs, fold != 1))
    return found.select("doc_id", (fold == 1).alias("held_out"), "lang_pred", "score")


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = merkle.manifest(table(spark, sf_dir, "documents"), tampered={"n_chars": F.col("n_chars") + 1}, where=touched)
    folded = rows.withColumn("folded_root", merkle.fold(F.coalesce("tampered_leaf", "leaf"), F.col("siblings")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("siblings")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def told(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(told(v) for v in ("doc_id", "source", "lang", n_chars, "text")) + ")"


# The crc32 of a decimal number, bit by bit.
CRC32_SQL = """xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda i: CAST(0 AS BIGINT))),
      lambda a, i: xor(a >> 1, (a & 1) * 3988292384))))"""

ORACLE_SQL["op12_merkle_manifest"] = f"""
    WITH RECURSIVE given AS (
      SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf_sql("n_chars")} AS leaf,
        CASE WHEN {CRC32_SQL} % 7 = 0 THEN {leaf_sql("n_chars + 1")} END AS other FROM documents
    ), leaves AS (
      SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS slot, count(*) OVER (PARTITION BY g) AS n FROM given
    ), tree AS (
      SELECT g, 0 AS lvl, slot, leaf AS h, n FROM leaves
      UNION ALL
      SELECT g, lvl + 1, slot // 2, sha256(string_agg(h, '' ORDER BY slot)), (n + 1) // 2 FROM tree WHERE n > 1 GROUP BY g, lvl, slot // 2, n
    ), subroots AS (
      SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS slot, count(*) OVER () AS n FROM tree WHERE n = 1
    ), top AS (
      SELECT 0 AS lvl, slot, subroot AS h, n FROM subroots
      UNION ALL
      SELECT lvl + 1, slot // 2, sha256(string_agg(h, '' ORDER BY slot)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY lvl, slot // 2, n
    ), paths AS (
      SELECT l.g, l.slot, t.lvl, coalesce(s.h, '') AS h, t.slot % 2 = 1 AS lf
      FROM leaves l JOIN tree t ON t.g = l.g AND t.slot = l.slot >> t.lvl AND t.n > 1
      LEFT JOIN tree s ON s.g = t.g AND s.lvl = t.lvl AND s.slot = xor(t.slot, 1)
      UNION ALL
      SELECT l.g, l.slot, 100 + t.lvl, coalesce(s.h, ''), t.slot % 2 = 1
      FROM leaves l JOIN subroots r ON r.g = l.g JOIN top t ON t.slot = r.slot >> t.lvl AND t.n > 1
      LEFT JOIN top s ON s.lvl = t.lvl AND s.slot = xor(t.slot, 1)
    ), proofs AS (
      SELECT g, slot, sha256(string_agg(h, '' ORDER BY lvl)) AS proof, list({{'h': h, 'lf': lf}} ORDER BY lvl) AS path FROM paths GROUP BY g, slot
    ), folded AS (
      SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE n = 1) AS root, coalesce(proof, sha256('')) AS proof_sha256,
        list_reduce(list_prepend({{'h': coalesce(other, leaf), 'lf': false}}, coalesce(path, [])),
          lambda a, s: {{'h': sha256(CASE WHEN s.lf THEN s.h || a.h ELSE a.h || s.h END), 'lf': false}}).h AS folded_root
      FROM leaves LEFT JOIN proofs USING (g, slot) JOIN subroots USING (g)
    )
    SELECT *, folded_root = root AS verified FROM folded"""


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


ORACLE_SQL["op13_hard_negatives"] = """
    WITH v AS (
      SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
      WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), pairs AS (
      SELECT a.r AS ar, c.r AS cr, a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.r <> c.r
    ), positives AS (
      SELECT * FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, cr) <= 5
    ), found AS (
      SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
        CAST(row_number() OVER (PARTITION BY p.ar, p.cr ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank
      FROM positives p JOIN pairs n ON n.ar = p.ar AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
    )
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 10"""


@query
def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.join_groups(table(spark, sf_dir, "documents"), shingle=3, percent=90)


ORACLE_SQL["op11_jaccard_join"] = f"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
    ), s AS (
      SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w
    ), n AS (
      SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
    ), e AS (
      SELECT s.doc_id, g, n FROM s JOIN n USING (doc_id)
    ), links AS (
      SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
    ), sides AS (
      SELECT x, y FROM links UNION ALL SELECT y, x FROM links
    ), reach AS (
      SELECT doc_id AS x, doc_id AS y FROM documents
      UNION
      SELECT r.x, b.y FROM reach r JOIN sides b ON b.x = r.y
    ), low AS (
      SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x
    )
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM low LEFT JOIN n USING (doc_id)"""
