"""Registry of checked queries, and the views that give the tables their roles.

A view is one SQL text that Spark and the checking engine both run, so both
sides start from the same rows. Views read whole tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.tables import Tables

RAW = (
    "region nation customer supplier part orders lineitem events documents"
    " embeddings pages benchmark labels conversations"
).split()

START = "2024-01-08 00:00:00"
END = "2024-01-25 12:00:00"
AS_OF = "2024-01-30 00:00:00"

# Views in dependency order.
VIEWS = {
    # Documents play the posts; the whole text is the caption.
    "posts": """
        SELECT doc_id AS post_id,
          CASE doc_id % 3 WHEN 0 THEN 'instagram' WHEN 1 THEN 'youtube' ELSE 'tiktok' END AS platform,
          concat('D', CAST(doc_id AS VARCHAR(20))) AS external_id,
          concat('https://www.instagram.com/p/D', CAST(doc_id AS VARCHAR(20)), '/') AS url,
          text AS caption
        FROM documents""",
    # Events play the comments of those posts.
    "comments": """
        SELECT event_id AS comment_id,
          event_id % (SELECT count(*) FROM documents) AS post_id,
          concat('user_', CAST(user_id AS VARCHAR(20))) AS author_name,
          CAST(ts AS TIMESTAMP) AS created_at,
          CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS likes
        FROM events""",
    "comment_texts": """
        SELECT c.comment_id, c.post_id, c.author_name, c.created_at, c.likes, p.caption AS text
        FROM comments c JOIN posts p ON c.post_id = p.post_id""",
    # Scores and weights in steps of 1/128, so that sums of doubles are exact in any
    # order; the kind of signal follows the kind of event.
    "scored": """
        SELECT event_id, user_id,
          CASE WHEN user_id % 7 = 0 THEN NULL ELSE user_id % 25 END AS entity_id,
          CASE WHEN event_type = 'signup' THEN 'emotion' WHEN event_type = 'error' THEN 'toxicity'
               WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 'stance'
               WHEN event_type = 'purchase' THEN 'topic' ELSE 'sentiment' END AS signal_type,
          CAST(round(value * 100) AS BIGINT) % 201 - 100 AS c,
          CAST(CAST(round(value * 100) AS BIGINT) % 201 - 100 AS DOUBLE) / CAST(128 AS DOUBLE) AS x,
          CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
        FROM events""",
    "signals": """
        SELECT event_id AS comment_id, entity_id, signal_type,
          CASE signal_type
            WHEN 'sentiment' THEN CASE WHEN x >= 0.7 THEN 'Strongly Positive' WHEN x >= 0.3 THEN 'Positive'
                 WHEN x > -0.3 THEN 'Neutral' WHEN x > -0.7 THEN 'Negative' ELSE 'Strongly Negative' END
            WHEN 'emotion' THEN CASE abs(c) % 4 WHEN 0 THEN 'joy' WHEN 1 THEN 'anger' WHEN 2 THEN 'disgust' ELSE 'neutral' END
            WHEN 'stance' THEN CASE abs(c) % 3 WHEN 0 THEN 'support' WHEN 1 THEN 'oppose' ELSE 'neutral' END
            WHEN 'topic' THEN concat('topic ', CAST(user_id % 40 AS VARCHAR(20)))
            ELSE CASE WHEN abs(x) >= 0.7 THEN 'high' WHEN abs(x) >= 0.4 THEN 'medium' ELSE 'low' END END AS value,
          CASE signal_type WHEN 'sentiment' THEN x WHEN 'toxicity' THEN abs(x) END AS numeric_value,
          CAST(128 + k AS DOUBLE) / CAST(128 AS DOUBLE) AS weight_score
        FROM scored""",
    "entities": """
        SELECT CAST(n_nationkey AS BIGINT) AS entity_id, n_name AS name,
          CASE n_regionkey % 4 WHEN 0 THEN 'person' WHEN 1 THEN 'show' WHEN 2 THEN 'couple' ELSE 'brand' END AS entity_type,
          CAST(n_nationkey AS BIGINT) AS load_order
        FROM nation""",
    # Signals joined to their comments inside the report window.
    "facts": f"""
        SELECT s.comment_id, s.entity_id, s.signal_type, s.value, s.numeric_value, s.weight_score,
          c.post_id, c.created_at, c.likes
        FROM signals s JOIN comments c ON s.comment_id = c.comment_id
        WHERE c.created_at BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'""",
    "all_facts": """
        SELECT s.comment_id, s.entity_id, s.signal_type, s.value, s.numeric_value, s.weight_score,
          c.post_id, c.created_at, c.likes
        FROM signals s JOIN comments c ON s.comment_id = c.comment_id""",
    # Text side: every event as a comment with the text of a document, on posts whose
    # caption opens a conversation.
    "text_keys": """
        SELECT *, event_id % (SELECT count(*) FROM documents) AS said_id,
          event_id % (SELECT count(DISTINCT conv_id) FROM conversations) AS conv_id
        FROM events""",
    "tcomments": """
        SELECT e.event_id AS comment_id, e.conv_id AS post_id,
          concat('user_', CAST(e.user_id AS VARCHAR(20))) AS author_name, d.text AS text,
          CAST(e.ts AS TIMESTAMP) AS created_at,
          CAST(regexp_extract(e.props, '([0-9]+)', 1) AS BIGINT) AS likes
        FROM text_keys e JOIN documents d ON d.doc_id = e.said_id""",
    # The source of each text as a name that its comment mentions.
    "source_mentions": """
        SELECT d.source AS name, t.*
        FROM (SELECT *, comment_id % (SELECT count(*) FROM documents) AS said_id FROM tcomments) t
        JOIN documents d ON d.doc_id = t.said_id""",
    "tposts": """
        SELECT conv_id AS post_id, text AS caption,
          CASE conv_id % 3 WHEN 0 THEN 'instagram' WHEN 1 THEN 'youtube' ELSE 'tiktok' END AS platform,
          concat('https://www.instagram.com/p/C', CAST(conv_id AS VARCHAR(20))) AS url
        FROM conversations WHERE turn = 0""",
    # Replies of a conversation as comments on its opening turn.
    "replies": """
        SELECT conv_id * 1000 + turn AS comment_id, conv_id AS post_id, role AS author_name, text,
          (conv_id * 7 + turn) % 500 AS likes
        FROM conversations WHERE turn > 0""",
    # A small catalog whose names are words of the test language.
    "catalog": """
        SELECT CAST(1 AS BIGINT) AS entity_id, 'Stteen Erachtz' AS name, 'apache' AS alias, CAST(1 AS BIGINT) AS load_order
        UNION ALL SELECT 2, 'Thing Than', 'of the', 2
        UNION ALL SELECT 3, 'Thing Thou', 'public license', 3
        UNION ALL SELECT 4, 'Ther Thin', 'in the', 4
        UNION ALL SELECT 5, 'Elle Les', 'que les', 5
        UNION ALL SELECT 6, 'Der Ung', 'und die', 6
        UNION ALL SELECT 7, 'Than', 'of the', 7""",
    "claims": """
        SELECT entity_id, load_order, lower(name) AS lname, lower(name) AS term, load_order * 10 AS place FROM catalog
        UNION ALL SELECT entity_id, load_order, lower(name), lower(alias), load_order * 10 + 1 FROM catalog""",
    "terms": """
        SELECT t.term, t.place, c.entity_id,
          CASE WHEN t.term = c.lname THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END AS confidence
        FROM (SELECT term, min(place) AS place, max(place) AS owner FROM claims GROUP BY term) t
        JOIN claims c ON c.term = t.term AND c.place = t.owner""",
    # Multi-signal responses for every event; every fifth one is cut short.
    "full_responses": """
        SELECT event_id AS comment_id, c, user_id,
          concat('{"entity_scores": {"NATION_', CAST(user_id % 30 AS VARCHAR(20)), ' (hint)": ',
            CASE WHEN c < 0 THEN '-' ELSE '' END, CASE WHEN abs(c) = 100 THEN '1' ELSE '0' END, '.',
            CASE WHEN abs(c) % 100 < 10 THEN '0' ELSE '' END, CAST(abs(c) % 100 AS VARCHAR(20)),
            CASE WHEN user_id % 11 = 0 THEN ', "Bad Score": 7.5' ELSE '' END,
            '}, "entity_confidence": {"NATION_', CAST(user_id % 30 AS VARCHAR(20)), '": 0.',
            CAST(5 + k % 5 AS VARCHAR(20)), '}, "emotion": "',
            CASE k % 5 WHEN 0 THEN 'Joy' WHEN 1 THEN 'anger' WHEN 2 THEN 'rage' WHEN 3 THEN 'disgust' ELSE 'neutral' END,
            '", "stance": "', CASE k % 4 WHEN 0 THEN 'support' WHEN 1 THEN 'OPPOSE' WHEN 2 THEN 'mixed' ELSE 'neutral' END,
            '", "topics": ["topic ', CAST(user_id % 40 AS VARCHAR(20)), '", "", "lawsuit"], "other_entities": ["Person ',
            CAST(user_id % 17 AS VARCHAR(20)), '", "photo"], "sarcasm": ',
            CASE WHEN k % 3 = 0 THEN 'true' ELSE 'false' END, ', "toxicity": ',
            CASE WHEN k % 10 = 9 THEN '1.7' ELSE concat('0.', CAST(k % 10 AS VARCHAR(20))) END,
            ', "ambiguous_mentions": ', CASE WHEN user_id % 6 = 0
              THEN '[{"name": "Justin", "possible_entities": ["A", "B"], "confidence": 0.4, "reason": "two of them"}]'
              ELSE '[]' END, '}') AS raw_full
        FROM scored""",
    "responses": """
        SELECT comment_id, CASE WHEN user_id % 5 = 0 THEN substr(raw_full, 1, length(raw_full) - user_id * 3 - 1)
          ELSE raw_full END AS raw_json
        FROM full_responses""",
    # Replies at a day of their conversation, and what an analyser answers to each, up to two hours
    # later; some calls fail.
    "run_comments": """
        SELECT *, CAST(TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' DAY * CAST(post_id % 20 AS INT) AS TIMESTAMP) AS created_at,
          comment_id % (SELECT count(*) FROM events) AS asked_id
        FROM replies""",
    "run_responses": """
        SELECT r.comment_id, CASE WHEN r.likes % 9 = 0 THEN NULL ELSE s.raw_json END AS raw_json,
          CAST(r.created_at + INTERVAL '1' HOUR * CAST(r.comment_id % 3 AS INT) AS TIMESTAMP) AS responded_at
        FROM run_comments r JOIN responses s ON s.comment_id = r.asked_id""",
}


# Opened tables, and the folder each table name currently stands for in a session.
_OPENED: dict[tuple, DataFrame] = {}
_REGISTERED: dict[tuple, str] = {}

# A test table is one file with one row group, so one task reads it all. Views whose
# rows are costly to process are spread, as many files would be, by the narrow rows that
# they start from (and what these are dealt by): texts then join where they are used and do not move.
_COSTLY_ROWS = {
    "tcomments": ("text_keys", "said_id"),
    "comment_texts": ("comments", "post_id"),
    "responses": ("scored", "event_id"),
    "replies": ("conversations", "conv_id", "turn"),
}
# Rows of a task; the number of tasks grows with the table.
ROWS_PER_TASK = 10_000


@dataclass(frozen=True)
class Context:
    """One run: the session and the folder of the tables."""

    spark: SparkSession
    sf_dir: str

    def raw(self, name: str) -> DataFrame:
        key = (id(self.spark), self.sf_dir, name)
        if key not in _OPENED:
            _OPENED[key] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return _OPENED[key]

    def view(self, name: str) -> DataFrame:
        if name in RAW:
            return self.raw(name)
        if name == "exports":
            return self.exported()
        if name == "source_mentions":
            return self.mentioned()
        if name not in _COSTLY_ROWS:
            return self.sql(f"SELECT * FROM {name}")
        start, *keys = _COSTLY_ROWS[name]
        rows = self.view(start)
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-rows.count() // ROWS_PER_TASK))
        dealt = rows.repartition(tasks, *keys)
        # Else a join may send the rows to the texts, however few tasks read these.
        dealt = dealt.hint("merge") if " JOIN " in VIEWS[name] else dealt
        dealt.createOrReplaceTempView(f"spread_{start}")
        return self._run(re.sub(rf"\bFROM {start}\b", f"FROM spread_{start}", with_views(f"SELECT * FROM {name}")))

    def mentioned(self) -> DataFrame:
        """The view ``source_mentions``, its keys joined to their sources first, so that texts do not move for them."""
        rows = self.view("text_keys")
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-rows.count() // ROWS_PER_TASK))
        rows.repartition(tasks, "said_id").hint("merge").createOrReplaceTempView("dealt_keys")
        named = self._run("SELECT k.*, d.source AS name FROM dealt_keys k JOIN documents d ON d.doc_id = k.said_id")
        named.hint("merge").createOrReplaceTempView("named_keys")
        said = VIEWS["tcomments"].replace("FROM text_keys e", "FROM named_keys e").replace("SELECT e.event_id", "SELECT e.name, e.said_id, e.event_id")
        return self._run(said)

    def exported(self) -> DataFrame:
        """The view ``exports``, its keys joined to their posts first, so that texts do not move for the captions."""
        keys = self.sql("SELECT k.*, p.caption FROM text_keys k JOIN tposts p ON p.post_id = k.conv_id")
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-self.view("text_keys").count() // ROWS_PER_TASK))
        keys.repartition(tasks, "said_id").hint("merge").createOrReplaceTempView("posted_keys")
        said = VIEWS["tcomments"].replace("FROM text_keys e", "FROM posted_keys e").replace("d.text AS text", "d.text AS text, e.caption")
        self._run(said).createOrReplaceTempView("posted_comments")
        joined = "FROM tcomments t JOIN tposts p ON p.post_id = t.post_id"
        return self._run(VIEWS["exports"].replace(joined, "FROM posted_comments t").replace("p.caption", "t.caption"))

    def sql(self, text: str) -> DataFrame:
        """Run shared SQL text over the raw tables and the views."""
        return self._run(with_views(text))

    def _run(self, full: str) -> DataFrame:
        words = set(re.findall(r"\w+", full))
        for table in RAW:
            key = (id(self.spark), table)
            if table in words and _REGISTERED.get(key) != self.sf_dir:
                self.raw(table).createOrReplaceTempView(table)
                _REGISTERED[key] = self.sf_dir
        return self.spark.sql(full)

    def tables(self, text: bool = False) -> Tables:
        """Posts, comments, signals and entities of the numeric side."""
        return Tables(
            posts=self.view("posts"),
            comments=self.view("comment_texts" if text else "comments"),
            extracted_signals=self.view("signals"),
            monitored_entities=self.view("entities"),
        )

    def catalog(self) -> DataFrame:
        return self.view("catalog").select(
            "entity_id", "name", F.col("name").alias("canonical_name"), F.lit("person").alias("entity_type"),
            F.lit(True).alias("is_active"), F.array("alias").alias("aliases"), "load_order",
        )


def _needed(text: str) -> list[str]:
    """Views that a text refers to, directly or through other views, in order."""
    found, left = set(), [text]
    while left:
        words = set(re.findall(r"\w+", left.pop()))
        new = {name for name in VIEWS if name in words} - found
        found |= new
        left += [VIEWS[name] for name in new]
    return [name for name in VIEWS if name in found]


def with_views(text: str) -> str:
    """``text`` preceded by the views it needs as common table expressions."""
    needed = _needed(text)
    if not needed:
        return text
    head = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    body = text.strip()
    if body[:4].upper() == "WITH":
        return f"WITH {head},\n{body[4:]}"
    return f"WITH {head}\n{body}"


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Context], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where it has one, its SQL formulation."""

    def register(run: Callable[[Context], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = Query(name, run, sql)
        return run

    return register


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Six decimals, for results whose sums depend on the order of the rows."""
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])
