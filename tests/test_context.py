"""The views that give the test tables their roles, as the queries read them."""

import pytest
from pyspark.sql import functions as F

from verification import core
from verification.core import RAW, Context
from verification.table_queries import _collected, _stream

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture
def folders(spark, tmp_path):
    """The smallest tables, each as a folder of two files."""
    for name in RAW:
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").repartition(2).write.parquet(f"{tmp_path}/{name}.parquet")
    return Context(spark, str(tmp_path))


def test_streams_read_folders_of_files_too(spark, folders):
    for c in (folders, Context(spark, SF_DIR)):
        stream = _stream(c, "conversations")
        assert _collected(c, stream, "turns").count() == c.raw("conversations").count() > 0


@pytest.mark.parametrize("name", ["tcomments", "responses", "replies"])
def test_tasks_of_a_costly_view_grow_with_its_rows(spark, monkeypatch, name):
    c = Context(spark, SF_DIR)
    monkeypatch.setattr(core, "ROWS_PER_TASK", 50)
    spread = c.view(name)
    tasks = spread.select("*", F.spark_partition_id().alias("task")).select("task").distinct().count()
    assert tasks >= spread.count() / 100
    plain = c.sql(f"SELECT * FROM {name}")
    assert sorted(map(repr, spread.collect())) == sorted(map(repr, plain.collect()))


def test_texts_of_comments_are_not_dealt_out(spark):
    """Only their keys and the documents are."""
    plan = Context(spark, SF_DIR).view("tcomments")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan[:plan.index("SortMergeJoin")]


def test_comment_texts_are_joined_by_many_tasks(spark, monkeypatch):
    """Their keys are not sent to the documents, which one task may read."""
    c = Context(spark, SF_DIR)
    monkeypatch.setattr(core, "ROWS_PER_TASK", 50)
    spread = c.tables(text=True).comments
    plan = spread._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan[:plan.index("SortMergeJoin")]
    assert spread.rdd.getNumPartitions() >= spread.count() / 100
    assert sorted(map(repr, spread.collect())) == sorted(map(repr, c.sql("SELECT * FROM comment_texts").collect()))


@pytest.mark.parametrize("name", ["a1_vendor_comments", "a2_simple_comments", "a3_raw_comments", "a4_layout_by_columns", "a9_feed_items", "e10_constructed_urls", "k2_named_source"])
def test_exports_of_comments_are_compressed(spark, monkeypatch, tmp_path, name):
    """A comment repeats the text of its document, and an export all of them; the result is that of plain files."""
    import os

    from verification import QUERIES, table_queries

    monkeypatch.setattr(table_queries, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    assert QUERIES[name].run(Context(spark, SF_DIR)).count() == Context(spark, SF_DIR).raw("events").count()
    files = [f"{d}/{f}" for d, _, found in os.walk(tmp_path) for f in found if f.startswith("part-")]
    assert files and all(f.endswith(".lz4") for f in files)


def test_texts_do_not_move_for_the_names_they_mention(spark, monkeypatch):
    c = Context(spark, SF_DIR)
    monkeypatch.setattr(core, "ROWS_PER_TASK", 50)
    spread = c.view("source_mentions")
    lines = spread._jdf.queryExecution().executedPlan().toString().split("\n")
    # The keys with their sources go from one join to the next as they are.
    joins = [at for at, line in enumerate(lines) if "SortMergeJoin" in line]
    assert len(joins) > 1 and not any("Exchange" in line for line in lines[:joins[1]])
    plain = c.sql("SELECT * FROM source_mentions")
    assert sorted(map(repr, spread.select(plain.columns).collect())) == sorted(map(repr, plain.collect()))
