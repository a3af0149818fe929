"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm.common import staged


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows (node, component): the smallest node that each node of ``links`` (a, b) reaches.

    Each round takes the smallest label around a node, then the label of that
    label, so long chains shorten like a doubling. Labels are written to the
    shared folder each round; the only number the driver sees is how many changed.
    Minima combine in each task, so a hub costs no more than its edges.
    """
    edges = staged(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = staged(edges.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component")), "labels")
    for _ in range(rounds):
        near = edges.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        low = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("further"))
        step = low.join(jump, "low").select("node", F.least("low", "further").alias("component"), (F.least("low", "further") < F.col("old")).alias("changed"))
        step = staged(step, "labels")
        labels = step.drop("changed")
        if step.filter("changed").isEmpty():
            return labels
    raise RuntimeError(f"labels still change after {rounds} rounds")
