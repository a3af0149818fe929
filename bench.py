"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Every query runs once cold, to load classes and compile, and once timed.
"""

from __future__ import annotations

import json
import os
import time

from hearsay.session import local_session
from verification import QUERIES
from verification.core import Context

HEADLINE = [
    "f1_top_entities", "f1_top_entities_by_platform", "f2_velocity", "f3_window_velocity", "f4_emotion_distribution",
    "f5_top_topics", "f6_stance_breakdown", "f7_sentiment_history", "f9_entity_comparison", "f11_top_posts",
    "f12_post_distribution", "f13_dynamic_entities", "f14_platform_breakdown", "f15_score_distribution",
    "f16_platform_deltas", "f17_storylines", "g1_toxicity_alerts", "g2_top_comments", "d2_rule_scores",
    "d11_catalog_mentions", "d16_validated_scores", "d17_signal_fanout", "b1_post_upsert", "b2_comment_upsert",
    "b4_signal_upsert", "e2_rounded_ids", "e11_requested_urls",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    context = Context(spark, sf_dir)

    def run(name: str) -> float:
        began = time.perf_counter()
        # All columns are computed; nothing is brought to the driver.
        QUERIES[name].run(context).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    times = {}
    for name in HEADLINE:
        run(name)
        times[name] = round(run(name), 3)
    print(json.dumps({
        "metric": "headline_queries_warm_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
