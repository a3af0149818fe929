"""Stateful streams against a plain recount, over several batches and a restart."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from hearsay.streaming.jobs import append_batches
from hearsay.streaming.velocity import ROCKSDB, STATE_STORE, compared_hours, live_velocity_stream

START = datetime(2024, 3, 1)


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    yield
    spark.conf.set(STATE_STORE, before)


def _recount(signals: dict[int, list[float]], after: int, until: int, window: int, least: int):
    out = []
    for hour in range(after + 1, until + 1):
        recent = [x for h in range(hour - window + 1, hour + 1) for x in signals.get(h, [])]
        previous = [x for h in range(hour - 2 * window + 1, hour - window + 1) for x in signals.get(h, [])]
        if len(recent) >= least and len(previous) >= least:
            out.append((hour, round(sum(recent), 6), len(recent), round(sum(previous), 6), len(previous), len(signals.get(hour, []))))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_compared_hours(seed):
    rng = random.Random(seed)
    hours = sorted(rng.sample(range(100, 160 if seed % 2 else 900), 25))
    signals = {h: [rng.uniform(-1, 1) for _ in range(rng.randint(1, 3))] for h in hours}
    for window, least in ((1, 1), (4, 2), (30, 5)):
        until = hours[-1] + rng.randint(0, 70)
        after = rng.randint(90, until)
        got = compared_hours(
            np.array(hours), np.array([sum(signals[h]) for h in hours]), np.array([len(signals[h]) for h in hours]), after, until, window, least
        )
        rows = [tuple(round(float(x), 6) if i in (1, 3) else int(x) for i, x in enumerate(r)) for r in zip(*got.values())]
        assert rows == _recount(signals, after, until, window, least)


def test_compared_hours_crosses_centuries_of_silence():
    none = compared_hours(np.array([0, 10**9]), np.ones(2), np.ones(2, int), -1, 10**9, 72, 1)
    assert len(none["hour"]) == 0


def test_live_velocity_over_batches_and_a_restart(spark, rocksdb, tmp_path):
    """Silent hours come out too, and a new run takes the windows of the earlier one up."""
    rng = random.Random(7)
    signals, rows = {}, []
    for hour in range(60):
        if 20 <= hour < 26 or 40 <= hour < 58:
            continue
        for who in ("a", "b") if hour % 3 else ("a",):
            x = round(rng.uniform(-1, 1), 3)
            signals.setdefault(who, {}).setdefault(hour, []).append(x)
            rows.append((hour, (f"c{hour}", who, "sentiment", x, START + timedelta(hours=hour, minutes=rng.randrange(60)))))
    # Rows that take no part, and one that moves the watermark to the end.
    rows += [(3, ("z", None, "sentiment", 1.0, START)), (3, ("z", "a", "emotion", None, START)), (3, ("z", "a", "sentiment", None, START))]
    rows.append((59, ("last", "c", "sentiment", 0.0, START + timedelta(hours=72))))
    schema = "comment_id string, entity_id string, signal_type string, numeric_value double, created_at timestamp"
    live, out, progress = (str(tmp_path / n) for n in ("live", "out", "progress"))

    def run(some):
        # A file holds ten hours: one batch each.
        for low in sorted({h // 10 for h, _ in some}):
            spark.createDataFrame([r for h, r in some if h // 10 == low], schema).coalesce(1).write.mode("append").parquet(live)
        facts = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(live)
        stream = live_velocity_stream(facts, "1 hour", 6, 3)
        append_batches(stream, out, progress).awaitTermination()

    run([r for r in rows if r[0] < 30])
    run([r for r in rows if r[0] >= 30])
    got = spark.read.parquet(out).collect()
    found = sorted((r.entity_id, int((r.as_of - START).total_seconds() // 3600) - 1, r.recent_count, r.previous_count, r.hour_count) for r in got)
    expected = sorted(
        (who, hour, n, m, k) for who in ("a", "b") for hour, _, n, _, m, k in _recount(signals[who], -1, 70, 6, 3)
    )
    assert found == expected
    assert any(r.hour_count == 0 for r in got)
