"""Velocity as a stateful stream: every entity's two rolling windows, hour by hour.

Signals are first summed per entity and hour, which combines in every map task, so an
entity with a third of all signals reaches its state as one row an hour. The state of an
entity is the ring of its last two windows of hourly sums. A closed hour moves it at
once; a timer moves it through the hours in which the entity is silent and drops it when
nothing is left to compare.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hearsay import fixed_values as fv
from hearsay.streaming.jobs import hourly_sums, velocity_columns

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_RING = "hours array<bigint>, sums array<double>, counts array<bigint>, done bigint"
_HOUR_MS = 3_600_000


def compared_hours(
    hours: np.ndarray, sums: np.ndarray, counts: np.ndarray, after: int, until: int, window: int, least: int
) -> dict[str, np.ndarray]:
    """Both windows at the end of every hour in ``(after, until]`` where each holds ``least`` signals.

    ``hours`` ascend; an hour that is not listed is silent. Hours more than two windows
    past the last signal can hold nothing, so a long gap costs no more than a short one.
    """
    parts = []
    for run in np.split(np.arange(len(hours)), np.flatnonzero(np.diff(hours) > 2 * window) + 1):
        if not len(run):
            continue
        begin, end = hours[run[0]], min(int(hours[run[-1]]) + window, until)
        if end <= after:
            continue
        # Two empty windows in front: each row of the view is one window that ends at an hour.
        size = 2 * window - 1 + int(end - begin) + 1
        some = run[hours[run] <= end]
        at = hours[some] - begin + 2 * window - 1
        score, number = np.zeros(size), np.zeros(size, np.int64)
        score[at], number[at] = sums[some], counts[some]
        scores = np.lib.stride_tricks.sliding_window_view(score, window).sum(axis=1)
        numbers = np.lib.stride_tricks.sliding_window_view(number, window).sum(axis=1)
        hour = np.arange(begin, end + 1)
        both = (hour > after) & (numbers[window:] >= least) & (numbers[:-window] >= least)
        parts.append((hour[both], scores[window:][both], numbers[window:][both], scores[:-window][both], numbers[:-window][both], number[2 * window - 1:][both]))
    names = ("hour", "recent_sum", "recent_count", "previous_sum", "previous_count", "hour_count")
    kinds = (np.int64, np.float64, np.int64, np.float64, np.int64, np.int64)
    return {
        name: np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, kind)
        for i, (name, kind) in enumerate(zip(names, kinds))
    }


class _Rolling(StatefulProcessor):
    """One entity. Hours arrive once each, closed, and never before one that was handled."""

    def __init__(self, window: int, least: int, key: str):
        self.window, self.least, self.key = window, least, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getValueState("ring", _RING)

    def _advance(self, key, hours, sums, counts, done: int, until: int) -> Iterator[pd.DataFrame]:
        out = compared_hours(hours, sums, counts, done, until, self.window, self.least)
        kept = hours > until - 2 * self.window
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if kept.any():
            self.ring.update((hours[kept].tolist(), sums[kept].tolist(), counts[kept].tolist(), int(until)))
            # Timers fire once the watermark is past them: the next hour is then closed.
            self.handle.registerTimer((until + 2) * _HOUR_MS - 1)
        else:
            self.ring.clear()
        if len(out["hour"]):
            yield pd.DataFrame({self.key: [key[0]] * len(out["hour"]), **out})

    def _stored(self):
        hours, sums, counts, done = self.ring.get()
        return np.array(hours, np.int64), np.array(sums, np.float64), np.array(counts, np.int64), int(done)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows)).sort_values("hour")
        hours, sums, counts = (fresh[c].to_numpy() for c in ("hour", "sum_score", "n"))
        done = int(hours[0]) - 1
        if self.ring.exists():
            old_hours, old_sums, old_counts, done = self._stored()
            hours, sums, counts = (np.concatenate(p) for p in ((old_hours, hours), (old_sums, sums), (old_counts, counts)))
        yield from self._advance(key, hours, sums, counts, done, int(hours[-1]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.ring.exists():
            return
        hours, sums, counts, done = self._stored()
        closed = timerValues.getCurrentWatermarkInMs() // _HOUR_MS - 1
        yield from self._advance(key, hours, sums, counts, done, max(done, int(closed)))

    def close(self) -> None:
        pass


def live_velocity_stream(
    facts: DataFrame, delay: str = "1 hour", window_hours: int = fv.VELOCITY_HOURS, min_sample_size: int = 10,
    alert_percent: float = fv.ALERT_PERCENT,
) -> DataFrame:
    """Velocity of every entity at the end of every hour, as the hours close.

    A row for each hour in which both windows hold ``min_sample_size`` scored signals, hours
    without a signal included (``hour_count`` 0). Signals later than ``delay`` are left
    out, as in every stream with a watermark. Facts without entity, score or time take no part. The
    session's state store has to be RocksDB (``STATE_STORE``) while the query starts.
    """
    hourly = hourly_sums(facts, delay)
    key = hourly.schema["entity_id"].dataType.simpleString()
    rows = hourly.select(
        "entity_id", F.window_time("window").alias("closes_at"),
        F.expr("unix_seconds(window.start) div 3600").alias("hour"), "sum_score", "n",
    )
    rolled = rows.groupBy("entity_id").transformWithStateInPandas(
        statefulProcessor=_Rolling(window_hours, min_sample_size, "entity_id"),
        outputStructType=f"entity_id {key}, hour bigint, recent_sum double, recent_count bigint, previous_sum double, previous_count bigint, hour_count bigint",
        outputMode="append", timeMode="eventTime",
    )
    return velocity_columns(
        rolled.select(
            "entity_id", F.timestamp_seconds(F.col("hour") * 3600).alias("hour"),
            F.try_divide("recent_sum", "recent_count").alias("recent_avg"), "recent_count",
            F.try_divide("previous_sum", "previous_count").alias("previous_avg"), "previous_count", "hour_count",
        ),
        alert_percent, "hour_count",
    )
