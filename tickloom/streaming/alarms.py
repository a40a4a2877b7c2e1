"""Alarms of feeds that fall silent, told while they are silent.

The state of an instrument is its latest activity; a timer in event time goes
off once the watermark has passed it by the threshold, which other instruments
(or a heartbeat in the same stream) bring about.  Rows of a micro-batch are
only looked at for the stretches in which they leave no gap, so that they need
no order and a busy instrument no memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom import schema as S

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ALARM_SCHEMA = "instrument_id int, last_activity_us bigint, alarm_us bigint"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their keyed state in RocksDB, which Spark asks of them."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def active_stretches(times: Iterator[np.ndarray], threshold: int) -> list[tuple[int, int]]:
    """Stretches (first, last) of times without a gap of more than ``threshold``, whatever their order."""
    found: list[tuple[int, int]] = []
    for some in times:
        if not len(some):
            continue
        ordered = np.sort(some)
        cut = np.flatnonzero(np.diff(ordered) > threshold)
        first, last = ordered[np.concatenate([[0], cut + 1])], ordered[np.concatenate([cut, [len(ordered) - 1]])]
        found = joined(found + list(zip(first.tolist(), last.tolist())), threshold)
    return found


def joined(stretches: list[tuple[int, int]], threshold: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(stretches):
        if out and first - out[-1][1] <= threshold:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


class StaleAlarm(StatefulProcessor):
    """One row per silence of more than ``threshold_us``: by timer, or when rows show it before the timer does."""

    def __init__(self, threshold_us: int):
        self.threshold = int(threshold_us)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "last_us bigint, is_told boolean")

    def _alarm(self, key, last: int) -> pd.DataFrame:
        return pd.DataFrame({"instrument_id": [key[0]], "last_activity_us": [last], "alarm_us": [last + self.threshold]})

    def _timer(self, last: int) -> int:
        """The first millisecond that is more than the threshold after ``last``."""
        return (last + self.threshold) // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stretches = active_stretches((pdf["ts_us"].to_numpy(dtype=np.int64) for pdf in rows), self.threshold)
        if not stretches:
            return
        known = self.latest.get() if self.latest.exists() else None
        if known is not None:
            # late rows may lengthen an activity, and what was told is not told again
            stretches = [s for s in joined([(known[0], known[0]), *stretches], self.threshold) if s[1] >= known[0]]
        for i, ((_, last), _) in enumerate(zip(stretches, stretches[1:])):
            if not (known is not None and i == 0 and last == known[0] and known[1]):
                yield self._alarm(key, last)
        last = stretches[-1][1]
        if known is None or last > known[0]:
            if known is not None:
                self.handle.deleteTimer(self._timer(known[0]))
            self.handle.registerTimer(self._timer(last))
            self.latest.update((last, False))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, is_told = self.latest.get()
        if not is_told:
            self.latest.update((last, True))
            yield self._alarm(key, last)

    def close(self) -> None:
        pass


def stale_alarms(stream: DataFrame, threshold_us: int, lateness: str = "10 seconds") -> DataFrame:
    """Instruments without activity for more than the threshold: instrument_id, last_activity_us, alarm_us.

    Nothing is told of an instrument before its first activity.  Time is the
    stream's own: an alarm comes once rows of any instrument are ``lateness``
    past it.  Start it within ``keyed_state``.
    """
    slim = stream.select(S.KEY, "ts", F.unix_micros("ts").alias("ts_us")).withWatermark("ts", lateness)
    return slim.groupBy(S.KEY).transformWithStateInPandas(
        statefulProcessor=StaleAlarm(threshold_us), outputStructType=ALARM_SCHEMA, outputMode="Append", timeMode="EventTime"
    )
