"""Watching by timers: state of a file that ends by itself when the file has been quiet. Needs the RocksDB state store.

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", timers.STORE)
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ms(at) -> int:
    return int(at.timestamp() * 1000)


def _time(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, timezone.utc)


class Settling(StatefulProcessor):
    """Pending files of a bucket of paths; each is given out when ``gap_ms`` have passed since its own last event.

    Map state has each path's first and last time and number of events. A bucket has a timer for each time at which one of its files may be
    quiet; a timer that finds newer events leaves them to theirs.
    """

    def __init__(self, gap_ms: int, by_event_time: bool):
        self.gap, self.by_event_time = gap_ms, by_event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "path string", "first long, last long, seen long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        touched = {}
        for row in sorted(rows, key=lambda r: r.event_time):
            at = _ms(row.event_time)
            old = touched.get(row.path) or (tuple(self.pending.getValue((row.path,))) if self.pending.containsKey((row.path,)) else None)
            if old and (at - old[1] if self.by_event_time else now - old[2]) >= self.gap:  # it was quiet, and its timer is still to come
                yield self._row(row.path, old)
                old = None
            first, last, _, n = old or (at, at, 0, 0)
            touched[row.path] = (min(first, at), max(last, at), now, n + 1)
        for path, value in touched.items():
            self.pending.updateValue((path,), value)
        for end in {(v[1] if self.by_event_time else now) + self.gap for v in touched.values()}:
            self.handle.registerTimer(end)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        quiet = [(k[0], v) for k, v in self.pending.iterator() if (v[1] if self.by_event_time else v[2]) + self.gap <= until]
        for path, value in quiet:
            self.pending.removeKey((path,))
            yield self._row(path, value)

    @staticmethod
    def _row(path: str, value) -> Row:
        first, last, _, n = value
        return Row(path=path, first_time=_time(first), last_time=_time(last), n_events=n)

    def close(self) -> None:
        pass


def settled(events: DataFrame, gap_ms: int = 500, by_event_time: bool = False, buckets: int = 64) -> DataFrame:
    """(path, first_time, last_time, n_events) of a stream's files, each once it has been quiet for ``gap_ms``.

    By the clock, or by event time, which needs a watermark on ``event_time``. Unlike ``QuietBatches``, where one channel's
    quiet time counts, a busy file doesn't hold up others. Rows without a path or time are left out.
    """
    rows = events.where("path IS NOT NULL AND event_time IS NOT NULL").select("path", "event_time", F.pmod(F.hash("path"), F.lit(buckets)).alias("bucket"))
    processor = Settling(gap_ms, by_event_time)
    return rows.groupBy("bucket").transformWithState(processor, "path string, first_time timestamp, last_time timestamp, n_events long", "append", "EventTime" if by_event_time else "ProcessingTime")


class LastValue(StatefulProcessor):
    """The last value of each key; rows that repeat it are dropped. A key that has been idle for ``idle_ms`` is forgotten."""

    def __init__(self, idle_ms: int, fields: list[str]):
        self.idle, self.fields = idle_ms, fields

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "value string", self.idle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = self.last.get()[0] if self.last.exists() else None
        for row in sorted(rows, key=lambda r: r.event_time):
            if row.value is not None and row.value != last:
                last = row.value
                yield Row(**{f: row[f] for f in self.fields})
        if last is not None:
            self.last.update((last,))

    def close(self) -> None:
        pass


def changed_live(events: DataFrame, value: Column, key: str, idle_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """``watch.changed`` for a stream (``key``, event_time, ..): rows whose value differs from the one before with the same key.

    Rows of a micro-batch are taken by their time. Keys that come no more are forgotten after ``idle_ms``; null values are dropped.
    """
    rows = events.withColumn("value", value.cast("string"))
    return rows.groupBy(key).transformWithState(LastValue(idle_ms, events.columns), events.schema, "append", "ProcessingTime")
