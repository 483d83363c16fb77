"""Debouncing of a stream with timers: a burst is told once nothing has come for a while, with no need of a later event."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

OUTPUT = StructType([StructField("key", StringType()), StructField("path", StringType()), StructField("op", StringType())])
#: Names of the state: each path's last operation, and when the burst ends.
LAST, DUE = "last", "due"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Bursts(StatefulProcessor):
    """Of rows (ts in microseconds, seq, path, op) by key it keeps the last operation on each path, and tells all of them after a pause.

    Any row puts the end of its key's burst off. Rows may come in any order; of one path the one with the greatest
    (ts, seq) counts. Nothing is kept of a burst once it is told.
    """

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getMapState(LAST, StructType([StructField("path", StringType())]), StructType([StructField("op", StringType()), StructField("ts", LongType()), StructField("seq", LongType())]))
        self.due = handle.getValueState(DUE, StructType([StructField("at", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest: dict[str, tuple] = {}
        for r in rows:
            if r.path not in newest or (r.ts, r.seq) >= newest[r.path][1:]:
                newest[r.path] = (r.op, r.ts, r.seq)
        for path, found in newest.items():
            before = self.last.getValue((path,)) if self.last.containsKey((path,)) else None
            if before is None or found[1:] >= tuple(before)[1:]:
                self.last.updateValue((path,), found)
        if (due := self.due.get()) is not None:
            self.handle.deleteTimer(due[0])
        at = timerValues.getCurrentProcessingTimeInMs() + self.gap_ms
        self.handle.registerTimer(at)
        self.due.update((at,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        told = [Row(key=key[0], path=path[0], op=found[0]) for path, found in self.last.iterator()]
        self.last.clear()
        self.due.clear()
        yield from told

    def close(self) -> None:
        pass
