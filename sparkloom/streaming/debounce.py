"""Debounced batches of changed paths, exact to the millisecond of the events' own clock.

A source's batch is flushed when it has been quiet for a delay that grows with what waits, or when the longest wait since its first event is over; while a
flush is at work what comes waits, and its end arms the delay again. Events carry their time, and what was due before an event is done before it, so batches
don't depend on how the stream is cut into micro-batches; after the last event the watermark drives the timers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

#: Fixed values, milliseconds: the delay, what each waiting path adds and at most, the longest wait, the least delay.
GAP, EACH, MOST_MORE, LONGEST, LEAST = 400, 15, 300, 2000, 50
OUT = "source string, at long, n int, paths array<string>"


class Waiting:
    """What waits at one source, and when what is due."""

    def __init__(self, paths: list[str], started: int | None = None, due: int | None = None, limit: int | None = None, busy: bool = False):
        self.paths, self.started, self.due, self.limit, self.busy = dict.fromkeys(paths), started, due, limit, busy

    def next_due(self) -> int | None:
        return min((t for t in (self.due, self.limit) if t is not None), default=None)

    def advance(self, now: int, hold: bool) -> Iterator[tuple[int, list[str]]]:
        """The flushes until now, in order. hold: a flush is at work until its end is told."""
        while (at := self.next_due()) is not None and at <= now:
            self.due, self.limit = (None if t == at else t for t in (self.due, self.limit))
            if self.paths and not self.busy:
                yield at, sorted(self.paths)
                self.__init__([], busy=hold)

    def arm(self, now: int) -> None:
        if self.paths:
            if self.started is None:
                self.started, self.limit = now, now + LONGEST
            self.due = now + min(GAP + min(EACH * len(self.paths), MOST_MORE), max(LEAST, LONGEST - (now - self.started)))

    def told(self, now: int, path: str | None, done: bool) -> None:
        if done:
            self.busy = False
        elif path is not None:
            self.paths[path] = None
        self.arm(now)


class Debounce(StatefulProcessor):
    def __init__(self, hold: bool):
        self.hold = hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.paths = handle.getListState("paths", StructType([StructField("path", StringType())]))
        whole = [StructField(k, LongType()) for k in ("started", "due", "limit", "timer")]
        self.clock = handle.getValueState("clock", StructType([*whole, StructField("busy", BooleanType())]))

    def _load(self) -> tuple[Waiting, int | None]:
        if not self.clock.exists():
            return Waiting([]), None
        started, due, limit, timer, busy = (None if x is None or x == -1 else x for x in self.clock.get())
        return Waiting([r[0] for r in self.paths.get()], started, due, limit, bool(busy)), timer

    def _save(self, w: Waiting, timer: int | None) -> None:
        due = w.next_due()
        if timer != due:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if w.paths:
            self.paths.put([(p,) for p in w.paths])
        else:
            self.paths.clear()
        self.clock.update((*(-1 if x is None else x for x in (w.started, w.due, w.limit, due)), w.busy))

    def _shown(self, key: tuple, flushed: list[tuple[int, list[str]]]) -> Iterator[pd.DataFrame]:
        if flushed:
            yield pd.DataFrame({"source": key[0], "at": [at for at, _ in flushed], "n": [len(p) for _, p in flushed], "paths": [p for _, p in flushed]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        w, timer = self._load()
        every = pd.concat(list(rows)).sort_values(["ms", "done", "path"], kind="stable")
        flushed = []
        for now, path, done in zip(every["ms"].astype("int64").tolist(), every["path"], every["done"].fillna(False)):
            flushed += w.advance(now, self.hold)
            w.told(now, None if pd.isna(path) else path, bool(done))
        self._save(w, timer)
        yield from self._shown(key, flushed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        w, _ = self._load()
        flushed = list(w.advance(expiredTimerInfo.getExpiryTimeInMs(), self.hold))
        self._save(w, None)
        yield from self._shown(key, flushed)


def debounced_changes(changes: DataFrame, late: str = "0 seconds", hold: bool = False) -> DataFrame:
    """A stream of flushes (source, at, n, paths) of changes (source, ts, path, and done if hold: the end of the source's last flush).

    Needs the RocksDB state store. late is how far events may come out of order; those later are dropped by the watermark. State is one source's waiting paths.
    """
    rows = changes if hold else changes.withColumn("done", F.lit(False))
    rows = rows.withWatermark("ts", late).select("source", "ts", F.unix_millis(F.col("ts")).alias("ms"), "path", "done")
    return rows.groupBy("source").transformWithStateInPandas(Debounce(hold), OUT, "append", "eventTime")
