"""Debouncing by state and timers: a burst closes once its path has been quiet, without a later event of any path."""

from __future__ import annotations

import time
from bisect import bisect_right
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType, TimestampType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Columns of a burst beside its last event's.
OWN = ["burst_start", "burst_end", "n_events"]


def _rank(event: tuple) -> tuple:
    """The order of structs: null before every value."""
    return tuple((v is not None, v) for v in event)


def merged(bursts: list[tuple], events: Iterator[tuple], gap: int) -> list[tuple]:
    """bursts (start, end, n, event), in order and at least `gap` apart, after more events, each a tuple that begins with its time.  Events come in any
    order; one that lies less than `gap` from two bursts makes them one.  The event of a burst is the largest."""
    starts, out = [b[0] for b in bursts], list(bursts)
    for e in events:
        new, at = (e[0], e[0], 1, e), bisect_right(starts, e[0])
        low = high = at
        if low > 0 and e[0] - out[low - 1][1] < gap:
            low -= 1
        if high < len(out) and out[high][0] - e[0] < gap:
            high += 1
        for b in out[low:high]:
            new = (min(new[0], b[0]), max(new[1], b[1]), new[2] + b[2], max(new[3], b[3], key=_rank))
        out[low:high], starts[low:high] = [new], [new[0]]
    return out


class Bursts(StatefulProcessor):
    """The open bursts of one (project, path), and a timer at the end of its quiet time.

    A burst is given out when the path's own events have gone on by gap + late, so that no event in time can still join it, or, with all others of the
    path, when no event of the path has come for `quiet` by the clock.  State holds a path's bursts of the last gap + late only.
    """

    def __init__(self, schema: StructType, gap: int, quiet: int, late: int):
        self.schema, self.gap, self.quiet, self.late = schema, gap, quiet, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", self.schema)

    def _rows(self, key: tuple, bursts: list[tuple]) -> Iterator[Row]:
        row = Row("project", "path", *self.schema.names)
        for start, end, n, event in bursts:
            yield row(*key, start, end, n, *event)

    def handleInputRows(self, key, rows, timerValues):
        held = [(b[0], b[1], b[2], tuple(b[3:])) for b in self.open.get()] if self.open.exists() else []
        bursts = merged(held, (tuple(r)[2:] for r in rows), self.gap)
        bound = bursts[-1][1] - self.gap - self.late
        done = [b for b in bursts if b[1] < bound]
        self.open.put([(*b[:3], *b[3]) for b in bursts[len(done) :]])
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet)
        yield from self._rows(key, done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = [(b[0], b[1], b[2], tuple(b[3:])) for b in self.open.get()] if self.open.exists() else []
        self.open.clear()
        yield from self._rows(key, held)

    def close(self) -> None:
        pass


def debounce_quiet(changes: DataFrame, gap_ms: int = 500, quiet_ms: int | None = None, late_ms: int = 10_000) -> DataFrame:
    """What `debounce` gives (project, path, burst_start, the last event's columns, n_events), as a stream in append mode whose last bursts close by the clock.

    Events of a path that are less than `gap_ms` apart by ts are one burst, in whatever order they come.  quiet_ms (as long as the gap where None) is how long by the
    clock a path must be without events until its bursts are given out; an event after that begins a new burst.  Events with a null ts are dropped, as by a
    watermark.  Null projects and paths are keys like others.  Start the stream under `rocksdb_state`; stop it, or let `drain` do so.
    """
    state = [c for c in changes.columns if c not in ("project", "path", "ts")]
    stamps = [c for c in state if isinstance(changes.schema[c].dataType, TimestampType)]
    # Times travel as microseconds: exact, and alike in every time zone.
    flat = [F.unix_micros(c).alias(c) if c in stamps else F.col(c) for c in state]
    own = changes.where("ts is not null").select("project", "path", F.unix_micros("ts").alias("ts"), *flat)
    event = own.schema.fields[2:]
    held = StructType([*(StructField(c, LongType()) for c in OWN), *event])
    out = StructType([*own.schema.fields[:2], *held.fields])
    quiet = gap_ms if quiet_ms is None else quiet_ms
    found = own.groupBy("project", "path").transformWithState(Bursts(held, gap_ms * 1000, quiet, late_ms * 1000), out, "Append", "ProcessingTime")
    back = [F.timestamp_micros(c).alias(c) if c in ("burst_start", "ts", *stamps) else F.col(c) for c in ("burst_start", "ts", *state)]
    return found.select("project", "path", *back, "n_events")


@contextmanager
def rocksdb_state(spark: SparkSession):
    """The session as it must be while such a stream is started, and as it was afterwards."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def drain(query: StreamingQuery, timeout: float = 600) -> None:
    """Stops a stream once its sources have nothing new and its state is empty, so that every burst has been written."""
    until = time.time() + timeout
    while query.isActive:
        p = query.lastProgress
        if p and p["numInputRows"] == 0 and all(o["numRowsTotal"] == 0 for o in p["stateOperators"]) and not query.status["isDataAvailable"]:
            query.stop()
            return
        if time.time() > until:
            query.stop()
            raise TimeoutError("bursts are still open")
        time.sleep(0.2)
    query.awaitTermination()
