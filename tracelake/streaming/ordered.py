"""Kernels over rows in event time: the streaming form of ``operators.ordered``.

Rows of a key wait in state until the stream's event time is ``late`` beyond them;
then they go through the key's kernel in order, as in a batch. An event-time timer
wakes a key when its next row is due, so a quiet key costs nothing. What the kernel
remembers is the rest of the state. After ``idle`` without rows a key is forgotten
for good: the kernel may have a last word (``finish``), and nothing of it stays.

Rows that come after their time has been worked on are a side output: they get ``late``
true and no label. Rows later than ``grace`` beyond that are dropped and counted by Spark
(numRowsDroppedByWatermark), as it does not hand them on.

The session needs the RocksDB state store (``state_store``).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType

from tracelake.operators.ordered import Clamped, HoldRepeat, Kernel, Thin
from tracelake.streaming.live import with_event_time

MS = 1_000_000


def state_store(spark: SparkSession) -> None:
    """Let streaming queries of this session keep state that has timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class InOrder(StatefulProcessor):
    """Rows of a key in event time through a kernel; see the module."""

    def __init__(self, kernel: Callable[[], Kernel], keys: list[str], columns: list[str], schema: StructType, order: list[str], args: list[str], grace_ms: int, idle_ns: int | None, label: str):
        self.make, self.keys, self.columns, self.schema = kernel, keys, columns, schema
        self.order, self.args, self.grace_ms, self.idle_ns = order, args, grace_ms, idle_ns
        self.named = Row(*columns, label, "late")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.known = handle.getValueState("known", "kernel binary, done_ns bigint, last_ns bigint, timer_ms bigint")

    def close(self) -> None:
        pass

    def _wake(self, was_ms: int, at_ms: int) -> int:
        if was_ms != at_ms:
            if was_ms >= 0:
                self.handle.deleteTimer(was_ms)
            self.handle.registerTimer(at_ms)
        return at_ms

    def _work(self, key: tuple, new: list[Row], watermark_ms: int, woken: bool) -> Iterator[Row]:
        kernel, done, last, timer = self.known.get() if self.known.exists() else (None, -1, -1, -1)
        timer = -1 if woken else timer  # a timer that went off is gone
        state = pickle.loads(bytes(kernel)) if kernel is not None else self.make()
        time = self.columns.index(self.order[0])
        for row in (r for r in new if r[time] <= done):
            yield self.named(*row, None, True)
        rows = [*(self.waiting.get() if self.waiting.exists() else ()), *(r for r in new if r[time] > done)]
        until = (watermark_ms + self.grace_ms) * MS if watermark_ms > 0 else -1
        places = [self.columns.index(c) for c in self.order]
        due = sorted((r for r in rows if r[time] <= until), key=lambda r: tuple(r[p] for p in places))
        rest = [tuple(r) for r in rows if r[time] > until]
        args = [self.columns.index(a) for a in self.args]
        for row in due:
            yield self.named(*row, state.step(*(row[a] for a in args)), False)
        if due:
            done, last = until, due[-1][time]
        if not rest and self.idle_ns is not None and last >= 0 and until >= last + self.idle_ns:
            finish = getattr(state, "finish", None)
            label = finish() if finish else None
            if label is not None:
                values = dict(zip(self.keys, key, strict=True)) | {self.order[0]: last}
                yield self.named(*(values.get(c) for c in self.columns), label, False)
            if timer >= 0:
                self.handle.deleteTimer(timer)
            self.waiting.clear()
            self.known.clear()
            return
        if rest:
            timer = self._wake(timer, max(-(-min(r[time] for r in rest) // MS) - self.grace_ms, watermark_ms + 1))
            self.waiting.put(rest)
        else:
            self.waiting.clear()
            if self.idle_ns is not None:
                timer = self._wake(timer, max(-(-(last + self.idle_ns) // MS) - self.grace_ms, watermark_ms + 1))
        self.known.update((pickle.dumps(state), done, last, timer))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        return self._work(key, list(rows), timerValues.getCurrentWatermarkInMs(), False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._work(key, [], timerValues.getCurrentWatermarkInMs(), True)


def ordered_stream(events: DataFrame, keys: list[str], args: list[str], kernel: Callable[[], Kernel], label: str, label_type: str, *, order: tuple[str, ...] = ("ts_ns", "seq"), late_ms: int = 0, grace_ms: int = 0, idle_ns: int | None = None) -> DataFrame:
    """``events`` with ``label``, the kernel's answer to each row's ``args``, and ``late``; groups by ``keys`` in ``order``, which begins with a time in ns."""
    timed = with_event_time(events, f"{late_ms + grace_ms} milliseconds")
    columns = [c for c in events.columns if c not in (label, "late")]
    rows = timed.select(*columns, "event_time")
    schema = events.select(*columns).schema
    out = StructType([StructField(f.name, f.dataType) for f in schema]).add(label, events.sparkSession.createDataFrame([], f"x {label_type}").schema["x"].dataType).add("late", "boolean")
    processor = _Trimmed(kernel, keys, columns, schema, list(order), args, grace_ms, idle_ns, label)
    return rows.groupBy(*keys).transformWithState(processor, out, "Append", "EventTime")


class _Trimmed(InOrder):
    """Leaves out the column that only the watermark needs."""

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        return super().handleInputRows(key, (Row(*r[:-1]) for r in rows), timerValues)


class Sums:
    """Deltas summed up and told once ``every`` has passed since the last time; ``init`` stands for the time before the first."""

    def __init__(self, every: int, init: int | None = 0):
        self.gate, self.sums = Thin(every, init), [0, 0]

    def step(self, t: int, dx: int | None, dy: int | None) -> dict | None:
        self.sums = [self.sums[0] + (dx or 0), self.sums[1] + (dy or 0)]
        if not self.gate.step(t):
            return None
        out, self.sums = self.sums, [0, 0]
        return {"dx": out[0], "dy": out[1]}


class Holds:
    """A press and the release after it, at least ``least`` apart; a press without a release ends there."""

    def __init__(self, least: int):
        self.least, self.start = least, None

    def step(self, t: int, pressed: bool) -> dict | None:
        if pressed:
            self.start = t if self.start is None else self.start
            return None
        start, self.start = self.start, None
        return None if start is None else {"start_ns": start, "end_ns": max(t, start + self.least)}

    def finish(self) -> dict | None:
        return None if self.start is None else {"start_ns": self.start, "end_ns": self.start + self.least}


class Path:
    """A position in a window of the screen's size, moved by deltas."""

    def __init__(self, width: int, height: int):
        self.axes = Clamped(width // 2, 0, width - 1), Clamped(height // 2, 0, height - 1)

    def step(self, dx: int | None, dy: int | None, x: int | None, y: int | None) -> dict:
        return {"x": self.axes[0].step(dx, x), "y": self.axes[1].step(dy, y)}


def thin(events: DataFrame, every_ns: int, *, init: int | None = 0, keys: tuple[str, ...] = ("episode", "topic"), **how) -> DataFrame:
    """Rows at least ``every_ns`` after the last kept one. Keys may be forgotten once that time has passed: it changes nothing."""
    how = {"idle_ns": every_ns} | how if init is not None or every_ns else how
    return ordered_stream(events, list(keys), ["ts_ns"], lambda: Thin(every_ns, init), "keep", "boolean", **how).where("keep or late").drop("keep")


def sum_deltas(moves: DataFrame, every_ns: int, *, init: int | None = 0, keys: tuple[str, ...] = ("episode",), **how) -> DataFrame:
    """Moves (dx, dy) with their sums since the last one that was told."""
    return ordered_stream(moves, list(keys), ["ts_ns", "dx", "dy"], lambda: Sums(every_ns, init), "sums", "struct<dx:bigint,dy:bigint>", **how).where("sums is not null or late")


def key_repeat(events: DataFrame, every_ns: int, reset_ns: int = 1_000_000_000, *, key: str = "vk", pressed: str = "pressed", keys: tuple[str, ...] = ("episode",), **how) -> DataFrame:
    """Rows with ``keep`` (a press that is no repeat, or another row) and ``made``, the presses that are due at it."""
    kind = dict(events.dtypes)[key]
    out = ordered_stream(events, list(keys), ["ts_ns", key, pressed], lambda: HoldRepeat(every_ns, reset_ns), "_r", f"struct<keep:boolean,made:array<struct<key:{kind},t:bigint>>>", **how)
    return out.select("*", F.col("_r.keep").alias("keep"), F.col("_r.made").alias("made")).drop("_r")


def holds(events: DataFrame, key: str, pressed: Column, least_ns: int, *, idle_ns: int, **how) -> DataFrame:
    """(episode, key, start_ns, end_ns, late): a press and its release; after ``idle_ns`` without rows of the key an open press ends."""
    rows = events.select("episode", key, "ts_ns", "seq", pressed.alias("pressed"))
    out = ordered_stream(rows, ["episode", key], ["ts_ns", "pressed"], lambda: Holds(least_ns), "hold", "struct<start_ns:bigint,end_ns:bigint>", idle_ns=idle_ns, **how)
    return out.where("hold is not null or late").select("episode", key, "hold.*", "late")


def cursor(events: DataFrame, width: int, height: int, *, keys: tuple[str, ...] = ("episode",), **how) -> DataFrame:
    """Rows (dx, dy, and x, y where absolute) with ``at``, the position after each."""
    return ordered_stream(events, list(keys), ["dx", "dy", "x", "y"], lambda: Path(width, height), "at", "struct<x:bigint,y:bigint>", **how)
