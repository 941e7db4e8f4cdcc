"""Kernels over rows in order, for recurrences that no window frame can state.

``ordered_scan`` co-locates each group, sorts it and streams it through a kernel
in Arrow batches: a task holds one batch and one small state, never a group. A
kernel labels rows; what to keep or emit is decided by DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Kernel(Protocol):
    """State of one group; ``step`` takes a row's arguments in order and gives its label."""

    def step(self, *args: object) -> object: ...


class Thin:
    """Keep a row if ``every`` has passed since the last kept one; ``init`` stands for the time before the first (None: keep it)."""

    def __init__(self, every: int, init: int | None = 0):
        self.every, self.last = every, init

    def step(self, t: int) -> bool:
        if self.last is not None and t - self.last < self.every:
            return False
        self.last = t
        return True


class Grid:
    """Keep a row once a fixed grid of ``every`` is due; the grid does not move with the rows."""

    def __init__(self, every: int, first: int = 0):
        self.every, self.due = every, first

    def step(self, t: int) -> bool:
        if t < self.due:
            return False
        self.due += self.every
        return True


class HoldRepeat:
    """Key presses and their repeats: see ``resample.key_repeat``. Label: (keep, [(key, time), ...])."""

    def __init__(self, every: int, reset: int):
        self.every, self.reset = every, reset
        self.held: dict[object, int] = {}

    def step(self, t: int, key: object, pressed: bool | None) -> dict:
        keep = True
        if pressed is True and key is not None:
            keep = key not in self.held
            self.held.setdefault(key, t)
        elif pressed is False and key is not None:
            self.held.pop(key, None)
        made = []
        for k, last in self.held.items():
            if t - last >= self.reset:
                self.held[k] = t
                continue
            while t - last >= self.every:
                last += self.every
                made.append({"key": k, "t": last})
            self.held[k] = last
        return {"keep": keep, "made": made}


class FramePts:
    """Media time of a frame, or one step after the last kept one; a frame within ``tolerance`` of it is skipped. Label: (keep, pts)."""

    def __init__(self, tolerance: int, step: int | None):
        self.tolerance, self.step_, self.last = tolerance, step, None

    def step(self, pts: int | None) -> dict:
        if pts is None:
            if self.step_ is None:
                raise ValueError("fps is needed where a frame has no pts")
            pts = 0 if self.last is None else self.last + self.step_
        if self.last is not None and pts - self.last < self.tolerance:
            return {"keep": False, "pts": None}
        self.last = pts
        return {"keep": True, "pts": pts}


class NextFit:
    """Number of the sequence that a length goes to, in order; None if it exceeds the capacity."""

    def __init__(self, capacity: int):
        self.capacity, self.used, self.number = capacity, 0, 0

    def step(self, length: int) -> int | None:
        if length > self.capacity:
            return None
        if self.used + length > self.capacity:
            self.used, self.number = 0, self.number + 1
        self.used += length
        return self.number


class Clamped:
    """A position moved by deltas within bounds; an absolute value replaces it."""

    def __init__(self, start: int, low: int, high: int):
        self.x, self.low, self.high = start, low, high

    def step(self, delta: int | None, absolute: int | None) -> int:
        moved = absolute if absolute is not None else self.x + (delta or 0)
        self.x = max(self.low, min(self.high, moved))
        return self.x


def ordered_scan(df: DataFrame, keys: list[str], order: list[str], args: list[str], kernel: Callable[[], Kernel], label: str, label_type: str) -> DataFrame:
    """``df`` with ``label``: the kernel's answer to each row's ``args``, groups by ``keys`` in ``order``.

    Ties in ``order`` are the caller's to break. A label named like a column replaces it.
    """
    kept = [c for c in df.columns if c != label]
    arranged = df.select(*kept).repartition(*keys).sortWithinPartitions(*keys, *order) if keys else df.select(*kept).repartition(1).sortWithinPartitions(*order)
    schema = ", ".join([*(f"`{c}` {t}" for c, t in arranged.dtypes), f"`{label}` {label_type}"])
    empty = df.sparkSession.createDataFrame([], f"x {label_type}").schema
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(empty["x"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, kernel()
        for batch in batches:
            own = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)) if keys else [()] * batch.num_rows
            out = []
            for key, *row in zip(own, *(batch.column(a).to_pylist() for a in args), strict=True):
                if key != now:
                    now, state = key, kernel()
                out.append(state.step(*row))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow)], names=[*batch.schema.names, label])

    return arranged.mapInArrow(run, schema)


def counted(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``rank``: 1, 2, ... in each group, for callers that need a tie-breaker."""
    from pyspark.sql import Window

    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
