"""Streaming forms: the same envelopes, with event time in microseconds for watermarks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracelake.functions.formats import SECOND, div
from tracelake.schema import ENVELOPE


def log_stream(spark: SparkSession, path: str, *, files_per_trigger: int = 100, schema: str = ENVELOPE) -> DataFrame:
    """Envelopes from Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def with_event_time(events: DataFrame, late: str) -> DataFrame:
    """``events`` with event_time and a watermark; later rows are dropped by stateful operators."""
    return events.withColumn("event_time", F.timestamp_micros(div(F.col("ts_ns"), 1000))).withWatermark("event_time", late)


def ticks(spark: SparkSession, per_second: int = 1) -> DataFrame:
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load()


def binned(events: DataFrame, width: str, origin: str = "0 seconds") -> DataFrame:
    """Counts per episode, window and topic; windows are aligned to the epoch plus ``origin``."""
    return events.groupBy("episode", F.window("event_time", width, width, origin), "topic").agg(F.count(F.lit(1)).alias("n"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Activity per episode: windows that close when the gap is reached; start and end are those of the rows."""
    return events.groupBy("episode", F.session_window("event_time", gap)).agg(F.min("ts_ns").alias("start_ns"), F.max("ts_ns").alias("end_ns"), F.count(F.lit(1)).alias("n"))


def thin(events: DataFrame, every_ns: int, init: int = 0) -> DataFrame:
    """(episode, topic, seq, ts_ns) of rows at least ``every_ns`` after the last kept one of their episode and topic.

    State is one number for each episode and topic. Rows of a batch are sorted;
    a row that is older than the last kept one is dropped as late.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else init
        rows = pd.concat(list(batches)).sort_values(["ts_ns", "seq"])
        keep = []
        for t in rows["ts_ns"]:
            keep.append(t - last >= every_ns)
            last = int(t) if keep[-1] else last
        state.update((last,))
        yield rows[keep]

    narrow = events.select("episode", "topic", "seq", "ts_ns")
    kinds = ", ".join(f"{c} {t}" for c, t in narrow.dtypes)
    return narrow.groupBy("episode", "topic").applyInPandasWithState(step, kinds, "last bigint", "append", GroupStateTimeout.NoTimeout)


def keep_while(events: DataFrame, state_topic: str, matches: str) -> DataFrame:
    """Rows while the latest row of ``state_topic`` has ``matches`` in its payload; state is one flag for each episode."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        on = bool(state.get[0]) if state.exists else False
        rows = pd.concat(list(batches)).sort_values(["ts_ns", "seq"])
        keep = []
        for topic, payload in zip(rows["topic"], rows["payload"], strict=True):
            if topic == state_topic:
                on = matches in (payload or "")
            keep.append(on)
        state.update((on,))
        yield rows[keep]

    narrow = events.select("episode", "topic", "seq", "ts_ns", "payload")
    kinds = ", ".join(f"{c} {t}" for c, t in narrow.dtypes)
    return narrow.groupBy("episode").applyInPandasWithState(step, kinds, "matching boolean", "append", GroupStateTimeout.NoTimeout)


def on_batches(events: DataFrame, call: Callable[[DataFrame, int], None], checkpoint: str, *, once: bool = False):
    """Start a query that hands every micro-batch to ``call``; the handle has stop() and awaitTermination()."""
    writer = events.writeStream.foreachBatch(call).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def heartbeat_ns(ts_ns) -> object:
    """The second of a time, for one row a second."""
    return div(ts_ns, SECOND)
