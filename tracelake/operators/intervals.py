"""Half-open intervals [start_ns, end_ns) per episode: normal form, set algebra, extraction.

Set operations share one sweep: interval borders become +1 and -1 events, summed
up per time before a running sum per episode, so no pair of intervals is formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("episode",)


def check(df: DataFrame) -> DataFrame:
    """``df``, which fails at run time on an interval whose start is not before its end."""
    bad = F.when(F.col("start_ns") >= F.col("end_ns"), F.raise_error(F.lit("an interval must start before it ends")).cast("bigint"))
    return df.withColumn("start_ns", F.coalesce(bad, F.col("start_ns")))


def normalize(df: DataFrame) -> DataFrame:
    """Overlapping and adjacent intervals merged."""
    order = Window.partitionBy(*KEYS).orderBy("start_ns", "end_ns")
    before = F.max("end_ns").over(order.rowsBetween(Window.unboundedPreceding, -1))
    grouped = df.withColumn("_new", (before.isNull() | (before < F.col("start_ns"))).cast("int")).withColumn("_g", F.sum("_new").over(order))
    return grouped.groupBy(*KEYS, "_g").agg(F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns")).drop("_g")


def _borders(df: DataFrame, side: str) -> DataFrame:
    border = F.explode(F.array(F.struct(F.col("start_ns").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end_ns").alias("t"), F.lit(-1).alias("d"))))
    rows = df.select(*KEYS, border.alias("b")).select(*KEYS, F.col("b.t").alias("t"), F.col("b.d").alias("d"))
    return rows.select(*KEYS, "t", *[(F.col("d") if s == side else F.lit(0)).alias(s) for s in ("a", "b")])


def combine(left: DataFrame, right: DataFrame, holds: Column) -> DataFrame:
    """Normal form of the times at which ``holds`` is true of the depths ``a`` (left) and ``b`` (right)."""
    sums = _borders(left, "a").unionByName(_borders(right, "b")).groupBy(*KEYS, "t").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    order = Window.partitionBy(*KEYS).orderBy("t")
    depth = sums.select(*KEYS, F.col("t").alias("start_ns"), F.lead("t").over(order).alias("end_ns"), F.sum("a").over(order).alias("a"), F.sum("b").over(order).alias("b"))
    return normalize(depth.where(holds & F.col("end_ns").isNotNull()).select(*KEYS, "start_ns", "end_ns"))


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    return normalize(left.select(*KEYS, "start_ns", "end_ns").unionByName(right.select(*KEYS, "start_ns", "end_ns")))


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    return combine(left, right, (F.col("a") > 0) & (F.col("b") > 0))


def subtract(left: DataFrame, right: DataFrame) -> DataFrame:
    return combine(left, right, (F.col("a") > 0) & (F.col("b") == 0))


def summary(df: DataFrame) -> DataFrame:
    """(episode, n, total_ns)."""
    return df.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end_ns") - F.col("start_ns")).alias("total_ns"))


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (a0 < b1) & (b0 < a1)


def adjacent(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (a1 == b0) | (b1 == a0)


def inside(events: DataFrame, intervals: DataFrame) -> DataFrame:
    """Events in their episode's intervals, with start_ns and end_ns.

    Intervals must be in normal form. Each event takes the last interval that
    starts at or before it, found by a window over both sides; unlike a range
    join this costs one sort, however many intervals an episode has.
    """
    marks = intervals.select("episode", F.col("start_ns").alias("ts_ns"), F.struct("start_ns", "end_ns").alias("_iv"))
    both = events.withColumn("_iv", F.lit(None).cast("struct<start_ns:bigint,end_ns:bigint>")).unionByName(marks.withColumn("_mark", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy("episode").orderBy("ts_ns", F.col("_mark").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_last", F.last("_iv", ignorenulls=True).over(order)).where("_mark is null and ts_ns < _last.end_ns")
    return found.select(*events.columns, F.col("_last.start_ns").alias("start_ns"), F.col("_last.end_ns").alias("end_ns"))


# Extractors: from events (episode, seq, ts_ns, topic, ...) to intervals.


def all_time(events: DataFrame) -> DataFrame:
    """One interval from the first to the last event (which it leaves out); none where these coincide."""
    return events.groupBy(*KEYS).agg(F.min("ts_ns").alias("start_ns"), F.max("ts_ns").alias("end_ns")).where("start_ns < end_ns")


def empty(events: DataFrame) -> DataFrame:
    return all_time(events).limit(0)


def topic_span(events: DataFrame, topics: list[str]) -> DataFrame:
    return all_time(events.where(F.col("topic").isin(topics)))


def activity(events: DataFrame, topics: list[str], gap_ns: int) -> DataFrame:
    """Runs of events of the topics whose gaps do not exceed ``gap_ns``; runs of no length are dropped."""
    order = Window.partitionBy(*KEYS).orderBy("ts_ns")
    rows = events.where(F.col("topic").isin(topics)).select(*KEYS, "ts_ns")
    new = (F.col("ts_ns") - F.lag("ts_ns").over(order) > gap_ns).cast("int")
    runs = rows.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return runs.groupBy(*KEYS, "_run").agg(F.min("ts_ns").alias("start_ns"), F.max("ts_ns").alias("end_ns")).where("start_ns < end_ns").drop("_run")


def inactivity_filter(events: DataFrame, screen: list[str], inputs: list[str], screen_gap_ns: int, input_gap_ns: int) -> DataFrame:
    """Times at which screen and input are both active, within the screen's span."""
    active = intersect(activity(events, screen, screen_gap_ns), activity(events, inputs, input_gap_ns))
    return intersect(active, topic_span(events, screen))


def toggles(events: DataFrame, is_toggle: Column, is_pause: Column | None = None) -> DataFrame:
    """Toggle events paired first with second, third with fourth; an odd last one is dropped; a pause event is an error."""
    if is_pause is not None:
        stop = F.when(is_pause, F.raise_error(F.lit("pause keys are not supported")).cast("bigint"))
        events = events.withColumn("ts_ns", F.coalesce(stop, F.col("ts_ns")))
    order = Window.partitionBy(*KEYS).orderBy("ts_ns", "seq")
    pairs = events.where(is_toggle).withColumn("_pair", F.floor((F.row_number().over(order) - 1) / 2))
    return pairs.groupBy(*KEYS, "_pair").agg(F.min("ts_ns").alias("start_ns"), F.max("ts_ns").alias("end_ns"), F.count(F.lit(1)).alias("_n")).where("_n = 2 and start_ns < end_ns").drop("_pair", "_n")


def longer_than(df: DataFrame, least_ns: int) -> DataFrame:
    return df.where(F.col("end_ns") - F.col("start_ns") > least_ns)
