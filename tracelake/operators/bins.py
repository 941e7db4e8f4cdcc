"""Fixed-width bins: the last state so far, and the actions in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.formats import div


def time_bins(events: DataFrame, width_ns: int, is_state: Column, is_action: Column, *, payload: str = "payload", drop_empty: bool = False, max_bins: int = 1_000_000) -> DataFrame:
    """(episode, bin_idx, timestamp_ns, state, actions): dense bins from each episode's first event to its last.

    ``state`` is the last state payload up to the end of the bin, carried over
    empty bins; ``actions`` are the bin's action payloads in order. An episode of
    more than ``max_bins`` bins is an error.
    """
    one = events.withColumn("_s", F.when(is_state, F.struct("ts_ns", "seq", F.col(payload).alias("p")))).withColumn("_a", F.when(is_action, F.struct("ts_ns", "seq", F.col(payload).alias("p"))))
    whole = Window.partitionBy("episode")
    one = one.withColumn("_first", F.min("ts_ns").over(whole)).withColumn("bin_idx", div(F.col("ts_ns") - F.col("_first"), width_ns).cast("int"))
    found = one.groupBy("episode", "bin_idx").agg(F.first("_first").alias("_first"), F.max("_s").alias("_s"), F.sort_array(F.collect_list("_a")).alias("_a"))
    # Each filled bin also makes the empty ones after it, up to the next filled one.
    order = Window.partitionBy("episode").orderBy("bin_idx")
    until = F.coalesce(F.lead("bin_idx").over(order) - 1, F.col("bin_idx"))
    state = F.last("_s", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    filled = found.withColumns({"_until": until, "_state": state})
    if drop_empty:
        bins = filled.where(F.size("_a") > 0).withColumn("_b", F.col("bin_idx"))
    else:
        too_many = F.when(F.col("_until") >= max_bins, F.raise_error(F.lit("an episode has too many bins")).cast("int"))
        bins = filled.withColumn("_b", F.explode(F.sequence("bin_idx", F.coalesce(too_many, F.col("_until")))))
    actions = F.when(F.col("_b") == F.col("bin_idx"), F.transform("_a", lambda x: x["p"])).otherwise(F.array().cast(f"array<{dict(events.dtypes)[payload]}>"))
    return bins.select("episode", F.col("_b").alias("bin_idx"), (F.col("_first") + F.col("_b").cast("long") * width_ns).alias("timestamp_ns"), F.col("_state.p").alias("state"), actions.alias("actions"))


def binned_samples(bins: DataFrame, instruction: str) -> DataFrame:
    """(instruction, state, actions): encoded actions joined to one text."""
    return bins.select(F.lit(instruction).alias("instruction"), "state", F.array_join("actions", "").alias("actions"))
