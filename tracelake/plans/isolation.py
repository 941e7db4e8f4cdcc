"""Failure isolation: episodes that break a rule leave a stage as rejects, with a reason, and the others go on.

A rule is a condition that every row of an episode must meet. Rules are tried in one
pass that carries no payload past the scan; the first row that breaks one, in the order
of time, names the reason. What is left is the same rows without those episodes, so a
bad episode costs neither the job nor its neighbours.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.plans.stages import EventConfig, event_stage
from tracelake.schema import message_types, parses


def log_rules(logs: DataFrame) -> dict[str, Column]:
    """What the stages rely on: times, topics, and payloads that parse as their registered message type."""
    parsed = F.lit(True)
    for name in message_types():
        parsed = F.when(F.col("message_type") == name, parses(F.col("payload"), name)).otherwise(parsed)
    rules = {"no time": F.col("ts_ns").isNotNull(), "negative time": F.coalesce(F.col("ts_ns") >= 0, F.lit(True)), "no topic": F.col("topic").isNotNull()}
    return rules | ({"payload does not parse": parsed} if {"message_type", "payload"} <= set(logs.columns) else {})


def rejects(logs: DataFrame, rules: dict[str, Column], *, key: str = "episode") -> DataFrame:
    """(episode, reason, at_seq, broken, rows) of the episodes with a row that breaks a rule; a null result breaks it too."""
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    marked = logs.select(F.col(key), F.col("ts_ns"), F.col("seq"), reason.alias("_r"))
    first = F.min(F.when(F.col("_r").isNotNull(), F.struct(F.col("ts_ns"), F.col("seq"), F.col("_r"))))
    found = marked.groupBy(key).agg(first.alias("_f"), F.count("_r").alias("broken"), F.count(F.lit(1)).alias("rows")).where("_f is not null")
    return found.select(key, F.col("_f._r").alias("reason"), F.col("_f.seq").alias("at_seq"), "broken", "rows")


def isolated(logs: DataFrame, rules: dict[str, Column], *, key: str = "episode") -> tuple[DataFrame, DataFrame]:
    """(rows of the sound episodes, rejects). A null key is an episode of its own."""
    bad = rejects(logs, rules, key=key)
    names = bad.select(F.col(key).alias("_bad"))
    return logs.join(names, F.col(key).eqNullSafe(F.col("_bad")), "left_anti"), bad


def isolated_events(logs: DataFrame, config: EventConfig, rules: dict[str, Column] | None = None, stage: Callable[[DataFrame, EventConfig], DataFrame] = event_stage) -> tuple[DataFrame, DataFrame]:
    """The event stage over the sound episodes, and the rejects; rules are ``log_rules`` unless given."""
    sound, bad = isolated(logs, log_rules(logs) if rules is None else rules)
    return stage(sound, config), bad


def write_isolated(logs: DataFrame, path: str, config: EventConfig, rules: dict[str, Column] | None = None) -> DataFrame:
    """Write ``path``/events and ``path``/rejects; returns the rejects. Events are the same whatever else is in the table."""
    events, bad = isolated_events(logs, config, rules)
    bad.write.parquet(f"{path}/rejects")
    events.write.parquet(f"{path}/events")
    return logs.sparkSession.read.parquet(f"{path}/rejects")
