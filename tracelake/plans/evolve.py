"""Schema evolution of payloads: version steps, path finding, checks, rollback of written tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators.logs import compare

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Migration:
    """A step that takes versions in [low, high) to ``high``."""

    low: tuple[int, ...]
    high: tuple[int, ...]
    step: Step


def version(text: str) -> tuple[int, ...]:
    return tuple(int(x) for x in text.split("."))


def path(steps: list[Migration], now: str, to: str, limit: int = 10) -> list[Migration]:
    """Steps from ``now`` to ``to``; ValueError if there is no such chain."""
    at, goal, out = version(now), version(to), []
    while at < goal and len(out) < limit:
        found = [s for s in steps if s.low <= at < s.high <= goal]
        if not found:
            break
        out.append(max(found, key=lambda s: s.high))
        at = out[-1].high
    if at != goal:
        raise ValueError(f"no steps lead from {now} to {to}")
    return out


def reachable(steps: list[Migration], now: str) -> tuple[int, ...]:
    """The highest version that steps lead to."""
    at = version(now)
    while found := [s for s in steps if s.low <= at < s.high]:
        at = max(s.high for s in found)
    return at


def needs(meta: DataFrame, to: str, default: str) -> DataFrame:
    """``meta`` (episode, version) of episodes below ``to``; unknown versions count as ``default``."""
    parts = lambda text: F.transform(F.split(text, r"\."), lambda x: x.try_cast("int"))
    return meta.where(parts(F.coalesce("version", F.lit(default))) < parts(F.lit(to)))


# Payload steps; payload is a JSON text.


def rename_prefix(message_type: Column, old: str, new: str) -> Column:
    return F.when(message_type.startswith(old), F.concat(F.lit(new), F.substring(message_type, F.lit(len(old) + 1), F.length(message_type)))).otherwise(message_type)


def rename_types(message_type: Column, names: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(table[message_type], message_type)


def rename_field(payload: Column, old: str, new: str) -> Column:
    """JSON key ``old`` becomes ``new``; other keys as they are."""
    fields = F.from_json(payload, "map<string,string>")
    renamed = F.transform_keys(fields, lambda k, _: F.when(k == old, new).otherwise(k))
    return F.when(F.map_contains_key(fields, F.lit(old)), F.to_json(renamed)).otherwise(payload)


def screen_reference(fields: Column) -> Column:
    """struct(uri, pts_ns) from path and pts of an old screen payload; an error where neither path nor reference is there."""
    missing = F.raise_error(F.lit("a screen payload has neither path nor reference")).cast("string")
    return F.struct(F.coalesce(fields["media_ref"]["uri"], fields["path"], missing).alias("uri"), F.coalesce(fields["media_ref"]["pts_ns"], fields["pts"]).alias("pts_ns"))


def unified_uri(kind: Column, path_col: Column, data: Column, form: Column) -> Column:
    """A tagged media reference as one URI: embedded data becomes a data URI."""
    return F.when(kind.startswith("embedded"), F.concat(F.lit("data:image/"), form, F.lit(";base64,"), data)).otherwise(path_col)


def raw_mouse(fields: Column) -> Column:
    """struct of the new raw mouse payload: deltas renamed, the old data field was the flags."""
    zero = F.lit(0)
    return F.struct(
        F.coalesce(fields["last_x"], fields["dx"], zero).alias("last_x"),
        F.coalesce(fields["last_y"], fields["dy"], zero).alias("last_y"),
        F.coalesce(fields["us_flags"], zero).alias("us_flags"),
        F.when(fields["dx"].isNotNull(), fields["button_data"]).otherwise(fields["button_flags"]).alias("button_flags"),
        F.when(fields["dx"].isNotNull(), zero).otherwise(fields["button_data"]).alias("button_data"),
    )


def curve_hex(text: Column, default: str) -> Column:
    """A base64 curve as lower-case hex; texts that are neither base64 nor hex become the default."""
    is_hex = text.rlike("^([0-9a-f]{2})+$")
    return F.when(is_hex, text).otherwise(F.coalesce(F.lower(F.hex(F.call_function("try_to_binary", text, F.lit("base64")))), F.lit(default)))


def migrate(spark: SparkSession, source: str, target: str, steps: list[Migration], tolerance: bool = True) -> str:
    """Write ``source`` through the steps to ``target`` and check it; a failed check deletes the new table and raises.

    The old table is its own backup: it is never written to.
    """
    before = spark.read.parquet(source)
    after = before
    for s in steps:
        after = s.step(after)
    after.write.parquet(target)
    bad = compare(before, spark.read.parquet(target)).where("reason <> 'ok'").limit(1).collect() if tolerance else []
    if bad:
        rollback(spark, target)
        raise ValueError(f"{bad[0]['reason']} of {bad[0]['episode']} changed")
    return target


def rollback(spark: SparkSession, target: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(target)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def pair_backups(files: DataFrame, suffix: str = ".backup") -> DataFrame:
    """(path, backup) of originals and backups by name; either may be missing."""
    own = files.where(~F.col("path").endswith(suffix)).select("path")
    saved = files.where(F.col("path").endswith(suffix)).select(F.col("path").alias("backup"), F.expr(f"substring(path, 1, length(path) - {len(suffix)})").alias("_of"))
    return own.join(saved, own["path"] == saved["_of"], "full").select(F.coalesce("path", "_of").alias("path"), "backup")
