"""Importers: dense ticks, action vectors, files by name, eligibility and verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.formats import div
from tracelake.operators.timelines import state_changes


def eligible(ticks: DataFrame, media: DataFrame, n_ticks: int = 6000) -> DataFrame:
    """Ticks of episodes with exactly ``n_ticks`` rows and a media file of the same stem."""
    whole = ticks.groupBy("episode").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == n_ticks).drop("n")
    return ticks.join(whole.join(media.select(F.col("stem").alias("episode")), "episode", "left_semi"), "episode", "left_semi")


def ticks_to_events(ticks: DataFrame, keys: str, names: dict[str, int], tick_ns: int = 50_000_000) -> DataFrame:
    """Press and release events from the sets of held keys per tick (episode, seq, ``keys``); keys without a code are left out."""
    codes = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    held = F.filter(F.transform(keys, lambda k: codes[k]), lambda c: c.isNotNull())
    rows = ticks.select("episode", "seq", (F.col("seq") * tick_ns).alias("ts_ns"), held.alias("held"))
    out = state_changes(rows, "held")
    payload = F.to_json(F.struct(F.col("change").alias("event_type"), F.col("member").alias("vk")))
    return out.select("episode", "seq", "ts_ns", F.lit("keyboard").alias("topic"), F.lit("desktop/KeyboardEvent").alias("message_type"), payload.alias("payload"))


def decode_actions(vector: Column, key_names: list[str], x_values: list[float], y_values: list[float], threshold: float = 0.5) -> Column:
    """struct<keys, left, right, dx, dy> of an action vector: keys, two clicks, then one-hot bins of both axes.

    A bin counts if its largest entry exceeds the threshold; else the delta is 0.
    """
    n, nx, ny = len(key_names), len(x_values), len(y_values)
    names = F.array(*[F.lit(k) for k in key_names])
    held = F.transform(F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(vector, i) > threshold), lambda i: F.get(names, i))

    def axis(first: int, values: list[float]) -> Column:
        part = F.slice(vector, first + 1, len(values))
        best = F.array_max(part)
        value = F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.array_position(part, best).cast("int"))
        return F.when(best > threshold, value).otherwise(0.0)

    clicks = [F.get(vector, F.lit(n + i)) > threshold for i in range(2)]
    return F.struct(held.alias("keys"), clicks[0].alias("left"), clicks[1].alias("right"), axis(n + 2, x_values).alias("dx"), axis(n + 2 + nx, y_values).alias("dy"))


def shards(files: DataFrame, per_shard: int = 1000) -> DataFrame:
    """(stem, shard, parts): files of one stem as one sample, samples in shards by name.

    files: (path, length). Samples are numbered through counts per leading hash
    byte of the stem, so no single task orders all of them.
    """
    from pyspark.sql import Window

    name = F.regexp_extract("path", r"([^/]+)$", 1)
    rows = files.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.regexp_extract(name, r"\.([^.]*)$", 1).alias("ext"), "path")
    samples = rows.groupBy("stem").agg(F.map_from_entries(F.sort_array(F.collect_set(F.struct("ext", "path")))).alias("parts")).withColumn("_b", F.pmod(F.xxhash64("stem"), F.lit(256)))
    before = samples.groupBy("_b").agg(F.count(F.lit(1)).alias("n")).withColumn("_before", F.sum("n").over(Window.orderBy("_b")) - F.col("n")).drop("n")
    number = F.row_number().over(Window.partitionBy("_b").orderBy("stem")) - 1 + F.col("_before")
    return samples.join(before, "_b").select("stem", div(number.cast("long"), per_shard).alias("shard"), "parts")


def file_stats(spark: SparkSession, path: str) -> DataFrame:
    """(folder, files, bytes) under a path; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return rows.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
