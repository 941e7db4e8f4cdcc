"""Files as a table: what lies in a folder, bytes and media of each log, which references resolve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str, *, pattern: str | None = None, required: bool = True) -> DataFrame:
    """(path, name, bytes, modified) of the files in a folder and below; an error where there are none.

    Spark lists the folders; contents are not read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    found = reader.load(path).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    found = found.withColumn("name", F.substring_index("path", "/", -1)).select("path", "name", "bytes", "modified")
    if required and not found.limit(1).count():
        raise FileNotFoundError(f"no files in {path}" + (f" like {pattern}" if pattern else ""))
    return found


def plain_path(path: Column) -> Column:
    """A path without its scheme and without ``.`` and ``a/..`` steps, so that two spellings meet."""
    bare = F.regexp_replace(F.regexp_replace(path, "^[a-z][a-z0-9+.-]*://[^/]*|^file:", ""), "/(\\./)+", "/")
    for _ in range(4):  # so many levels up
        bare = F.regexp_replace(bare, "/[^/]+/\\.\\./", "/")
    return F.regexp_replace(bare, "/{2,}", "/")


def resolved(references: DataFrame, listing: DataFrame, *, uri: str = "uri", log: str = "log_path", root: str | None = None) -> DataFrame:
    """``references`` with ``path``, ``bytes`` and ``found``: beside the log, else under ``root``, or null.

    An absolute URI is looked for as it is. Embedded data (``data:``) is found without a file.
    Both steps are one join: the better place wins.
    """
    own, embedded = F.col(uri), F.col(uri).startswith("data:")
    absolute = own.rlike("^([a-z][a-z0-9+.-]*:|/)")
    beside = F.concat(F.regexp_replace(F.col(log), "[^/]*$", ""), own)
    places = [F.struct(F.lit(0).alias("rank"), plain_path(F.when(absolute, own).otherwise(beside)).alias("_at"))]
    if root:
        places.append(F.struct(F.lit(1).alias("rank"), plain_path(F.when(absolute, own).otherwise(F.concat(F.lit(f"{root.rstrip('/')}/"), own))).alias("_at")))
    asked = references.select(F.col(uri), F.col(log)).distinct()
    tried = asked.where(F.coalesce(~embedded, F.lit(False))).select(uri, log, F.inline(F.array(*places)))
    there = listing.select(plain_path(F.col("path")).alias("_at"), "path", "bytes")
    best = tried.join(there, "_at").groupBy(uri, log).agg(F.min_by(F.struct("path", "bytes"), "rank").alias("_f"))
    out = references.join(best, [uri, log], "left")
    found = F.coalesce(embedded, F.lit(False)) | F.col("_f").isNotNull()
    return out.select(*references.columns, F.col("_f.path").alias("path"), F.col("_f.bytes").alias("bytes"), found.alias("found"))


def log_sizes(logs: DataFrame, listing: DataFrame, media: DataFrame, *, most: int = 25) -> tuple[DataFrame, DataFrame]:
    """(per log, the ``most`` largest): (log_path, bytes, messages, duration_ns, media, media_bytes, missing_media).

    logs: (log_path, ts_ns) messages; media: ``resolved`` references of logs. A file that several
    references of a log share counts once. Logs without messages have none.
    """
    sizes = listing.select(plain_path(F.col("path")).alias("_at"), F.col("bytes"))
    told = logs.groupBy("log_path").agg(F.count(F.lit(1)).alias("messages"), (F.max("ts_ns") - F.min("ts_ns")).alias("duration_ns"))
    shown = media.select("log_path", "uri", "path", "bytes", "found").distinct().groupBy("log_path").agg(F.count(F.lit(1)).alias("media"), F.sum("bytes").alias("media_bytes"), F.count(F.when(~F.col("found"), 1)).alias("missing_media"))
    each = told.withColumn("_at", plain_path(F.col("log_path"))).join(sizes, "_at", "left").drop("_at").join(shown, "log_path", "left")
    zero = F.lit(0).cast("bigint")
    each = each.select("log_path", "bytes", "messages", "duration_ns", *[F.coalesce(c, zero).alias(c) for c in ("media", "media_bytes", "missing_media")])
    return each, each.orderBy(F.col("bytes").desc_nulls_last(), "log_path").limit(most)


def with_log_path(rows: DataFrame) -> DataFrame:
    """``rows`` of a file source with ``log_path``: the file that each is from."""
    return rows.withColumn("log_path", F.col("_metadata.file_path"))


def folder_totals(listing: DataFrame, root: str) -> DataFrame:
    """(folder, files, bytes, share): the first level below ``root``, with each folder's share of all bytes."""
    below = F.regexp_replace(plain_path(F.col("path")), f"^{plain_text(root)}/?", "")
    found = listing.withColumn("folder", F.when(below.contains("/"), F.substring_index(below, "/", 1)).otherwise("")).groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
    return found.withColumn("share", F.col("bytes") / F.sum("bytes").over(Window.partitionBy()))


def plain_text(path: str) -> str:
    """A path as a pattern: without its scheme, every character for itself."""
    import re

    return re.escape(re.sub(r"^[a-z][a-z0-9+.-]*://[^/]*|^file:", "", path).rstrip("/"))
