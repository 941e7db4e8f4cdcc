"""Log tables: discovery, reading, writing, stage tables with their settings beside them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions.formats import micros
from tracelake.schema import ENVELOPE, stage_of


def read_jsonl(spark: SparkSession, path: str, *, recursive: bool = True) -> DataFrame:
    """Envelopes from JSON lines, all ``*.jsonl`` files under the path; the episode defaults to the file.

    Where rows of an episode lack ``seq``, all of its rows are numbered by time, topic, type and payload, so that
    neither the files beside it nor their splits matter.
    """
    reader = spark.read.schema(ENVELOPE).option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.jsonl")
    rows = reader.json(path)
    rows = rows.withColumn("episode", F.coalesce("episode", F.input_file_name()))
    whole = Window.partitionBy("episode")
    number = F.row_number().over(whole.orderBy("ts_ns", "topic", "message_type", "payload")).cast("bigint") - 1
    return rows.withColumn("seq", F.when(F.count("seq").over(whole) == F.count(F.lit(1)).over(whole), F.col("seq")).otherwise(number))


#: Folders of a written log; an episode is in the one of its hash.
BUCKETS = 256


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def write_log(events: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """Write envelopes sorted by episode and time, in folders by the episode's hash; a topic with two message types in an episode is an error."""
    mixed = events.groupBy("episode", "topic").agg(F.count_distinct("message_type").alias("n")).where("n > 1").limit(1).collect()
    if mixed:
        raise ValueError(f"topic {mixed[0]['topic']} of {mixed[0]['episode']} has {mixed[0]['n']} message types")
    rows = events.withColumn("bucket", F.pmod(F.xxhash64("episode"), F.lit(BUCKETS)))
    order = ["bucket", "episode", "ts_ns", "seq"]
    # Ranges of near equal size, so that neither a folder nor an episode is one task's work.
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy("bucket").parquet(path)


def side_table(rows: DataFrame, path: str) -> None:
    """Attachments and metadata: (episode, name, values map)."""
    rows.select("episode", "name", F.col("values").cast("map<string,string>")).write.parquet(path)


def first_messages(events: DataFrame, n: int = 1024) -> DataFrame:
    """The first messages in time order, as JSON lines."""
    return events.orderBy("ts_ns", "seq").limit(n).select(F.to_json(F.struct(*events.columns)).alias("value"))


def save_stage(df: DataFrame, path: str, settings: dict[str, object], *, split: str | None = None) -> None:
    """A stage table with its settings; ``split`` is a column to divide by."""
    writer = df.write
    if split:
        writer = writer.partitionBy(split)
    writer.parquet(f"{path}/data")
    save_settings(df.sparkSession, path, {"stage": stage_of(df.schema)} | settings)


def save_settings(spark: SparkSession, path: str, settings: dict[str, object]) -> None:
    """Settings as one JSON line beside a stage's data."""
    spark.createDataFrame([(json.dumps(settings, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/settings")


def load_stage(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, object]]:
    return spark.read.parquet(f"{path}/data"), json.loads(spark.read.text(f"{path}/settings").first()[0])


def hash_split(df: DataFrame, key: str, test_percent: int) -> DataFrame:
    """``df`` with split train or test by episode."""
    return df.withColumn("split", F.when(F.pmod(F.xxhash64(key), F.lit(100)) < test_percent, "test").otherwise("train"))


def events_as_log(events: DataFrame) -> DataFrame:
    """The ``events`` table as envelopes: episode is the user, seq the event, topic its type, value in the payload."""
    return events.select(
        F.col("user_id").alias("episode"), F.col("event_id").alias("seq"), (micros(F.col("ts")) * 1000).alias("ts_ns"), F.col("event_type").alias("topic"), F.col("value"), F.col("props").alias("payload")
    )
