"""Every query against its SQL on the smallest tables; streaming against batch."""

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tracelake.operators import intervals, logs, resample
from tracelake.plans import media_queries, more_queries, oracle, queries, stage_queries
from tracelake.plans.queries import log
from tracelake.streaming import live

QUERIES = {**queries.QUERIES, **more_queries.QUERIES, **media_queries.QUERIES, **stage_queries.QUERIES}
ORACLE = {**oracle.ORACLE, **more_queries.ORACLE, **media_queries.ORACLE, **stage_queries.ORACLE}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def rows(frame):
    columns = sorted(frame.columns)
    values = frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()
    return columns, sorted((tuple(plain(v) for v in r) for r in values), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, sf_dir, name):
    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == rows(duck.execute(ORACLE[name]).df())


def test_key_repeat_is_uniform(spark, sf_dir):
    made = QUERIES["key_repeat"](spark, sf_dir).where("made")
    assert made.count() > 0 and made.where("not pressed").count() == 0


def test_flagship_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    ev = log(spark, sf_dir).select("episode", "seq", "ts_ns", "topic", "payload")
    for i in range(3):
        ev.where((F.col("ts_ns") >= F.lit(1_704_067_200 * 10**9 + i * 10 * 86_400 * 10**9)) & (F.col("ts_ns") < F.lit(1_704_067_200 * 10**9 + (i + 1) * 10 * 86_400 * 10**9))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    ev = spark.read.parquet(f"{tmp_path}/in")
    schema = "episode bigint, seq bigint, ts_ns bigint, topic string, payload string"
    hour = 3_600_000_000_000
    cases = {
        "thin": (lambda s: live.thin(s, 12 * hour), resample.thin(ev, 12 * hour).select("seq")),
        "keep": (lambda s: live.keep_while(s, "error", "9"), logs.keep_while(ev, F.col("topic") == "error", F.col("payload").contains("9")).select("seq")),
    }
    for name, (plan, batch) in cases.items():
        stream = live.log_stream(spark, f"{tmp_path}/in", schema=schema)
        q = plan(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        assert sorted(r.seq for r in spark.table(name).collect()) == sorted(r.seq for r in batch.collect())


def test_sessions_close(spark, sf_dir, tmp_path):
    ev = log(spark, sf_dir).select("episode", "seq", "ts_ns", "topic", "payload")
    ev.write.parquet(f"{tmp_path}/in")
    batch = live.sessions(ev.withColumn("event_time", F.timestamp_micros(F.floor(F.col("ts_ns") / 1000).cast("long"))), "24 hours")
    runs = intervals.activity(ev, ["click", "error", "purchase", "signup", "view"], 24 * 3_600_000_000_000)
    assert sorted((r.start_ns, r.end_ns) for r in batch.where("start_ns < end_ns").collect()) == sorted((r.start_ns, r.end_ns) for r in runs.collect())


def test_totals_beyond_a_bigint(spark, tmp_path):
    """Four users active for a century each: more nanoseconds than a bigint holds."""
    n, step = 25_000, 35 * 3600 * 10**6
    rows = spark.range(4 * n).select(
        F.col("id").alias("event_id"), F.timestamp_micros(F.floor(F.col("id") / 4) * step).cast("timestamp_ntz").alias("ts"), (F.col("id") % 4).alias("user_id"),
        F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"),
    )
    rows.write.parquet(f"{tmp_path}/events.parquet")
    found = {r.kind: (r.n, r.ns) for r in QUERIES["configured_extractors"](spark, str(tmp_path)).collect()}
    assert found == {"view": (4, 4 * (n - 1) * step * 1000), "click": (0, 0), "none": (0, 0)}
