"""Registered queries of stage tables, packing counters, configured extractors and versioned rewrites, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions.formats import div
from tracelake.operators import stats, tokens
from tracelake.plans import evolve, stages, versions
from tracelake.plans.extractors import from_config
from tracelake.plans.media_queries import envelopes
from tracelake.plans.oracle import DAY, EV, HOUR, W, activity
from tracelake.plans.queries import Query, log
from tracelake.sources.logs import load_stage, read_log, save_stage, write_log
from tracelake.sources.shared import shared_path

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
R = f"WITH RECURSIVE {EV}"


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


@query(f"""{W} SELECT CASE WHEN episode % 10 = 0 THEN 'test' ELSE 'train' END AS split, count(DISTINCT episode) AS episodes, count(*) AS rows, max(ts_ns) AS last_ns, 'binned' AS stage, {DAY} AS width FROM ev GROUP BY ALL""")
def stored_stage(spark: SparkSession, sf: str) -> DataFrame:
    """A stage table saved by split with its settings, and read back."""
    path = shared_path(spark, "stage")
    empty = F.array().cast("array<binary>")
    rows = log(spark, sf).select(F.col("episode").cast("string").alias("episode_path"), F.lit(0).alias("bin_idx"), F.col("ts_ns").alias("timestamp_ns"), empty.alias("state"), empty.alias("actions"), F.when(F.pmod("episode", F.lit(10)) == 0, "test").otherwise("train").alias("split"))
    save_stage(rows, path, {"width": DAY}, split="split")
    data, settings = load_stage(spark, path)
    out = data.groupBy("split").agg(F.count_distinct("episode_path").alias("episodes"), F.count(F.lit(1)).alias("rows"), F.max("timestamp_ns").alias("last_ns"))
    return out.withColumns({"stage": F.lit(settings["stage"]), "width": F.lit(settings["width"]).cast("bigint")})


@query(f"""{W} SELECT episode::VARCHAR AS episode, seq, ts_ns, topic, 'shop/' || upper(topic[1]) || topic[2:] AS message_type, cents FROM ev""")
def written_log(spark: SparkSession, sf: str) -> DataFrame:
    """The whole log written in folders by the episode's hash, and read back."""
    path = shared_path(spark, "log")
    write_log(envelopes(spark, sf), path)
    out = read_log(spark, path)
    return out.select("episode", "seq", "ts_ns", "topic", "message_type", F.get_json_object("payload", "$.cents").cast("bigint").alias("cents"))


@query(
    f"""{R}, c AS (SELECT episode, seq, (seq % 19 + 1)::BIGINT AS n, row_number() OVER (PARTITION BY episode ORDER BY ts_ns, seq) AS k FROM ev WHERE seq % 19 + 1 <= 16),
w AS (
  SELECT episode, n, k, k AS at, n AS used, 0 AS seq_no FROM (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY k) AS i FROM c) WHERE i = 1
  UNION ALL SELECT d.episode, d.n, d.k, d.k, CASE WHEN w.used + d.n > 16 THEN d.n ELSE w.used + d.n END, CASE WHEN w.used + d.n > 16 THEN w.seq_no + 1 ELSE w.seq_no END
  FROM w JOIN (SELECT *, lag(k) OVER (PARTITION BY episode ORDER BY k) AS before FROM c) d ON d.episode = w.episode AND d.before = w.k),
s AS (SELECT episode, seq_no, sum(n) AS used, count(*) AS events FROM w GROUP BY ALL),
t AS (SELECT count(*) AS sequences, sum(events)::BIGINT AS events, (16 * count(*) - sum(used))::BIGINT AS padding, sum(used)::BIGINT AS tokens FROM s),
m AS (SELECT count(*) AS rows, count(*) FILTER (WHERE seq % 19 + 1 > 16) AS skipped FROM ev)
SELECT unnest(['events', 'padding', 'rows', 'sequences', 'skipped', 'tokens']) AS counter, unnest([events, padding, rows, sequences, skipped, tokens]) AS n FROM t, m
UNION ALL SELECT 'test sequences', count(*) FROM s WHERE episode % 5 = 0"""
)
def packing_report(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of a packing, taken while it is written by split; sequences of the test split are counted in its folder."""
    path = shared_path(spark, "packed")
    ids = F.transform(F.sequence(F.lit(1), F.pmod("seq", F.lit(19)) + 1), lambda i: i.cast("int"))
    rows = log(spark, sf).select("episode", "seq", "ts_ns", ids.alias("token_ids"), "text", F.lit(True).alias("valid"), F.when(F.pmod("episode", F.lit(5)) == 0, "test").otherwise("train").alias("split"))
    counters = stages.write_packed(rows.withColumn("total_token_count", F.size("token_ids")), path, 16, tokens.pad_id_of({"<eos>": 0}), split="split")
    data, settings = load_stage(spark, path)
    told = [F.struct(F.lit(k).alias("counter"), F.lit(settings[k]).cast("bigint").alias("n")) for k in sorted(counters)]
    test = data.where("split = 'test'").agg(F.lit("test sequences").alias("counter"), F.count(F.lit(1)).alias("n"))
    return data.limit(1).select(F.inline(F.array(*told))).unionByName(test)


@query(f"""{W}, {activity('i', "'view'", 36 * HOUR)}, {activity('j', "'click'", 48 * HOUR)} SELECT 'view' AS kind, count(*) AS n, sum(end_ns - start_ns)::BIGINT AS ns FROM i UNION ALL SELECT 'click', count(*), sum(end_ns - start_ns)::BIGINT FROM j UNION ALL SELECT 'none', 0, 0""")
def configured_extractors(spark: SparkSession, sf: str) -> DataFrame:
    """Extractors made from their names and settings, joined with and less the empty one, and the empty one itself."""
    rows, empty = log(spark, sf), from_config("nothing")
    view = from_config("active", topics=["view"], gap_ns=36 * HOUR) | empty
    click = from_config("active", topics=["click"], gap_ns=48 * HOUR) - empty
    out = None
    for kind, plan in (("view", view), ("click", click), ("none", view & empty)):
        # Thousands of users' months together are more nanoseconds than a bigint holds.
        total = F.sum((F.col("end_ns") - F.col("start_ns")).cast("decimal(20,0)")).cast("decimal(38,0)")
        one = plan(rows).agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.coalesce(total, F.lit(0).cast("decimal(38,0)")).alias("ns"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    f"""{W}, a AS (SELECT *, 'store/' || upper(topic[1]) || topic[2:] AS kind FROM ev)
SELECT 3 AS version, '0.3.0' AS label, kind AS message_type, count(*) AS rows, sum(cents)::BIGINT AS total FROM a GROUP BY kind
UNION ALL SELECT 4, '0.1.0', replace(kind, 'store/', 'shop/'), count(*), sum(cents)::BIGINT FROM a GROUP BY kind"""
)
def versioned_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    """A log taken through two steps to 0.3.0, each checked as written, then rolled back; both versions are read."""
    root = shared_path(spark, "versions")
    versions.write(envelopes(spark, sf), root, label="0.1.0")
    prefix = evolve.Migration((0, 1, 0), (0, 2, 0), lambda d: d.withColumn("message_type", evolve.rename_prefix(F.col("message_type"), "shop", "store")))
    field = evolve.Migration((0, 2, 0), (0, 3, 0), lambda d: d.withColumn("payload", F.regexp_replace("payload", '"cents"', '"amount"')))
    versions.migrate(spark, root, [prefix, field], "0.2.0")
    versions.migrate(spark, root, [prefix, field], "0.3.0")
    versions.rollback(spark, root, to=1)
    out = None
    for number in (3, 4):
        v = next(v for v in versions.versions(spark, root) if v.number == number)
        amount = F.coalesce(F.get_json_object("payload", "$.amount"), F.get_json_object("payload", "$.cents")).cast("bigint")
        one = versions.read(spark, root, number).groupBy("message_type").agg(F.count(F.lit(1)).alias("rows"), F.sum(amount).alias("total")).withColumns({"version": F.lit(number), "label": F.lit(v.label)})
        out = one if out is None else out.unionByName(one)
    return out


@query(
    f"""{W}, g AS (SELECT episode, (ts_ns - lag(ts_ns) OVER (PARTITION BY episode ORDER BY ts_ns, seq)) // 1000000000 AS gap FROM ev)
SELECT episode, round(quantile_cont(gap, 0.1), 6) AS p10, round(quantile_cont(gap, 0.5), 6) AS p50, round(quantile_cont(gap, 0.99), 6) AS p99 FROM g WHERE gap IS NOT NULL GROUP BY episode"""
)
def gap_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Exact quantiles of the whole seconds between a user's events, by counts of values and ranges."""
    gap = div(F.col("ts_ns") - F.lag("ts_ns").over(Window.partitionBy("episode").orderBy("ts_ns", "seq")), 10**9)
    out = stats.quantiles(log(spark, sf).withColumn("gap", gap), "gap", {"p10": 0.1, "p50": 0.5, "p99": 0.99}, "episode")
    return out.select("episode", *[F.round(c, 6).alias(c) for c in ("p10", "p50", "p99")])
