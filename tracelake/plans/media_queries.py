"""Registered queries of containers, isolation, frames, cuts, packed samples, typed payloads and file listings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators import frames
from tracelake.plans import isolation
from tracelake.plans.extractors import everything
from tracelake.plans.oracle import DAY, EV, HOUR, W
from tracelake.plans.queries import Query, log, topic
from tracelake.plans.stages import EventConfig
from tracelake.schema import register_message_type, typed
from tracelake.sources import listing
from tracelake.sources.container import read_containers, write_containers
from tracelake.sources.shared import shared_path

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
FIRST = 1_704_067_200 * 10**9
R = f"WITH RECURSIVE {EV}"


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def envelopes(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a log whose payloads are JSON of their amount and number, one message type for each topic."""
    rows = log(spark, sf)
    payload = F.to_json(F.struct("cents", F.col("seq").alias("n")))
    return rows.select(F.col("episode").cast("string").alias("episode"), "seq", "ts_ns", "topic", F.concat(F.lit("shop/"), F.initcap("topic")).alias("message_type"), payload.alias("payload"))


@query(f"""{W} SELECT episode, seq, ts_ns, topic, 'shop/' || upper(topic[1]) || topic[2:] AS message_type, cents FROM ev WHERE topic IN ('click', 'purchase') AND ts_ns >= {FIRST + 5 * DAY} AND ts_ns <= {FIRST + 12 * DAY}""")
def container_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The log written as containers and read back by topic and time."""
    path = shared_path(spark, "containers")
    write_containers(envelopes(spark, sf), path, chunkBytes=16_384)
    got = read_containers(spark, path, topics=["click", "purchase"], start_ns=FIRST + 5 * DAY, end_ns=FIRST + 12 * DAY)
    return got.select(F.col("episode").cast("bigint").alias("episode"), "seq", "ts_ns", "topic", "message_type", F.get_json_object("payload", "$.cents").cast("bigint").alias("cents"))


@query(f"""{W} SELECT topic, count(*) AS messages, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns FROM ev GROUP BY topic""")
def container_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Of each topic the number of messages and its range, with filters that Spark pushes into the scan where it may."""
    path = shared_path(spark, "containers")
    write_containers(envelopes(spark, sf), path)
    return read_containers(spark, path).groupBy("topic").agg(F.count(F.lit(1)).alias("messages"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))


RULES = f"""b AS (SELECT *, CASE WHEN topic = 'error' AND cents > 9000 THEN 'error of too large an amount' WHEN topic = 'signup' AND cents % 100 = 7 THEN 'odd signup' END AS r FROM ev),
x AS (SELECT episode, arg_min(r, (ts_ns, seq)) FILTER (WHERE r IS NOT NULL) AS reason, arg_min(seq, (ts_ns, seq)) FILTER (WHERE r IS NOT NULL) AS at_seq, count(r) AS broken, count(*) AS rows FROM b GROUP BY episode HAVING count(r) > 0)"""


@query(
    f"""{W}, {RULES}
SELECT episode, reason, at_seq, broken, rows FROM x
UNION ALL SELECT episode, 'ok', min(seq), 0, count(*) FROM (SELECT *, max(ts_ns) OVER (PARTITION BY episode) AS last FROM ev)
WHERE ts_ns < last AND episode NOT IN (SELECT episode FROM x) AND topic IN ('click', 'view', 'purchase') GROUP BY episode"""
)
def isolated_stage(spark: SparkSession, sf: str) -> DataFrame:
    """Episodes that break a rule as rejects, and what the event stage makes of the others."""
    cents = F.col("cents")
    rules = {"error of too large an amount": ~((F.col("topic") == "error") & (cents > 9000)), "odd signup": ~((F.col("topic") == "signup") & (cents % 100 == 7))}
    events, bad = isolation.isolated_events(log(spark, sf), EventConfig(keep_topics=("click", "view", "purchase"), extractor=everything()), rules)
    zero = F.lit(0).cast("bigint")
    sound = events.groupBy("episode").agg(F.lit("ok").alias("reason"), F.min("seq").alias("at_seq"), F.max(zero).alias("broken"), F.count(F.lit(1)).alias("rows"))
    return bad.unionByName(sound)


@query(
    f"""{R}, r AS (SELECT episode, seq, CASE WHEN seq % 5 = 0 THEN NULL ELSE (ts_ns - {FIRST}) // {DAY // 1000} END AS pts, row_number() OVER (PARTITION BY episode ORDER BY ts_ns, seq) AS n FROM ev),
w AS (
  SELECT episode, seq, n, true AS keep, coalesce(pts, 0) AS last FROM r WHERE n = 1
  UNION ALL
  SELECT r.episode, r.seq, r.n, coalesce(r.pts, w.last + 1000) - w.last >= 500, CASE WHEN coalesce(r.pts, w.last + 1000) - w.last >= 500 THEN coalesce(r.pts, w.last + 1000) ELSE w.last END FROM w JOIN r ON r.episode = w.episode AND r.n = w.n + 1)
SELECT episode, seq, last AS out_pts FROM w WHERE keep"""
)
def written_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Media times of a writer of variable rate: a thousand ticks a day, frames without a time after the one before, duplicates skipped."""
    rows = log(spark, sf).withColumn("pts", F.when(F.pmod("seq", F.lit(5)) != 0, F.expr(f"(ts_ns - {FIRST}) div {DAY // 1000}")))
    return frames.written_pts(rows, "pts", fps=60, rate=frames.VARIABLE_RATE).select("episode", "seq", "out_pts")


@query(
    f"""{W}, f AS (SELECT episode, seq, (ts_ns - {FIRST}) * 10 // {6 * 3600} AS t FROM ev),
l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY episode, t ORDER BY seq DESC) = 1),
g AS (SELECT episode, min(t) AS t0, unnest(range(0, ((max(t) - min(t)) * 3 + 999999999) // 1000000000 + 1)) AS slot FROM f GROUP BY episode),
s AS (SELECT episode, slot, t0 + slot * 1000000000 // 3 AS slot_ns, t0, (slot * 1000000000 + 2) // 3 AS least FROM g),
a AS (SELECT s.episode, s.slot, s.slot_ns, l.seq, l.t FROM s ASOF JOIN (SELECT l.*, ceil((t - (SELECT min(t) FROM f WHERE f.episode = l.episode)) * 3::HUGEINT / 1000000000)::BIGINT AS from_slot FROM l
  QUALIFY row_number() OVER (PARTITION BY episode, from_slot ORDER BY t DESC) = 1) l ON s.episode = l.episode AND s.slot >= l.from_slot)
SELECT episode, seq, slot, slot_ns, row_number() OVER (PARTITION BY episode, seq ORDER BY slot) > 1 AS repeated FROM a"""
)
def constant_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Three frames a second of a log in which 36 minutes are a second."""
    rows = log(spark, sf).withColumn("ts_ns", F.expr(f"(ts_ns - {FIRST}) * 10 div {6 * 3600}"))
    return frames.constant_rate(rows, 3).select("episode", "seq", "slot", "slot_ns", "repeated")


@query(
    f"""{W}, f AS (SELECT episode, 'v' || (seq % 2) AS uri, ts_ns - {FIRST} AS pts_ns, max(ts_ns - {FIRST}) FILTER (WHERE topic = 'view') OVER (PARTITION BY episode, seq % 2 ORDER BY ts_ns) AS key_pts_ns, topic = 'view' AS is_key FROM ev),
l AS (SELECT *, max(pts_ns) OVER (PARTITION BY episode, uri) AS last FROM f)
SELECT episode, uri, pts_ns, key_pts_ns, is_key FROM l WHERE pts_ns >= {3 * DAY} AND pts_ns <= last - {2 * DAY}"""
)
def frame_range(spark: SparkSession, sf: str) -> DataFrame:
    """Frames from the fourth day to two days before the end of each video, from a written index."""
    path = shared_path(spark, "frames")
    rows = log(spark, sf).select("episode", F.concat(F.lit("v"), F.pmod("seq", F.lit(2))).alias("uri"), (F.col("ts_ns") - FIRST).alias("pts_ns"), "topic")
    frames.frame_index(rows, F.col("topic") == "view", path)
    return frames.frames_between(spark.read.parquet(path), 3 * 86_400, -2 * 86_400)


LADDER = [HOUR, 3 * HOUR, 6 * HOUR, 12 * HOUR, 24 * HOUR, 48 * HOUR]


@query(
    f"""{W}, t AS (SELECT episode, min(ts_ns) + {4 * DAY} AS s, min(ts_ns) + {9 * DAY} AS e FROM ev GROUP BY episode),
v AS (SELECT episode, seq % 2 AS uri, max(ts_ns) AS video_end FROM ev GROUP BY ALL),
k AS (SELECT episode, seq % 2 AS uri, ts_ns FROM ev WHERE topic IN ('view', 'click')),
m AS (SELECT unnest(range(0, {len(LADDER)})) AS step, unnest({LADDER}) AS m),
c AS (
  SELECT v.episode, v.uri, m.step, m.m, t.s, t.e, (SELECT min(k.ts_ns) FROM k WHERE k.episode = v.episode AND k.uri = v.uri AND k.ts_ns >= t.s - m.m) AS a, least(v.video_end, t.e + m.m) AS b FROM v JOIN t USING (episode), m),
o AS (SELECT *, coalesce(a <= s AND b >= e, false) AS ok FROM c),
p AS (SELECT episode, step, m, max(a) AS a, min(b) AS b, any_value(s) AS s, any_value(e) AS e, bool_and(ok) AS ok FROM o GROUP BY episode, step, m),
q AS (SELECT * FROM p WHERE ok QUALIFY row_number() OVER (PARTITION BY episode ORDER BY step) = 1),
f AS (SELECT episode, coalesce(string_agg('v' || uri, ',' ORDER BY uri) FILTER (WHERE NOT ok), '') AS offending FROM o WHERE step = {len(LADDER) - 1} GROUP BY episode)
SELECT f.episode, coalesce(q.step, -1) AS step, coalesce(q.m, -1) AS margin_ns, coalesce(q.a, -1) AS cut_start_ns, coalesce(q.b, -1) AS cut_end_ns, CASE WHEN q.step IS NULL THEN 'not covered' WHEN greatest(q.s - q.a, q.b - q.e) > {DAY} THEN 'too wide' ELSE 'ok' END AS status, f.offending
FROM f LEFT JOIN q USING (episode)"""
)
def cut_ladder(spark: SparkSession, sf: str) -> DataFrame:
    """Cuts of each user's fifth to ninth day from two videos, whose key frames are views and clicks."""
    rows = log(spark, sf).withColumn("uri", F.concat(F.lit("v"), F.pmod("seq", F.lit(2))))
    targets = rows.groupBy("episode").agg((F.min("ts_ns") + 4 * DAY).alias("start_ns"), (F.min("ts_ns") + 9 * DAY).alias("end_ns"))
    ends = rows.groupBy("episode", "uri").agg(F.max("ts_ns").alias("end_ns"))
    plan = frames.cut_plan(rows.where(topic("view", "click")), ends, targets, margins_ns=LADDER, max_margin_ns=DAY)
    return plan.na.fill(-1).withColumn("offending", F.array_join("offending", ","))


@query(
    f"""{W}, s AS (SELECT episode, (ts_ns - {FIRST}) // {5 * DAY} AS seq_no, seq, ts_ns, 'u' || (cents % 40) AS uri, cents % 40 AS k, topic IN ('view', 'error') AS img FROM ev),
n AS (SELECT episode, seq_no, count(*) AS n_tokens FROM s GROUP BY ALL),
i AS (SELECT *, CASE WHEN k % 3 <> 0 THEN 'image ' || k END AS own FROM s WHERE img),
j AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY episode, seq_no ORDER BY ts_ns, seq) AS prev FROM i),
o AS (SELECT episode, seq_no, count(*) AS n_images, count(*) FILTER (WHERE own IS NULL) AS n_fallback, sum(length(coalesce(own, prev, 'black'))) AS media_bytes,
  string_agg(uri || '=' || coalesce(own, prev, 'black') || ':' || CASE WHEN own IS NOT NULL THEN 'own' WHEN prev IS NOT NULL THEN 'previous' ELSE 'blank' END, ',' ORDER BY ts_ns, seq) AS media FROM j GROUP BY ALL)
SELECT episode, seq_no, n_tokens, coalesce(n_images, 0) AS n_images, coalesce(n_fallback, 0) AS n_fallback, coalesce(media_bytes, 0)::BIGINT AS media_bytes, coalesce(media, '') AS media FROM n LEFT JOIN o USING (episode, seq_no)"""
)
def read_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of five days whose screens are views and errors; every third image can't be loaded."""
    rows = log(spark, sf).withColumn("k", F.pmod("cents", F.lit(40))).withColumn("seq_no", F.expr(f"(ts_ns - {FIRST}) div {5 * DAY}"))
    refs = F.transform(F.sort_array(F.collect_list(F.when(topic("view", "error"), F.struct("ts_ns", "seq", F.concat(F.lit("u"), "k").alias("u"))))), lambda x: x["u"])
    samples = rows.groupBy("episode", "seq_no").agg(refs.alias("images"), F.concat(F.array_repeat(F.lit(1), F.count(F.lit(1)).cast("int")), F.array_repeat(F.lit(0), 7)).alias("attention_mask"))
    media = rows.select("k").distinct().where("k % 3 <> 0").select(F.concat(F.lit("u"), "k").alias("uri"), F.concat(F.lit("image "), "k").cast("binary").alias("value"))
    out = frames.read_samples(samples, media, F.lit("black").cast("binary"))
    shown = F.array_join(F.transform("media", lambda m: F.concat(m["uri"], F.lit("="), m["value"].cast("string"), F.lit(":"), m["how"])), ",")
    return out.select("episode", "seq_no", F.col("n_tokens").cast("bigint").alias("n_tokens"), F.col("n_images").cast("bigint").alias("n_images"), "n_fallback", "media_bytes", shown.alias("media"))


@query(f"""{W} SELECT episode, sum(cents) FILTER (WHERE topic = 'click')::BIGINT AS clicked, max(seq) FILTER (WHERE topic = 'purchase') AS last_purchase, count(*) FILTER (WHERE topic NOT IN ('click', 'purchase')) AS others FROM ev GROUP BY episode""")
def typed_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Message types registered here: payloads of each decode into a column of their own."""
    for name in ("shop/Click", "shop/Purchase"):
        register_message_type(name, "cents bigint, n bigint")
    rows = typed(envelopes(spark, sf), ["shop/Click", "shop/Purchase"])
    click, purchase = F.col("typed.shop__Click"), F.col("typed.shop__Purchase")
    return rows.groupBy(F.col("episode").cast("bigint").alias("episode")).agg(F.sum(click["cents"]).alias("clicked"), F.max(purchase["n"]).alias("last_purchase"), F.count(F.when(click.isNull() & purchase.isNull(), 1)).alias("others"))


@query(
    f"""{W}, m AS (SELECT DISTINCT episode % 7 AS log, CASE WHEN seq % 4 = 0 THEN 'media/' || (cents % 5) || '.txt' WHEN seq % 4 = 1 THEN '../shared/' || (cents % 6) || '.txt' WHEN seq % 4 = 2 THEN 'data:x' ELSE 'none.txt' END AS uri FROM ev),
s AS (SELECT DISTINCT cents % 5 AS k FROM ev WHERE topic = 'click'), t AS (SELECT DISTINCT cents % 6 AS k FROM ev WHERE topic = 'error'),
f AS (SELECT log, uri, uri IN (SELECT 'media/' || k || '.txt' FROM s) OR uri IN (SELECT '../shared/' || k || '.txt' FROM t) AS file, uri = 'data:x' AS inside FROM m),
e AS (SELECT episode % 7 AS log, count(*) AS messages, max(ts_ns) - min(ts_ns) AS duration_ns FROM ev GROUP BY ALL)
SELECT log, messages, duration_ns, count(*) AS media, count(*) FILTER (WHERE NOT file AND NOT inside) AS missing_media, true AS sized FROM e JOIN f USING (log) GROUP BY ALL"""
)
def log_files(spark: SparkSession, sf: str) -> DataFrame:
    """Seven logs written beside their media: messages, media and missing media of each, from the listing of the files."""
    root = shared_path(spark, "files")
    rows = log(spark, sf).withColumn("log", F.pmod("episode", F.lit(7)))
    rows.select("log", "episode", "seq", "ts_ns", "cents").repartition("log").write.partitionBy("log").json(f"{root}/logs")
    uri = F.when(F.pmod("seq", F.lit(4)) == 0, F.format_string("media/%d.txt", F.pmod("cents", F.lit(5)))).when(F.pmod("seq", F.lit(4)) == 1, F.format_string("../shared/%d.txt", F.pmod("cents", F.lit(6)))).when(F.pmod("seq", F.lit(4)) == 2, "data:x").otherwise("none.txt")
    for folder, name, n in (("root/media", "click", 5), ("logs/shared", "error", 6)):
        rows.where(F.col("topic") == name).select(F.format_string("%d", F.pmod("cents", F.lit(n))).alias("k")).distinct().select("k", F.col("k").alias("v")).write.partitionBy("k").text(f"{root}/{folder}")
    read = listing.with_log_path(spark.read.schema("log int, episode bigint, seq bigint, ts_ns bigint, cents bigint").json(f"{root}/logs/log=*").where("ts_ns is not null"))
    found = listing.files(spark, root)
    # A media file is the folder that Spark wrote for its name, so the listing gets its name from the folder.
    named = found.withColumn("path", F.when(F.col("path").contains("/k="), F.regexp_replace("path", "/k=(\\d+)/[^/]*$", "/$1.txt")).otherwise(F.col("path"))).where("path like '%.json' or path like '%.txt'")
    refs = read.select("log_path", uri.alias("uri")).distinct()
    media = listing.resolved(refs, named, root=f"{root}/root")
    each, _ = listing.log_sizes(read, named, media)
    number = F.regexp_extract("log_path", "log=(\\d+)/", 1).cast("bigint")
    return each.groupBy(number.alias("log")).agg(F.sum("messages").alias("messages"), F.max("duration_ns").alias("duration_ns"), F.sum("media").alias("media"), F.sum("missing_media").alias("missing_media"), F.bool_and(F.col("bytes") > 0).alias("sized"))
