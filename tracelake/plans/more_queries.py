"""Registered queries of device streams, media references, subtitles, imports, evolution and the catalog, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import codecs
from tracelake.operators import bins, intervals, logs, resample, stats, timelines, tokens
from tracelake.plans import catalog, evolve, queries, stages
from tracelake.plans.oracle import CODES, DAY, EV, HOUR, MOUSE, THIN, W, activity, thinned
from tracelake.plans.queries import TOPICS, Query, log, read, topic
from tracelake.sources.importers import eligible, ticks_to_events
from tracelake.sources.logs import first_messages

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
FIRST = 1_704_067_200 * 10**9


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def devices(spark: SparkSession, sf: str) -> DataFrame:
    """Events as device rows: clicks are raw mouse moves, views and signups presses and releases, errors screens."""
    name = F.when(topic("click"), "mouse/raw").when(topic("view", "signup"), "keyboard").when(topic("error"), "screen").otherwise("window")
    mouse = F.struct((F.col("cents") - 2500).alias("last_x"), F.pmod("seq", F.lit(90)).alias("last_y"), F.when(F.pmod("seq", F.lit(6)) == 0, 1).otherwise(0).alias("button_flags"))
    key = F.struct(F.when(topic("view"), "press").otherwise("release").alias("event_type"), F.pmod("seq", F.lit(3)).alias("vk"))
    payload = F.when(topic("click"), F.to_json(mouse)).when(topic("view", "signup"), F.to_json(key)).otherwise(F.col("payload"))
    return log(spark, sf).select("episode", "seq", "ts_ns", name.alias("topic"), F.lit("desktop/Any").alias("message_type"), payload.alias("payload"))


DEVICES = f"""de AS (
  SELECT episode, seq, ts_ns, topic AS t, cents, CASE topic WHEN 'click' THEN 'mouse/raw' WHEN 'view' THEN 'keyboard' WHEN 'signup' THEN 'keyboard' WHEN 'error' THEN 'screen' ELSE 'window' END AS topic FROM ev)"""


@query(
    f"""WITH RECURSIVE {EV}, {DEVICES}, m AS (SELECT * FROM de WHERE t = 'click' AND seq % 6 <> 0), {thinned('m', 'episode', **THIN)},
g AS (SELECT *, coalesce(sum(keep::INTEGER) OVER (PARTITION BY episode ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM w),
s AS (SELECT episode, g, sum(cents - 2500)::BIGINT AS x, sum(seq % 90)::BIGINT AS y FROM g GROUP BY episode, g),
k AS (SELECT *, lag(t) OVER (PARTITION BY episode, seq % 3 ORDER BY ts_ns, seq) AS was FROM de WHERE topic = 'keyboard'),
sc AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY ts_ns, seq) AS n FROM de WHERE topic = 'screen'),
v AS (
  SELECT sc.*, true AS keep, sc.ts_ns AS last FROM sc WHERE n = 1
  UNION ALL SELECT sc.*, sc.ts_ns - v.last >= {DAY}, CASE WHEN sc.ts_ns - v.last >= {DAY} THEN sc.ts_ns ELSE v.last END FROM v JOIN sc ON sc.episode = v.episode AND sc.n = v.n + 1)
SELECT g.episode, g.seq, g.topic, s.x, s.y FROM g JOIN s ON g.episode = s.episode AND g.g = s.g WHERE g.keep
UNION ALL SELECT episode, seq, topic, cents - 2500, seq % 90 FROM de WHERE t = 'click' AND seq % 6 = 0
UNION ALL SELECT episode, seq, topic, NULL, NULL FROM k WHERE NOT (t = 'view' AND coalesce(was, '') = 'view')
UNION ALL SELECT episode, seq, topic, NULL, NULL FROM v WHERE keep UNION ALL SELECT episode, seq, topic, NULL, NULL FROM de WHERE topic = 'window'"""
)
def resampled_devices(spark: SparkSession, sf: str) -> DataFrame:
    """At rates under 1 Hz the gap rule starts held keys anew at every row, so none is repeated."""
    rates = {"mouse/raw": 1e9 / (12 * HOUR), "keyboard": 1e9 / (6 * HOUR), "screen": 1e9 / DAY}
    out = resample.resample(devices(spark, sf), rates)
    field = lambda name: F.get_json_object("payload", f"$.{name}").cast("bigint")
    return out.select("episode", "seq", "topic", field("last_x").alias("x"), field("last_y").alias("y"))


REPEAT = f"""r AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY ts_ns, seq) AS n, CASE WHEN topic IN ('view', 'click') THEN seq % 3 END AS vk FROM ev),
w AS (
  SELECT episode, key, 0::BIGINT AS n, false AS keep, false AS down, 0::BIGINT AS start, 0::BIGINT AS made, 0::BIGINT AS last FROM (SELECT DISTINCT episode FROM ev), (SELECT unnest([0, 1, 2]) AS key)
  UNION ALL
  SELECT episode, key, n, keep, down, start, CASE WHEN down AND t - start < {DAY} THEN (t - start) // {3 * HOUR} ELSE 0 END,
    CASE WHEN NOT down THEN start WHEN t - start >= {DAY} THEN t ELSE start + (t - start) // {3 * HOUR} * {3 * HOUR} END
  FROM (
    SELECT r.episode, w.key, r.n, r.ts_ns AS t, coalesce(r.vk = w.key, false) AND (r.topic = 'click' OR NOT w.down) AS keep,
      CASE WHEN coalesce(r.vk = w.key, false) THEN r.topic = 'view' ELSE w.down END AS down,
      CASE WHEN coalesce(r.vk = w.key, false) AND r.topic = 'view' AND NOT w.down THEN r.ts_ns ELSE w.last END AS start
    FROM w JOIN r ON r.episode = w.episode AND r.n = w.n + 1))"""


@query(
    f"""WITH RECURSIVE {EV}, {REPEAT}
SELECT r.episode, r.seq, r.ts_ns, r.vk, r.topic = 'view' AS pressed, false AS made FROM r JOIN w ON w.episode = r.episode AND w.n = r.n AND w.key = r.vk WHERE w.keep
UNION ALL SELECT episode, seq, ts_ns, -1, false, false FROM r WHERE vk IS NULL
UNION ALL SELECT episode, seq, start + i * {3 * HOUR}, key, true, true FROM (SELECT r.episode, r.seq, w.start, w.key, unnest(range(1, w.made + 1)) AS i FROM r JOIN w ON w.episode = r.episode AND w.n = r.n)"""
)
def key_repeat(spark: SparkSession, sf: str) -> DataFrame:
    pressed = F.when(topic("view"), True).when(topic("click"), False)
    ev = log(spark, sf).withColumns({"vk": F.when(pressed.isNotNull(), F.pmod("seq", F.lit(3))), "pressed": pressed})
    out = resample.key_repeat(ev, 3 * HOUR, DAY)
    return out.select("episode", "seq", "ts_ns", F.coalesce("vk", F.lit(-1)).alias("vk"), F.coalesce("pressed", F.lit(False)).alias("pressed"), "made")


@query(f"""WITH RECURSIVE {EV}, {thinned('ev', 'episode', 'r.ts_ns - {last} >= ' + str(12 * HOUR), 'r.ts_ns', '-10000000000000000::BIGINT')} SELECT episode, seq FROM w WHERE keep""")
def cursor_sample(spark: SparkSession, sf: str) -> DataFrame:
    return resample.cursor_sample(log(spark, sf), 12 * HOUR).select("episode", "seq")


@query(f"{W} SELECT episode, seq FROM ev WHERE topic <> 'view' ORDER BY ts_ns DESC, episode DESC, seq DESC LIMIT 100")
def last_rows(spark: SparkSession, sf: str) -> DataFrame:
    return logs.ordered(logs.scan(log(spark, sf), exclude=["view"]), reverse=True, limit=100).select("episode", "seq")


@query(f"{W} SELECT episode, seq FROM ev WHERE ts_ns >= 1704500000250000000 AND ts_ns < 1705000000500000000")
def seconds_scan(spark: SparkSession, sf: str) -> DataFrame:
    return logs.scan(log(spark, sf), **logs.seconds_range(1704500000.25, 1705000000.5)).select("episode", "seq")


@query(f"""{W}, m AS (SELECT *, last_value(CASE WHEN topic = 'error' THEN cents > 1000 END IGNORE NULLS) OVER (PARTITION BY episode ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING) AS m FROM ev)
SELECT episode, seq FROM m WHERE m""")
def checked_sanitize(spark: SparkSession, sf: str) -> DataFrame:
    return logs.checked_sanitize(log(spark, sf), topic("error"), F.col("cents") > 1000, 0.9).select("episode", "seq")


@query(f"""{W} SELECT '{{"episode":' || episode || ',"seq":' || seq || ',"ts_ns":' || ts_ns || ',"topic":"' || topic || '"}}' AS value FROM ev ORDER BY ts_ns, seq LIMIT 50""")
def first_as_json(spark: SparkSession, sf: str) -> DataFrame:
    return first_messages(log(spark, sf).select("episode", "seq", "ts_ns", "topic"), 50)


def media(spark: SparkSession, sf: str) -> DataFrame:
    """Views as screens: every 50 of them are one video, some without a reference."""
    ref = F.struct(F.concat(F.lit("v"), F.floor(F.col("seq") / 50).cast("string"), F.lit(".mkv")).alias("uri"), (F.pmod("seq", F.lit(50)) * 10**7).alias("pts_ns"))
    rows = log(spark, sf).where(topic("view"))
    return rows.withColumns({"media_ref": F.when(F.pmod("seq", F.lit(11)) != 0, ref), "utc_ns": F.when(F.pmod("seq", F.lit(4)) == 0, F.col("ts_ns") + 5)})


MEDIA = """me AS (
  SELECT *, CASE WHEN seq % 11 <> 0 THEN 'v' || (seq // 50) || '.mkv' END AS uri, CASE WHEN seq % 11 <> 0 THEN seq % 50 * 10000000 END AS pts, CASE WHEN seq % 4 = 0 THEN ts_ns + 5 END AS utc FROM ev WHERE topic = 'view')"""


@query(f"{W}, {MEDIA} SELECT DISTINCT uri FROM me WHERE uri IS NOT NULL")
def referenced_media(spark: SparkSession, sf: str) -> DataFrame:
    return logs.referenced_media(media(spark, sf))


@query(f"{W}, {MEDIA} SELECT seq, CASE WHEN uri IS NOT NULL THEN 'new.mkv' END AS uri, pts FROM me")
def renamed_media(spark: SparkSession, sf: str) -> DataFrame:
    return logs.rename_media(media(spark, sf), "new.mkv").select("seq", F.col("media_ref.uri").alias("uri"), F.col("media_ref.pts_ns").alias("pts"))


@query(f"{W}, {MEDIA} SELECT count(*) AS total, count(uri) AS screens, count(*) FILTER (WHERE uri <> 'v3.mkv') AS modified, string_agg(DISTINCT uri, ',' ORDER BY uri) AS originals FROM me")
def rename_report(spark: SparkSession, sf: str) -> DataFrame:
    return logs.rename_report(media(spark, sf), "v3.mkv").withColumn("originals", F.array_join("originals", ","))


@query(
    f"""{W}, {MEDIA} SELECT seq, CASE WHEN uri IS NOT NULL THEN CASE uri WHEN 'v1.mkv' THEN 'cut1.mkv' ELSE uri END END AS uri, CASE WHEN uri IS NOT NULL THEN coalesce(CASE WHEN utc <> 0 THEN utc END, ts_ns) - {FIRST} END AS pts
FROM me WHERE ts_ns >= {FIRST} AND ts_ns < {FIRST + 9 * DAY}"""
)
def cut_media(spark: SparkSession, sf: str) -> DataFrame:
    rows = media(spark, sf)
    ref = F.when(F.col("media_ref").isNotNull(), F.col("media_ref").withField("utc_ns", F.col("utc_ns")))
    out = logs.cut(rows, FIRST, FIRST + 9 * DAY, ref, {"v1.mkv": "cut1.mkv"})
    return out.select("seq", F.col("media.uri").alias("uri"), F.col("media.pts_ns").alias("pts"))


@query(f"{W}, {activity('i', chr(39) + 'view' + chr(39), 2 * DAY)} SELECT * FROM i WHERE end_ns - start_ns > {3 * DAY}")
def long_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.longer_than(intervals.activity(log(spark, sf), ["view"], 2 * DAY), 3 * DAY)


@query(f"{W} SELECT episode, min(ts_ns) AS start_ns, max(ts_ns) AS end_ns FROM ev GROUP BY episode HAVING min(ts_ns) < max(ts_ns)")
def all_time(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.all_time(log(spark, sf))


@query(
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey % 20 AS a, l_partkey % 20 + 5 AS b, l_suppkey % 20 AS c, l_suppkey % 20 + 3 AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, greatest(a, c) < least(b, d) AS overlaps, a = d OR b = c AS adjacent FROM p"""
)
def interval_relations(spark: SparkSession, sf: str) -> DataFrame:
    a, c = F.pmod("l_partkey", F.lit(20)), F.pmod("l_suppkey", F.lit(20))
    rows = read(spark, sf, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", intervals.overlaps(a, a + 5, c, c + 3).alias("overlaps"), intervals.adjacent(a, a + 5, c, c + 3).alias("adjacent"))


DIGITS = "'<' || array_to_string(string_split(printf('%03d', ts_ns // 10000000 % 1000), ''), '><') || '>'"
AXIS = "CASE WHEN {v} < 0 THEN '<SIGN_MINUS>' ELSE '<SIGN_PLUS>' END || '<' || array_to_string(string_split(printf('%04d', least(1999, abs({v}))), ''), '><') || '>'"
EVENTS = f"""te AS (
  SELECT episode, seq, CASE topic
    WHEN 'keyboard' THEN '<EVENT_START><KEYBOARD>' || {DIGITS} || '<VK_' || seq % 3 || '><' || CASE t WHEN 'view' THEN 'press' ELSE 'release' END || '><EVENT_END>'
    WHEN 'mouse/raw' THEN '<EVENT_START><MOUSE>' || {DIGITS} || {AXIS.format(v='(cents - 2500)')} || {AXIS.format(v='(seq % 90)')} || '<MB_0><MB_0><MB_' || CASE WHEN seq % 6 = 0 THEN 1 ELSE 0 END || '><EVENT_END>'
    WHEN 'screen' THEN '<EVENT_START><SCREEN>' || {DIGITS} || 'IMAGE' || '<EVENT_END>' END AS text FROM de)"""


@query(f"{W}, {DEVICES}, {EVENTS} SELECT seq, replace(text, 'IMAGE', '<fake_image_placeholder>') AS text FROM te")
def encode_by_topic(spark: SparkSession, sf: str) -> DataFrame:
    return devices(spark, sf).select("seq", codecs.encode_event(F.col("topic"), F.col("ts_ns"), F.col("payload")).alias("text"))


@query(
    f"""{W}, {DEVICES}, {EVENTS} SELECT seq, replace(text, 'IMAGE', '<img><IMG><IMG></img>') AS text,
  len(regexp_extract_all(replace(text, 'IMAGE', '<img><IMG><IMG></img>'), '<[^>]*>'))::INTEGER AS n, true AS valid FROM te WHERE text IS NOT NULL"""
)
def tokenize_events(spark: SparkSession, sf: str) -> DataFrame:
    vocab = tokens.extend_vocabulary({"<img>": 0, "<IMG>": 1, "</img>": 2}, codecs.vocabulary("compact"))
    out = stages.tokenized_stage(devices(spark, sf), vocab, image=tokens.image_pattern("<img>", "<IMG>", 2, "</img>"))
    return out.select("seq", "text", F.col("total_token_count").alias("n"), "valid")


@query(
    f"""{W}, {MOUSE}, {CODES}, vo AS (SELECT (row_number() OVER (ORDER BY token) - 1)::INTEGER AS id, token FROM (
  SELECT unnest(['<EVENT_START>', '<EVENT_END>', '<KEYBOARD>', '<MOUSE>', '<SCREEN>', '<press>', '<release>', '<SIGN_PLUS>', '<SIGN_MINUS>']) AS token
  UNION ALL SELECT '<VK_' || range || '>' FROM range(256) UNION ALL SELECT '<MB_' || printf('%x', range) || '>' FROM range(16) UNION ALL SELECT '<' || range || '>' FROM range(10))),
tk AS (SELECT unnest(regexp_extract_all(text, '<[^>]*>')) AS token FROM (SELECT kc AS text FROM cd UNION ALL SELECT mc FROM cd))
SELECT id, token, count(tk.token) AS n FROM vo LEFT JOIN tk USING (token) GROUP BY ALL"""
)
def vocabulary_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """How often each token of the vocabulary occurs in the encoded keyboard and mouse events."""
    rows = queries._codes(spark, sf, "compact").select(F.explode(F.array("keyboard", "mouse")).alias("text"))
    found = rows.select(F.explode(codecs.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return tokens.vocabulary_frame(spark, "compact").join(found, "token", "left").select("id", "token", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


@query("SELECT count(*) FILTER (WHERE length(coalesce(text, '')) > 300) AS skipped, sum(length(coalesce(text, ''))) FILTER (WHERE length(coalesce(text, '')) <= 300)::BIGINT AS tokens FROM conversations")
def packing_counters(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.packing_counters(read(spark, sf, "conversations").select(F.length(F.coalesce("text", F.lit(""))).alias("n")), 300, "n")


@query(f"{W} SELECT 'a' AS part, seq FROM ev WHERE topic = 'click' UNION ALL SELECT 'b', seq FROM ev WHERE topic = 'error'")
def concat_parts(spark: SparkSession, sf: str) -> DataFrame:
    ev = log(spark, sf)
    parts = [ev.where(topic(t)).select(F.lit(p).alias("part"), "seq") for p, t in (("a", "click"), ("b", "error"))]
    return tokens.concat_shuffled(parts, 7, order=("part", "seq")).orderBy("shuffle_key").select("part", "seq")


RESET = f"""p AS (SELECT episode, seq, ts_ns, cents % 50 AS x, seq % 40 AS y FROM ev),
d AS (SELECT *, x - lag(x) OVER o AS dx, y - lag(y) OVER o AS dy, (ts_ns - lag(ts_ns) OVER o) / 1e9 AS dt FROM p WINDOW o AS (PARTITION BY episode ORDER BY ts_ns, seq)),
e AS (SELECT *, sqrt(dx * dx + dy * dy) AS dist FROM d)"""


@query(
    f"""{W}, {RESET} SELECT coalesce(dt <= 3600.0, false) AS is_reset, count(*) AS n, round(avg(dist), 6) AS mean_distance, round(max(dist), 6) AS max_distance, round(avg(CASE WHEN dt > 0 THEN dist / dt END), 9) AS mean_speed
FROM e WHERE dist IS NOT NULL GROUP BY 1"""
)
def reset_summary(spark: SparkSession, sf: str) -> DataFrame:
    ev = log(spark, sf).withColumns({"x": F.pmod(F.col("cents"), F.lit(50)), "y": F.pmod("seq", F.lit(40))})
    flagged = stats.reset_flags(stats.motion(ev), quick_s=3600.0, tolerance=-1.0, speed=float("inf"))
    return stats.reset_summary(flagged).select("is_reset", "n", F.round("mean_distance", 6).alias("mean_distance"), F.round("max_distance", 6).alias("max_distance"), F.round("mean_speed", 9).alias("mean_speed"))


@query(
    """WITH c AS (SELECT p_brand, count(*) FILTER (WHERE p_size % 2 = 0) AS even, count(*) FILTER (WHERE p_size % 2 <> 0) AS odd, count(*) AS total FROM part GROUP BY p_brand)
SELECT p_brand, even, odd, total, round(100.0 * total / sum(total) OVER (), 6) AS percent FROM c ORDER BY total DESC, p_brand LIMIT 5"""
)
def catalog_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "part").select("p_brand", F.when(F.pmod("p_size", F.lit(2)) == 0, "even").otherwise("odd").alias("kind"))
    return catalog.type_stats(rows, "p_brand", "kind").withColumn("percent", F.round("percent", 6))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'Invalid' WHEN p_partkey % 3 = 0 THEN 'Warning' WHEN p_partkey % 7 = 0 THEN 'Partial' ELSE 'Valid' END AS status FROM part"""
)
def catalog_status(spark: SparkSession, sf: str) -> DataFrame:
    by = lambda n: F.pmod("p_partkey", F.lit(n)) == 0
    name = F.concat(F.when(by(5), "").otherwise("desktop/"), F.lit("Name"))
    rows = read(spark, sf, "part").select("p_partkey", name.alias("name"), F.when(by(7), "").otherwise("x int").alias("fields"), F.when(by(3), "desktop/Other").alias("declared"))
    return catalog.classify(rows).select("p_partkey", "status")


@query(f"{W}, {MEDIA} SELECT episode, arg_min(ts_ns - coalesce(pts, 0), (ts_ns, seq)) AS origin_ns FROM me GROUP BY episode")
def subtitle_origin(spark: SparkSession, sf: str) -> DataFrame:
    return timelines.origin(media(spark, sf), F.lit(True), F.col("media_ref.pts_ns"))


@query(
    f"""{W}, s AS (SELECT episode, seq, ts_ns, cents % 900 AS x, seq % 500 AS y FROM ev), n AS (SELECT *, lead(x) OVER o AS x2, lead(y) OVER o AS y2, lead(ts_ns) OVER o AS to_ns FROM s WINDOW o AS (PARTITION BY episode ORDER BY ts_ns, seq))
SELECT episode, ts_ns, to_ns, '\\move(' || x || ',' || y || ',' || x2 || ',' || y2 || ')' AS move FROM n WHERE x2 IS NOT NULL"""
)
def cursor_moves(spark: SparkSession, sf: str) -> DataFrame:
    return timelines.cursor_moves(log(spark, sf).withColumns({"x": F.pmod("cents", F.lit(900)), "y": F.pmod("seq", F.lit(500))}))


@query(
    f"""{W}, d AS (SELECT DISTINCT episode, seq % 50 * 1000000000 AS pts_ns, seq % 50 * 1000000000 + {FIRST} AS utc_ns FROM ev)
SELECT episode, pts_ns, utc_ns, coalesce(lead(pts_ns) OVER (PARTITION BY episode ORDER BY pts_ns), pts_ns + 1000000000) AS end_ns FROM d"""
)
def utc_cues(spark: SparkSession, sf: str) -> DataFrame:
    pts = F.pmod("seq", F.lit(50)) * 10**9
    return timelines.utc_cues(log(spark, sf).select("episode", pts.alias("pts_ns"), (pts + FIRST).alias("utc_ns")))


@query(f"{W} SELECT seq, {FIRST} + seq * 1000 - (seq % 7 * 3600 + 62) * 1000000000 - 5000000 AS utc_ns FROM ev")
def first_cue(spark: SparkSession, sf: str) -> DataFrame:
    body = F.format_string("1\n%02d:01:02,005 --> 09:00:00,000\n%d\n\n2\n", F.pmod("seq", F.lit(7)), F.lit(FIRST) + F.col("seq") * 1000)
    return log(spark, sf).select("seq", timelines.first_cue_utc(body).alias("utc_ns"))


@query(
    f"""{W}, c AS (SELECT episode, topic, min(ts_ns) AS s, max(ts_ns) AS e FROM ev GROUP BY episode, topic), f AS (SELECT episode, max(s) AS s, min(e) AS e FROM c GROUP BY episode),
g AS (SELECT episode, greatest(s, {FIRST + 5 * DAY - HOUR}) AS a, least(e, {FIRST + 20 * DAY + HOUR}) AS b FROM f)
SELECT episode, a AS cut_start_ns, b AS cut_end_ns, a < b AND a - {FIRST + 5 * DAY} <= {2 * DAY} AND {FIRST + 20 * DAY} - b <= {2 * DAY} AS ok FROM g"""
)
def trim_plan(spark: SparkSession, sf: str) -> DataFrame:
    coverage = log(spark, sf).groupBy("episode", "topic").agg(F.min("ts_ns").alias("start_ns"), F.max("ts_ns").alias("end_ns"))
    return timelines.trim_plan(coverage, FIRST + 5 * DAY, FIRST + 20 * DAY, HOUR, 2 * DAY)


@query(
    f"""{W}, s AS (SELECT *, CASE WHEN episode % 3 = 0 THEN 'a' ELSE 'v' || seq % 2 END AS uri, seq % 50 * 10000000 AS pts FROM ev WHERE topic = 'view')
SELECT episode, CASE WHEN count(DISTINCT uri) = 1 THEN arg_min(ts_ns - pts, (ts_ns, seq)) ELSE -1 END AS offset_ns, count(DISTINCT uri) AS n_videos FROM s GROUP BY episode"""
)
def video_offset(spark: SparkSession, sf: str) -> DataFrame:
    uri = F.when(F.pmod("episode", F.lit(3)) == 0, "a").otherwise(F.concat(F.lit("v"), F.pmod("seq", F.lit(2)).cast("string")))
    out = timelines.video_offset(log(spark, sf).where(topic("view")).withColumns({"uri": uri, "pts_ns": F.pmod("seq", F.lit(50)) * 10**7}))
    return out.withColumn("offset_ns", F.coalesce("offset_ns", F.lit(-1)))


def _ass(v: str) -> str:
    return f"printf('%d:%02d:%02d.%02d', {v} // 360000, {v} // 6000 % 60, {v} // 100 % 60, {v} % 100)"


@query(
    f"""{W}, c AS (SELECT episode, seq, (ts_ns - {FIRST}) // 10000000 AS a, (ts_ns - {FIRST}) // 10000000 + 150 AS b, ts_ns - {FIRST} AS start_ns, topic FROM ev)
SELECT episode, start_ns, 'Dialogue: 0,' || {_ass('a')} || ',' || {_ass('b')} || ',Default,,0,0,0,,' || topic || ' x' AS line FROM c"""
)
def ass_lines(spark: SparkSession, sf: str) -> DataFrame:
    at = F.col("ts_ns") - FIRST
    return timelines.ass_lines(log(spark, sf).select("episode", at.alias("start_ns"), (at + 1_500_000_000).alias("end_ns"), F.array(F.col("topic"), F.lit("x")).alias("labels")))


@query("SELECT p_partkey AS episode FROM part WHERE p_partkey % 4 = 0 OR p_partkey % 12 < 3")
def needs_migration(spark: SparkSession, sf: str) -> DataFrame:
    """Versions 0.0.n by the key's remainder, some unknown; 0.0.3 is wanted."""
    known = F.concat(F.lit("0.0."), F.pmod("p_partkey", F.lit(12)).cast("string"))
    meta = read(spark, sf, "part").select(F.col("p_partkey").alias("episode"), F.when(F.pmod("p_partkey", F.lit(4)) != 0, known).alias("version"))
    return evolve.needs(meta, "0.0.3", "0.0.1").select("episode")


@query(f"{W} SELECT seq, CASE WHEN seq % 2 = 0 THEN 'ref' ELSE 'path' END AS uri, CASE WHEN seq % 2 = 0 THEN seq ELSE seq + 1 END AS pts_ns FROM ev")
def screen_reference(spark: SparkSession, sf: str) -> DataFrame:
    even = F.pmod("seq", F.lit(2)) == 0
    ref = F.when(even, F.struct(F.lit("ref").alias("uri"), F.col("seq").alias("pts_ns")))
    old = F.struct(ref.alias("media_ref"), F.when(~even, "path").alias("path"), (F.col("seq") + 1).alias("pts"))
    out = evolve.screen_reference(F.col("old"))
    return log(spark, sf).select("seq", old.alias("old")).select("seq", out["uri"].alias("uri"), out["pts_ns"].alias("pts_ns"))


@query(f"{W} SELECT seq, CASE WHEN seq % 2 = 0 THEN 'data:image/png;base64,' || payload ELSE topic END AS uri FROM ev")
def unified_uri(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.pmod("seq", F.lit(2)) == 0, "embedded_ref").otherwise("file")
    return log(spark, sf).select("seq", evolve.unified_uri(kind, F.col("topic"), F.col("payload"), F.lit("png")).alias("uri"))


@query(
    f"""{W} SELECT seq, CASE WHEN seq % 2 = 0 THEN cents ELSE 0 END::BIGINT AS last_x, CASE WHEN seq % 2 = 0 THEN seq % 3 ELSE seq % 5 END::BIGINT AS button_flags, CASE WHEN seq % 2 = 0 THEN 0 ELSE seq % 3 END::BIGINT AS button_data FROM ev"""
)
def raw_mouse(spark: SparkSession, sf: str) -> DataFrame:
    old = F.pmod("seq", F.lit(2)) == 0
    none = F.lit(None).cast("bigint")
    fields = F.struct(none.alias("last_x"), none.alias("last_y"), F.when(old, F.col("cents")).alias("dx"), F.when(old, F.col("seq")).alias("dy"), none.alias("us_flags"), F.when(~old, F.pmod("seq", F.lit(5))).alias("button_flags"), F.pmod("seq", F.lit(3)).alias("button_data"))
    out = evolve.raw_mouse(F.col("f"))
    return log(spark, sf).select("seq", fields.alias("f")).select("seq", *[out[c].cast("bigint").alias(c) for c in ("last_x", "button_flags", "button_data")])


@query(f"{W} SELECT seq, CASE seq % 3 WHEN 0 THEN lower(hex(topic)) WHEN 1 THEN lower(hex(topic)) ELSE 'default' END AS curve FROM ev")
def curve_hex(spark: SparkSession, sf: str) -> DataFrame:
    third = F.pmod("seq", F.lit(3))
    text = F.when(third == 0, F.base64(F.col("topic").cast("binary"))).when(third == 1, F.lower(F.hex("topic"))).otherwise("?!")
    return log(spark, sf).select("seq", evolve.curve_hex(text, "default").alias("curve"))


@query(
    f"""WITH {EV}, t AS (SELECT DISTINCT episode, ts_ns // {DAY} AS day, topic FROM ev), d AS (SELECT DISTINCT episode, day FROM t), n AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY day) - 1 AS tick FROM d),
x AS (SELECT t.episode, n.tick, CASE topic WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'error' THEN 3 END AS vk FROM t JOIN n USING (episode, day)), k AS (SELECT * FROM x WHERE vk IS NOT NULL), m AS (SELECT episode, max(tick) AS top FROM n GROUP BY episode)
SELECT episode, tick AS seq, tick * 50000000 AS ts_ns, '{{"event_type":"press","vk":' || vk || '}}' AS payload FROM k WHERE NOT EXISTS (SELECT 1 FROM k y WHERE y.episode = k.episode AND y.tick = k.tick - 1 AND y.vk = k.vk)
UNION ALL SELECT k.episode, tick + 1, (tick + 1) * 50000000, '{{"event_type":"release","vk":' || vk || '}}' FROM k JOIN m USING (episode) WHERE tick < top AND NOT EXISTS (SELECT 1 FROM k y WHERE y.episode = k.episode AND y.tick = k.tick + 1 AND y.vk = k.vk)"""
)
def tick_events(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    days = log(spark, sf).withColumn("day", F.floor(F.col("ts_ns") / DAY).cast("long")).groupBy("episode", "day").agg(F.collect_set("topic").alias("held"))
    ticks = days.withColumn("seq", F.row_number().over(Window.partitionBy("episode").orderBy("day")).cast("long") - 1)
    return ticks_to_events(ticks, "held", {"click": 1, "view": 2, "error": 3}).select("episode", "seq", "ts_ns", "payload")


@query(
    """WITH w AS (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) = 4)
SELECT l_orderkey AS episode, l_linenumber AS seq FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM w) AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '5-LOW')"""
)
def eligible_ticks(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of four lines as recordings of four ticks; those of some priorities have media."""
    ticks = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("episode"), F.col("l_linenumber").alias("seq"))
    stems = read(spark, sf, "orders").where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("stem"))
    return eligible(ticks, stems, 4)


@query(
    f"""{W}, {activity('i', ', '.join(f"'{t}'" for t in TOPICS), DAY)}, b AS (SELECT episode, ts_ns // {DAY} AS d, string_agg('<' || seq || '>', '' ORDER BY ts_ns, seq) AS actions, count(*) AS n FROM ev WHERE topic = 'click' GROUP BY 1, 2)
SELECT 'do it' AS instruction, d AS state, actions FROM b"""
)
def binned_samples(spark: SparkSession, sf: str) -> DataFrame:
    day = F.floor(F.col("ts_ns") / DAY).cast("long")
    rows = log(spark, sf).where(topic("click")).groupBy("episode", day.alias("state")).agg(F.sort_array(F.collect_list(F.struct("ts_ns", "seq"))).alias("a"))
    made = rows.select("episode", "state", F.transform("a", lambda x: F.concat(F.lit("<"), x["seq"].cast("string"), F.lit(">"))).alias("actions"))
    return bins.binned_samples(made, "do it")


@query(f"{W}, {DEVICES}, {EVENTS} SELECT replace(text, 'IMAGE', '<fake_image_placeholder>') AS encoded_event, CASE WHEN text LIKE '%<SCREEN>%' THEN 1 ELSE 0 END::INTEGER AS n_images FROM te")
def event_samples(spark: SparkSession, sf: str) -> DataFrame:
    """The training view of event rows, their number in the episode's name."""
    body = F.to_json(F.struct("payload"))
    rows = devices(spark, sf).select(F.col("seq").cast("string").alias("episode_path"), "topic", F.col("ts_ns").alias("timestamp_ns"), "message_type", body.cast("binary").alias("mcap_message"))
    out = stages.transform(rows.withColumn("_n", F.monotonically_increasing_id()))
    return out.select("encoded_event", F.size("images").alias("n_images"))
