"""Registered queries: each applies one operator to the driver's tables.

``events`` is read as a log: episode is the user, seq the event, topic its type.
Thresholds are hours and days, as the table spans a month.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import codecs
from tracelake.functions.formats import bytes_text, duration_text, srt_time, utc_text
from tracelake.operators import bins, intervals, logs, resample, stats, timelines, tokens
from tracelake.plans import catalog, evolve
from tracelake.plans.extractors import active, spanned, toggled
from tracelake.plans.stages import EventConfig, event_stage
from tracelake.sources.importers import decode_actions
from tracelake.sources.logs import events_as_log

HOUR = 3_600_000_000_000
DAY = 24 * HOUR
TOPICS = ["click", "error", "purchase", "signup", "view"]
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a log, with cents (value) and text (the event's number) as payloads."""
    rows = events_as_log(read(spark, sf, "events"))
    return rows.withColumns({"cents": F.round(F.col("value") * 100).cast("long"), "text": F.col("seq").cast("string")}).drop("value")


def topic(*names: str) -> Column:
    return F.col("topic").isin(list(names))


@query
def active_bins(spark: SparkSession, sf: str) -> DataFrame:
    ev = log(spark, sf)
    inside = intervals.inside(ev, intervals.activity(ev, TOPICS, DAY)).drop("start_ns", "end_ns")
    out = bins.time_bins(inside, DAY, topic("view"), topic("click", "purchase"), payload="text")
    return out.withColumn("actions", F.array_join("actions", ","))


@query
def scan_topics_range(spark: SparkSession, sf: str) -> DataFrame:
    start = 1_704_412_800 * 10**9
    return logs.scan(log(spark, sf), topics=["click", "purchase"], start_ns=start, end_ns=start + 7 * DAY).select("episode", "seq", "ts_ns", "topic")


@query
def first_rows(spark: SparkSession, sf: str) -> DataFrame:
    return logs.ordered(logs.scan(log(spark, sf), exclude=["view"]), limit=100).select("episode", "seq", "ts_ns", utc_text(F.col("ts_ns")).alias("utc"))


@query
def log_summary(spark: SparkSession, sf: str) -> DataFrame:
    return logs.summary(log(spark, sf))


@query
def channel_counts(spark: SparkSession, sf: str) -> DataFrame:
    return logs.channels(log(spark, sf).withColumn("message_type", F.col("topic"))).select("episode", "topic", "messages", "consistent")


@query
def activity_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.activity(log(spark, sf), TOPICS, DAY)


def _two(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    ev = log(spark, sf)
    return intervals.activity(ev, ["view"], 48 * HOUR), intervals.activity(ev, ["click"], 72 * HOUR)


@query
def interval_intersect(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.intersect(*_two(spark, sf))


@query
def interval_union(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.union(*_two(spark, sf))


@query
def interval_subtract(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.subtract(*_two(spark, sf))


@query
def interval_totals(spark: SparkSession, sf: str) -> DataFrame:
    found = intervals.summary(intervals.activity(log(spark, sf), TOPICS, DAY))
    return found.select("episode", "n", "total_ns", duration_text(F.floor(F.col("total_ns") / 1e9).cast("long")).alias("duration"))


@query
def inactivity_filter(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.inactivity_filter(log(spark, sf), ["view"], ["click", "purchase"], 48 * HOUR, 72 * HOUR)


@query
def toggle_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.toggles(log(spark, sf), topic("signup"))


@query
def composed_extractor(spark: SparkSession, sf: str) -> DataFrame:
    plan = (active(["view"], 48 * HOUR) | toggled("signup")) - active(["error"], 12 * HOUR) & spanned(["purchase"])
    return plan(log(spark, sf))


@query
def events_in_intervals(spark: SparkSession, sf: str) -> DataFrame:
    ev = log(spark, sf)
    return intervals.inside(ev, intervals.activity(ev, TOPICS, 12 * HOUR)).select("episode", "seq", "start_ns", "end_ns")


@query
def thin_events(spark: SparkSession, sf: str) -> DataFrame:
    return resample.thin(log(spark, sf), 12 * HOUR).select("episode", "topic", "seq", "ts_ns")


@query
def grid_sample(spark: SparkSession, sf: str) -> DataFrame:
    return resample.grid_sample(log(spark, sf), DAY, first=1_704_067_200 * 10**9).select("episode", "seq", "ts_ns")


@query
def aggregate_deltas(spark: SparkSession, sf: str) -> DataFrame:
    return resample.sum_deltas(log(spark, sf), 12 * HOUR, ["cents"], topic("click")).select("episode", "seq", "topic", "cents")


@query
def dedupe_press(spark: SparkSession, sf: str) -> DataFrame:
    ev = log(spark, sf).withColumn("key", F.pmod("seq", F.lit(3)))
    return resample.first_presses(ev, "key", topic("view")).select("episode", "key", "seq", "topic")


@query
def resampled_stage(spark: SparkSession, sf: str) -> DataFrame:
    config = EventConfig({"view": 1e9 / (6 * HOUR), "click": 0.0}, ("view", "click", "error"), active(TOPICS, DAY))
    return event_stage(log(spark, sf), config).select("episode", "seq", "topic", "ts_ns")


@query
def time_bins(spark: SparkSession, sf: str) -> DataFrame:
    out = bins.time_bins(log(spark, sf), DAY, topic("view"), topic("click", "purchase"), payload="text")
    return out.withColumn("actions", F.array_join("actions", ","))


@query
def time_bins_filled(spark: SparkSession, sf: str) -> DataFrame:
    out = bins.time_bins(log(spark, sf), DAY, topic("view"), topic("click", "purchase"), payload="text", drop_empty=True)
    return out.withColumn("actions", F.array_join("actions", ","))


@query
def sanitize_locf(spark: SparkSession, sf: str) -> DataFrame:
    return logs.keep_while(log(spark, sf), topic("error"), F.col("cents") > 2000).select("episode", "seq", "topic")


@query
def mode_title(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "documents").select("source", F.lit(0).alias("ts_ns"), F.col("doc_id").alias("seq"))
    return logs.mode_title(rows, "source")


@query
def title_filter(spark: SparkSession, sf: str) -> DataFrame:
    part = read(spark, sf, "part")
    return part.select("p_partkey", logs.title_matches(F.col("p_name"), "A", False).alias("part_of"), logs.title_matches(F.col("p_brand"), "Brand#1", True).alias("exact"))


@query
def rename_field(spark: SparkSession, sf: str) -> DataFrame:
    return log(spark, sf).select("seq", evolve.rename_field(F.col("payload"), "k", "key").alias("payload"))


@query
def evolve_step(spark: SparkSession, sf: str) -> DataFrame:
    names = {"click": "mouse/click", "view": "screen/view"}
    return log(spark, sf).select("seq", evolve.rename_types(F.col("topic"), names).alias("topic"), evolve.rename_prefix(F.col("topic"), "p", "P.").alias("prefixed"))


def _mouse() -> dict[str, Column]:
    return {
        "dx": F.col("cents") - 2500,
        "dy": F.pmod("seq", F.lit(4500)) - 2250,
        "flags": F.pmod("seq", F.lit(4096)).cast("int"),
        "data": F.when(F.pmod("seq", F.lit(5)) == 0, F.pmod(F.lit(65536) + (F.pmod("seq", F.lit(17)) - 8) * 120, F.lit(65536))).otherwise(0).cast("int"),
    }


def _codes(spark: SparkSession, sf: str, form: str) -> DataFrame:
    rows = log(spark, sf).withColumns(_mouse())
    vk, kind = F.pmod("seq", F.lit(256)), F.when(F.pmod("seq", F.lit(2)) == 0, "press").otherwise("release")
    keyboard = codecs.encode_keyboard(F.col("ts_ns"), vk, kind, form)
    mouse = codecs.encode_mouse(F.col("ts_ns"), F.col("dx"), F.col("dy"), F.col("flags"), F.col("data"), form)
    return rows.select("seq", "ts_ns", "dx", "dy", "flags", "data", vk.alias("vk"), keyboard.alias("keyboard"), mouse.alias("mouse"), codecs.encode_screen(F.col("ts_ns"), form).alias("screen"))


@query
def encode_compact(spark: SparkSession, sf: str) -> DataFrame:
    return _codes(spark, sf, "compact").select("seq", "keyboard", "mouse", "screen")


@query
def encode_interleaved(spark: SparkSession, sf: str) -> DataFrame:
    return _codes(spark, sf, "interleaved").select("seq", "keyboard", "mouse", "screen")


def _decoded(spark: SparkSession, sf: str, form: str) -> DataFrame:
    rows = _codes(spark, sf, form).withColumns({"k": codecs.decode_event(F.col("keyboard"), form), "m": codecs.decode_event(F.col("mouse"), form)})
    out = [F.col("m.dx").alias("dx"), F.col("m.dy").alias("dy"), F.col("m.button_flags").alias("flags"), F.col("m.button_data").alias("data")]
    return rows.select("seq", F.col("k.vk").alias("vk"), F.col("k.event_type").alias("event_type"), F.col("k.ts_ns").alias("ts_ns"), *out)


@query
def decode_roundtrip_compact(spark: SparkSession, sf: str) -> DataFrame:
    return _decoded(spark, sf, "compact")


@query
def decode_roundtrip_interleaved(spark: SparkSession, sf: str) -> DataFrame:
    return _decoded(spark, sf, "interleaved")


@query
def encode_json(spark: SparkSession, sf: str) -> DataFrame:
    rows = log(spark, sf)
    body = F.struct("episode", "seq", "topic", "payload")
    text = codecs.encode_json(body, F.when(F.col("topic") == "view", "screen").otherwise(F.col("topic")))
    back = codecs.decode_json(text, "episode bigint, seq bigint, topic string, payload string")
    return rows.select("seq", back["episode"].alias("episode"), back["topic"].alias("topic"), back["payload"].alias("payload"))


@query
def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    vocab = tokens.extend_vocabulary({}, codecs.vocabulary("compact"))
    rows = _codes(spark, sf, "compact").select("seq", F.explode(F.array("keyboard", "mouse")).alias("text")).where("text is not null")
    coded = codecs.let(tokens.token_ids(F.col("text"), vocab), lambda ids: F.struct(F.array_join(ids, ",").alias("ids"), F.size(ids).alias("n"), (tokens.detokenize(ids, vocab) == F.col("text")).alias("same")))
    return rows.withColumn("c", coded).select("seq", "text", "c.ids", "c.n", "c.same")


@query
def unwrap_time(spark: SparkSession, sf: str) -> DataFrame:
    rows = log(spark, sf).select("episode", "seq", F.pmod(F.floor(F.col("ts_ns") / HOUR).cast("long"), F.lit(100)).alias("t"))
    return tokens.unwrap(rows, 100)


@query
def pack_sequences(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "conversations").select(F.col("conv_id").alias("episode"), F.col("turn").alias("ts_ns"), F.col("turn").alias("seq"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    packed = tokens.pack(rows, 1200, length="n")
    return packed.groupBy("episode", "seq_no").agg(F.count(F.lit(1)).alias("turns"), F.sum("n").cast("long").alias("chars"))


@query
def packed_tokens(spark: SparkSession, sf: str) -> DataFrame:
    rows = log(spark, sf).select("episode", "seq", "ts_ns", F.transform(F.sequence(F.lit(1), F.pmod("seq", F.lit(7)) + 1), lambda i: i.cast("int")).alias("token_ids"), F.col("text"))
    rows = rows.withColumn("total_token_count", F.size("token_ids"))
    out = tokens.pack_sequences(rows, 16, 0)
    return out.select("episode", "seq_no", F.array_join("input_ids", ",").alias("ids"), F.aggregate("attention_mask", F.lit(0).cast("int"), lambda a, x: a + x).alias("used"), "n_events")


@query
def skip_and_shift(spark: SparkSession, sf: str) -> DataFrame:
    rows = log(spark, sf).withColumn("seq_no", F.lit(0))
    kept = tokens.skip_actions(rows, topic("click"), 6 * HOUR)
    return tokens.shift_actions(kept, topic("click"), HOUR).select("episode", "seq", "ts_ns", "place")


@query
def collate_labels(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.pmod(F.col("doc_id") + i, F.lit(5)).cast("int"))
    samples = read(spark, sf, "documents").select("doc_id", ids.alias("input_ids"), F.array("lang").alias("images"))
    batches = tokens.collate(samples, 16, 10, [0, 3], order=("doc_id",))
    return batches.select("doc_id", F.array_join("labels", ",").alias("labels"), "max_images")


@query
def embed_mean(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.mean_embeddings(read(spark, sf, "embeddings"), "label", "embedding").select("label", "place", F.round("value", 5).alias("value"))


def _asof(spark: SparkSession, sf: str, forward: bool) -> DataFrame:
    ev = log(spark, sf)
    frames = ev.where(topic("view")).select("episode", "ts_ns", F.col("seq").alias("frame"))
    return tokens.asof(ev.where(topic("click")).select("episode", "ts_ns", "seq"), frames, forward=forward).select("seq", "frame")


@query
def asof_forward(spark: SparkSession, sf: str) -> DataFrame:
    return _asof(spark, sf, True)


@query
def asof_backward(spark: SparkSession, sf: str) -> DataFrame:
    return _asof(spark, sf, False)


def _keys(spark: SparkSession, sf: str) -> DataFrame:
    return log(spark, sf).where(topic("view", "click")).withColumn("key", F.pmod("seq", F.lit(3)))


@query
def holds(spark: SparkSession, sf: str) -> DataFrame:
    return timelines.key_holds(_keys(spark, sf), "key", topic("view"), HOUR)


@query
def click_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return timelines.click_pairs(_keys(spark, sf), "key", topic("view"), HOUR)


@query
def srt_cues(spark: SparkSession, sf: str) -> DataFrame:
    spans = timelines.click_pairs(_keys(spark, sf), "key", topic("view"), HOUR)
    first = 1_704_067_200 * 10**9
    spans = spans.withColumns({"start_ns": F.col("start_ns") - first, "end_ns": F.col("end_ns") - first})
    return timelines.srt_cues(spans, F.concat(F.lit("key "), F.col("key").cast("string")))


@query
def active_labels(spark: SparkSession, sf: str) -> DataFrame:
    out = timelines.active_labels(timelines.click_pairs(_keys(spark, sf), "key", topic("view"), 6 * HOUR), "key")
    return out.withColumn("labels", F.array_join("labels", ","))


@query
def state_diff(spark: SparkSession, sf: str) -> DataFrame:
    ev = log(spark, sf).withColumn("day", F.floor(F.col("ts_ns") / DAY).cast("long"))
    ticks = ev.groupBy("episode", "day").agg(F.collect_set("topic").alias("held")).select("episode", (F.col("day") * DAY).alias("ts_ns"), F.col("day").alias("seq"), "held")
    return timelines.state_changes(ticks, "held").select("episode", F.col("seq").alias("day"), "change", "member")


@query
def cursor_clamped(spark: SparkSession, sf: str) -> DataFrame:
    ev = log(spark, sf).withColumns({"dx": F.when(topic("click"), F.col("cents")).otherwise(-F.col("cents")), "ax": F.when(topic("signup"), F.col("cents"))})
    return timelines.cursor(ev, {"x": ("dx", "ax")}, {"x": 8000}).select("episode", "seq", "x")


@query
def heartbeats(spark: SparkSession, sf: str) -> DataFrame:
    ev = log(spark, sf).withColumn("ts_ns", F.floor(F.col("ts_ns") / (6 * HOUR)).cast("long") * 10**9)
    return timelines.heartbeats(ev).select("episode", "seq")


@query
def rolling_metric(spark: SparkSession, sf: str) -> DataFrame:
    return stats.rolling(log(spark, sf), "cents", 20).select("seq", F.round("rolling_mean", 6).alias("rolling_mean"), F.round(F.col("rolling_rate") * 1e6, 6).alias("rolling_rate"))


@query
def velocity(spark: SparkSession, sf: str) -> DataFrame:
    return stats.velocity(log(spark, sf), "cents", "seq", DAY).select("seq", "vx", "vy")


@query
def ema_metric(spark: SparkSession, sf: str) -> DataFrame:
    return stats.ema_by(log(spark, sf), "cents").select("episode", F.round("ema", 4).alias("ema"))


@query
def reset_flags(spark: SparkSession, sf: str) -> DataFrame:
    ev = log(spark, sf).withColumns({"x": F.pmod(F.col("cents"), F.lit(50)), "y": F.pmod("seq", F.lit(40))})
    flagged = stats.reset_flags(stats.motion(ev), quick_s=60.0, tolerance=10.0, least=3.0, speed=0.02)
    return flagged.select("seq", "is_reset")


@query
def screen_centre(spark: SparkSession, sf: str) -> DataFrame:
    return stats.screen_centre(log(spark, sf).withColumns({"x": F.pmod(F.col("cents"), F.lit(100)), "y": F.pmod("seq", F.lit(60))}))


@query
def gop_segments(spark: SparkSession, sf: str) -> DataFrame:
    frames = log(spark, sf).withColumn("kind", F.upper(F.substring("topic", 1, 1)))
    return stats.frame_groups(frames, topic("view"), "kind").select("episode", "gop", "n", "start_ns", "end_ns", "kinds")


@query
def key_gaps(spark: SparkSession, sf: str) -> DataFrame:
    out = stats.key_gaps(log(spark, sf), topic("view"), 30.0)
    return out.select("episode", "n", "min_gap", "max_gap", F.round(F.col("mean_gap") / 1e6, 3).alias("mean_gap"), F.round(F.col("median_gap") / 1e6, 3).alias("median_gap"), "consistent")


@query
def interval_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = stats.spread(log(spark, sf), F.col("cents"), "topic")
    return out.select("topic", F.round("mean", 4).alias("mean"), "median", "q1", "q3", "max", "min")


@query
def latency_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = stats.latency_summary(log(spark, sf), "cents", F.lit(30.0))
    return out.select(*[F.round(c, 4).alias(c) for c in out.columns])


@query
def frame_shares(spark: SparkSession, sf: str) -> DataFrame:
    return stats.shares(log(spark, sf), "topic").select("topic", "n", F.round("percent", 6).alias("percent"))


@query
def quality_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return log(spark, sf).groupBy("topic").agg(stats.ratio_verdict(F.col("cents") > 1000, 0.6, 0.5).alias("verdict"))


@query
def vfr_flag(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.floor("l_quantity").cast("long").cast("string").alias("q"), F.pmod("l_partkey", F.lit(4)).cast("string").alias("d"))
    avg, nominal = F.concat("q", F.lit("/"), "d"), F.concat("q", F.lit("/2"))
    return rows.select("l_orderkey", "l_linenumber", stats.variable_rate(avg, nominal).alias("vfr"))


@query
def verify_counts(spark: SparkSession, sf: str) -> DataFrame:
    return logs.verify(log(spark, sf), ["view", "click"], least_ns=20 * DAY, least_messages=30)


@query
def compare_logs(spark: SparkSession, sf: str) -> DataFrame:
    ev = log(spark, sf)
    after = ev.where(~((F.col("episode") % 5 == 0) & topic("error"))).withColumn("topic", F.when((F.col("episode") % 7 == 0) & topic("view"), "seen").otherwise(F.col("topic")))
    return logs.compare(ev, after)


@query
def button_events(spark: SparkSession, sf: str) -> DataFrame:
    rows = log(spark, sf).select("seq", F.explode(logs.button_events(F.pmod("seq", F.lit(64)).cast("int"))).alias("b"))
    return rows.select("seq", "b.button", "b.pressed")


@query
def key_labels(spark: SparkSession, sf: str) -> DataFrame:
    names = read(spark, sf, "nation").select(F.col("n_nationkey").alias("code"), F.concat(F.lit("KEY_"), "n_name").alias("name"))
    return logs.key_labels(log(spark, sf).select("seq", F.pmod("seq", F.lit(30)).alias("vk")), names).select("seq", "label")


@query
def catalog_search(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.search(read(spark, sf, "part").select("p_partkey", F.col("p_type").alias("name")).distinct(), "s.*m").select("p_partkey", "name")


@query
def media_paths(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "part").select("p_partkey", F.concat(F.lit("/data/"), F.lower(F.translate("p_brand", "#", "_")), F.when(F.pmod("p_partkey", F.lit(2)) == 0, "/log.mcap").otherwise("")).alias("base"))
    return rows.select("p_partkey", logs.media_path(F.lit("video.mkv"), F.col("base")).alias("path"), logs.episode_path(F.lit("a/b.mcap"), "/root").alias("episode"))


@query
def text_formats(spark: SparkSession, sf: str) -> DataFrame:
    size = F.floor(F.col("o_totalprice")).cast("long") * F.pmod("o_orderkey", F.lit(1000))
    return read(spark, sf, "orders").select("o_orderkey", bytes_text(size).alias("size"), srt_time(size * 1_000_000).alias("at"))


@query
def action_vectors(spark: SparkSession, sf: str) -> DataFrame:
    vector = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    found = decode_actions(vector, ["w", "a", "s", "d"], [-10.0, -1.0, 0.0, 1.0, 10.0], [-5.0, 0.0, 5.0], 0.05)
    rows = read(spark, sf, "embeddings").select("vec_id", found.alias("a"))
    return rows.select("vec_id", F.array_join("a.keys", "").alias("keys"), "a.left", "a.right", "a.dx", "a.dy")
