"""Holds, clicks, subtitles, cursor paths, state differences."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.formats import SECOND, ass_time, div, srt_time
from tracelake.operators.ordered import Clamped, ordered_scan

LEAST_HOLD_NS = 500_000_000


def key_holds(events: DataFrame, key: str, pressed: Column, least_ns: int = LEAST_HOLD_NS) -> DataFrame:
    """(episode, key, start_ns, end_ns): first press to release, at least ``least_ns`` long; presses without release end at the press."""
    order = Window.partitionBy("episode", key).orderBy("ts_ns", "seq")
    releases_before = F.coalesce(F.sum((~F.col("_p")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = events.select("episode", "ts_ns", "seq", F.col(key), pressed.alias("_p")).withColumn("_hold", releases_before)
    found = rows.groupBy("episode", key, "_hold").agg(F.min(F.when(F.col("_p"), F.col("ts_ns"))).alias("start_ns"), F.max(F.when(~F.col("_p"), F.col("ts_ns"))).alias("_end"))
    end = F.greatest(F.coalesce("_end", "start_ns"), F.col("start_ns") + least_ns)
    return found.where("start_ns is not null").select("episode", key, "start_ns", end.alias("end_ns"))


def click_pairs(events: DataFrame, button: str, pressed: Column, least_ns: int = LEAST_HOLD_NS) -> DataFrame:
    """(episode, button, start_ns, end_ns): each release with the press just before it; of several presses the last one."""
    order = Window.partitionBy("episode", button).orderBy("ts_ns", "_p")
    rows = events.select("episode", "ts_ns", F.col(button), pressed.alias("_p")).withColumns({"_was": F.lag("_p").over(order), "start_ns": F.lag("ts_ns").over(order)})
    return rows.where("not _p and _was").select("episode", button, "start_ns", F.greatest("ts_ns", F.col("start_ns") + least_ns).alias("end_ns"))


def origin(events: DataFrame, is_screen: Column, pts_ns: Column) -> DataFrame:
    """(episode, origin_ns): time of the first screen row less its media time."""
    rows = events.where(is_screen).withColumn("_o", F.col("ts_ns") - F.coalesce(pts_ns, F.lit(0)))
    return rows.groupBy("episode").agg(F.min_by("_o", F.struct("ts_ns", "seq")).alias("origin_ns"))


def srt_cues(spans: DataFrame, text: Column) -> DataFrame:
    """(episode, cue, body): numbered subtitle cues by start; spans: episode, start_ns, end_ns relative to the origin."""
    order = Window.partitionBy("episode").orderBy("start_ns", "end_ns", "_t")
    rows = spans.withColumn("_t", text).withColumn("cue", F.row_number().over(order))
    body = F.concat(F.col("cue").cast("string"), F.lit("\n"), srt_time(F.col("start_ns")), F.lit(" --> "), srt_time(F.col("end_ns")), F.lit("\n"), F.col("_t"))
    return rows.select("episode", "cue", body.alias("body"))


def active_labels(spans: DataFrame, label: str) -> DataFrame:
    """(episode, start_ns, end_ns, labels): the set of labels active between neighbouring borders, as a depth per label."""
    border = F.explode(F.array(F.struct(F.col("start_ns").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end_ns").alias("t"), F.lit(-1).alias("d"))))
    steps = spans.select("episode", F.col(label), border.alias("b")).groupBy("episode", F.col("b.t").alias("t"), label).agg(F.sum("b.d").alias("d"))
    depth = Window.partitionBy("episode", label).orderBy("t")
    runs = steps.withColumns({"n": F.sum("d").over(depth), "_to": F.lead("t").over(depth)}).where("n > 0")
    by_time = Window.partitionBy("episode").orderBy("t")
    cells = steps.select("episode", "t").distinct().withColumns({"cell": F.row_number().over(by_time), "_next": F.lead("t").over(by_time)})
    # A run covers the cells from its own border to the one before its end, so that only what comes out is made.
    at = lambda name: cells.select("episode", F.col("t").alias(name), F.col("cell").alias(f"{name}_cell"))
    runs = runs.select("episode", F.col("t").alias("_from"), "_to", F.col(label).alias("_label"))
    placed = runs.join(at("_from"), ["episode", "_from"]).join(at("_to"), ["episode", "_to"])
    covered = placed.select("episode", "_label", F.explode(F.sequence(F.col("_from_cell"), F.col("_to_cell") - 1)).alias("cell"))
    labels = covered.groupBy("episode", "cell").agg(F.sort_array(F.collect_set("_label")).alias("labels"))
    return labels.join(cells, ["episode", "cell"]).select("episode", F.col("t").alias("start_ns"), F.col("_next").alias("end_ns"), "labels")


def ass_lines(cells: DataFrame) -> DataFrame:
    line = F.concat(F.lit("Dialogue: 0,"), ass_time(F.col("start_ns")), F.lit(","), ass_time(F.col("end_ns")), F.lit(",Default,,0,0,0,,"), F.array_join("labels", " "))
    return cells.select("episode", "start_ns", line.alias("line"))


def cursor(events: DataFrame, axis_deltas: dict[str, tuple[str, str]], size: dict[str, int], *, keys: tuple[str, ...] = ("episode",)) -> DataFrame:
    """Positions from deltas, clamped to [0, size) after each, from the centre; absolute values replace. axis -> (delta column, absolute column)."""
    for axis, (delta, absolute) in axis_deltas.items():
        n = size[axis]
        events = ordered_scan(events, list(keys), ["ts_ns", "seq"], [delta, absolute], partial(Clamped, n // 2, 0, n - 1), axis, "bigint")
    return events


def cursor_moves(samples: DataFrame) -> DataFrame:
    """Segments between neighbouring samples (x, y), in milliseconds from the first."""
    order = Window.partitionBy("episode").orderBy("ts_ns", "seq")
    rows = samples.withColumns({"x2": F.lead("x").over(order), "y2": F.lead("y").over(order), "to_ns": F.lead("ts_ns").over(order)}).where("x2 is not null")
    return rows.select("episode", "ts_ns", "to_ns", F.format_string("\\move(%d,%d,%d,%d)", "x", "y", "x2", "y2").alias("move"))


def utc_cues(screens: DataFrame) -> DataFrame:
    """(episode, pts_ns, end_ns, utc_ns): distinct screen times, each up to the next or one second."""
    order = Window.partitionBy("episode").orderBy("pts_ns", "utc_ns")
    rows = screens.select("episode", "pts_ns", "utc_ns").distinct()
    return rows.withColumn("end_ns", F.coalesce(F.lead("pts_ns").over(order), F.col("pts_ns") + SECOND))


def first_cue_utc(srt: Column) -> Column:
    """UTC at media time 0 from a UTC subtitle's first cue: its text (ns) less its start."""
    part = lambda i: F.regexp_extract(srt, r"(\d+):(\d+):(\d+),(\d+) -->[^\n]*\n\s*(\d+)", i).try_cast("bigint")
    return part(5) - ((part(1) * 3600 + part(2) * 60 + part(3)) * 1000 + part(4)) * 1_000_000


def trim_plan(coverage: DataFrame, start_ns: int, end_ns: int, margin_ns: int = 0, max_margin_ns: int = 5 * SECOND) -> DataFrame:
    """(episode, cut_start_ns, cut_end_ns, ok): what all videos of an episode cover of the wanted range, within the margin."""
    found = coverage.groupBy("episode").agg(F.max("start_ns").alias("s"), F.min("end_ns").alias("e"))
    start, end = F.greatest(F.col("s"), F.lit(start_ns - margin_ns)), F.least(F.col("e"), F.lit(end_ns + margin_ns))
    ok = (start < end) & (start - start_ns <= max_margin_ns) & (end_ns - end <= max_margin_ns)
    return found.select("episode", start.alias("cut_start_ns"), end.alias("cut_end_ns"), ok.alias("ok"))


def video_offset(screens: DataFrame) -> DataFrame:
    """(episode, offset_ns, n_videos): log time less media time of the first screen row; null unless there is one video."""
    found = screens.groupBy("episode").agg(F.count_distinct("uri").alias("n_videos"), F.min_by(F.col("ts_ns") - F.col("pts_ns"), F.struct("ts_ns", "seq")).alias("_o"))
    return found.select("episode", F.when(F.col("n_videos") == 1, F.col("_o")).alias("offset_ns"), "n_videos")


def state_changes(ticks: DataFrame, members: str) -> DataFrame:
    """Presses and releases between the member sets of neighbouring ticks, releases first; the first tick is all presses."""
    order = Window.partitionBy("episode").orderBy("ts_ns", "seq")
    kind = dict(ticks.dtypes)[members]
    was = F.coalesce(F.lag(members).over(order), F.array().cast(kind))
    now = F.coalesce(F.col(members), F.array().cast(kind))
    rows = ticks.withColumns({"_was": was, "_now": now})
    part = lambda items, n, name: F.transform(F.array_sort(items), lambda x: F.struct(F.lit(n).alias("o"), F.lit(name).alias("change"), x.alias("member")))
    changes = F.concat(part(F.array_except("_was", "_now"), 0, "release"), part(F.array_except("_now", "_was"), 1, "press"))
    return rows.select("episode", "ts_ns", "seq", F.posexplode(changes).alias("place", "c")).select("episode", "ts_ns", "seq", "place", "c.change", "c.member")


def heartbeats(events: DataFrame) -> DataFrame:
    """Rows that are the first of a second of their episode."""
    order = Window.partitionBy("episode").orderBy("ts_ns", "seq")
    second = div(F.col("ts_ns"), SECOND)
    return events.withColumn("_s", second).withColumn("_was", F.lag("_s").over(order)).where("_was is null or _was <> _s").drop("_s", "_was")
