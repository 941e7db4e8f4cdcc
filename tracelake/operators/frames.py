"""Video frames as rows: media times, constant rates, a frame index, cuts on key frames, media of packed samples.

Frames are rows (episode, seq, ts_ns, ...); pixels are never touched. Times of a
stream are whole numbers of its time base, 1 / ``rate`` seconds.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.formats import SECOND
from tracelake.operators.ordered import FramePts, ordered_scan

ORDER = ["ts_ns", "seq"]
#: Ticks a second of a stream of variable rate, and the shortest time between two frames: fixed values of the format.
VARIABLE_RATE, DUPLICATE = 60_000, 1 / 120
#: Margins that a cut tries, in seconds: fixed values of the tool.
MARGINS_S = (0.5, 1.0, 2.0, 3.0, 5.0, 8.0, 10.0, 15.0, 20.0)


def written_pts(frames: DataFrame, pts: str, *, fps: float | None = None, rate: int | None = None, keys: tuple[str, ...] = ("episode",)) -> DataFrame:
    """``frames`` that a writer keeps, with ``out_pts``: ``pts`` in ticks, or one frame after the last kept one where it is null.

    A frame less than DUPLICATE after the last kept one is skipped and does not count
    as one. Without ``rate`` the time base is a frame of ``fps``, or of VARIABLE_RATE if
    there is none; null ``pts`` need ``fps``. Fractions of a tick are cut off.
    """
    if fps is not None and fps <= 0:
        raise ValueError("fps must be positive")
    ticks = rate or (int(fps) if fps else VARIABLE_RATE)
    step = ticks // int(fps) if fps else None
    label = "struct<keep:boolean,pts:bigint>"
    rows = ordered_scan(frames, list(keys), ORDER, [pts], partial(FramePts, int(ticks * DUPLICATE), step), "_p", label)
    return rows.where("_p.keep").withColumn("out_pts", F.col("_p.pts")).drop("_p")


def ticks_of(seconds: Column, rate: int) -> Column:
    """Seconds as whole ticks, fractions cut off."""
    return (seconds * rate).cast("bigint")


def constant_rate(frames: DataFrame, fps: int, *, keys: tuple[str, ...] = ("episode",)) -> DataFrame:
    """A frame for each 1 / fps seconds since the first: the latest one at that time. Adds slot, slot_ns and repeated.

    A frame's slots follow from its own time and the next frame's, so slow stretches
    repeat frames, fast ones drop them, and a gap makes its slots without a scan of
    it. Of frames with one time the last counts; the last frame has one slot, if any
    begins at or after it.
    """
    order = Window.partitionBy(*keys).orderBy(*ORDER)
    first = F.min("ts_ns").over(Window.partitionBy(*keys))
    # The first slot at or after a time: the ceiling of (t - first) * fps / SECOND.
    slot = lambda t: F.expr(f"(({t} - _first) * {fps} + {SECOND - 1}) div {SECOND}")
    rows = frames.withColumns({"_first": first, "_next": F.lead("ts_ns").over(order)})
    rows = rows.withColumns({"_from": slot("ts_ns"), "_to": F.coalesce(slot("_next"), slot("ts_ns") + 1)}).where("_from < _to")
    out = rows.withColumn("slot", F.explode(F.sequence("_from", F.col("_to") - 1)))
    at = F.col("_first") + F.expr(f"slot * {SECOND} div {fps}")
    return out.withColumns({"slot_ns": at, "repeated": F.col("slot") > F.col("_from")}).drop("_first", "_next", "_from", "_to")


def frame_index(frames: DataFrame, is_key: Column, path: str, *, parts: int | None = None) -> None:
    """Write the index of a table of frames (episode, uri, pts_ns, key_pts_ns, is_key), sorted so that file footers tell where a range lies.

    ``key_pts_ns`` is the key frame from which a decoder reaches the frame.
    """
    order = Window.partitionBy("episode", "uri").orderBy("pts_ns").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = frames.withColumn("is_key", F.coalesce(is_key, F.lit(False)))
    rows = rows.withColumn("key_pts_ns", F.max(F.when(F.col("is_key"), F.col("pts_ns"))).over(order))
    keys = ["episode", "uri", "pts_ns"]
    ranged = rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)
    ranged.select(*keys, "key_pts_ns", "is_key").sortWithinPartitions(*keys).write.parquet(path)


def frames_between(index: DataFrame, start_s: float, end_s: float | None = None, *, uri: str | None = None) -> DataFrame:
    """Frames from ``start_s`` to ``end_s`` seconds, both included; a negative end counts from the last frame's time, none is all of it.

    Ends that are not relative are pushed down to the scan of the index.
    """
    rows = index if uri is None else index.where(F.col("uri") == uri)
    kept = rows.where(F.col("pts_ns") >= int(start_s * SECOND))
    if end_s is None:
        return kept
    if end_s >= 0:
        return kept.where(F.col("pts_ns") <= int(end_s * SECOND))
    last = rows.groupBy("episode", "uri").agg((F.max("pts_ns") + int(end_s * SECOND)).alias("_last"))
    return kept.join(last, ["episode", "uri"]).where("pts_ns <= _last").drop("_last")


def cut_plan(keys: DataFrame, ends: DataFrame, targets: DataFrame, *, margins_ns: list[int] | None = None, max_margin_ns: int = 5 * SECOND) -> DataFrame:
    """(episode, step, margin_ns, cut_start_ns, cut_end_ns, status, offending) of a cut that begins at key frames.

    keys: (episode, uri, ts_ns) of key frames; ends: (episode, uri, end_ns); targets:
    (episode, start_ns, end_ns). With a margin a video is cut from its first key frame
    at or after start - margin to end + margin, or its end. The first margin of the
    ladder with which every video covers the target is taken, and what all cuts have in
    common. status: ok; too wide, where that is more than ``max_margin_ns`` beyond the
    target on a side; not covered, with the videos that no margin helps in ``offending``.
    All steps are found in one pass.
    """
    ladder = margins_ns or [int(m * SECOND) for m in MARGINS_S]
    keyed = keys.join(targets.select("episode", F.col("start_ns").alias("_s")), "episode")
    at = [F.min(F.when(F.col("ts_ns") >= F.col("_s") - m, F.col("ts_ns"))).alias(f"_k{i}") for i, m in enumerate(ladder)]
    videos = ends.select("episode", "uri", F.col("end_ns").alias("_video_end"))
    found = videos.join(keyed.groupBy("episode", "uri").agg(*at), ["episode", "uri"], "left").join(targets, "episode")
    stop = lambda m: F.least("_video_end", F.col("end_ns") + m)
    good = lambda i, m: F.coalesce((F.col(f"_k{i}") <= F.col("start_ns")) & (stop(m) >= F.col("end_ns")), F.lit(False))
    last = len(ladder) - 1
    steps = [F.struct(F.bool_and(good(i, m)).alias("ok"), F.lit(i).alias("step"), F.lit(m).cast("bigint").alias("margin_ns"), F.max(f"_k{i}").alias("start"), F.min(stop(m)).alias("stop")) for i, m in enumerate(ladder)]
    bad = F.sort_array(F.collect_set(F.when(~good(last, ladder[last]), F.col("uri"))))
    plan = found.groupBy("episode").agg(F.first("start_ns").alias("_s"), F.first("end_ns").alias("_e"), F.array(*steps).alias("_steps"), bad.alias("offending"))
    plan = plan.withColumn("_p", F.get(F.filter("_steps", lambda s: s["ok"]), F.lit(0)))
    extra = F.greatest(F.col("_s") - F.col("_p.start"), F.col("_p.stop") - F.col("_e"))
    status = F.when(F.col("_p").isNull(), "not covered").when(extra > max_margin_ns, "too wide").otherwise("ok")
    return plan.select("episode", "_p.step", "_p.margin_ns", F.col("_p.start").alias("cut_start_ns"), F.col("_p.stop").alias("cut_end_ns"), status.alias("status"), "offending")


def read_samples(samples: DataFrame, media: DataFrame, blank: Column, *, key: tuple[str, ...] = ("episode", "seq_no"), load: bool = True) -> DataFrame:
    """Packed samples as training reads them: with ``n_tokens``, ``n_images``, ``n_fallback``, ``media_bytes`` and ``media``.

    samples have attention_mask and images (references in order); media: (uri, value
    binary), one row for each that can be loaded. A reference that can't be loaded shows
    the one before it in the sample that could, the leading ones ``blank``; ``media`` holds
    (uri, value, how: own, previous or blank). Lengths come from the mask, so a padding id
    that is also a token's does not matter. Without ``load`` only the references are listed.
    """
    kept = samples.withColumn("n_tokens", F.aggregate("attention_mask", F.lit(0), lambda n, m: n + m)).withColumn("n_images", F.size(F.coalesce("images", F.array().cast("array<string>"))))
    if not load:
        return kept.withColumn("media", F.transform(F.coalesce("images", F.array().cast("array<string>")), lambda u: F.struct(u.alias("uri"))))
    refs = samples.select(*key, F.posexplode("images").alias("_place", "uri"))
    found = refs.join(media.select("uri", F.col("value").alias("_own")), "uri", "left")
    order = Window.partitionBy(*key).orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.last("_own", ignorenulls=True).over(order)
    how = F.when(F.col("_own").isNotNull(), "own").when(F.col("_before").isNotNull(), "previous").otherwise("blank")
    shown = found.withColumn("_before", before).select(*key, "_place", F.struct("uri", F.coalesce("_own", "_before", blank).alias("value"), how.alias("how")).alias("m"))
    each = shown.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_place", "m"))), lambda x: x["m"]).alias("media"), F.count(F.when(F.col("m.how") != "own", 1)).alias("n_fallback"), F.sum(F.octet_length("m.value")).alias("media_bytes"))
    none = F.array().cast(dict(each.dtypes)["media"])
    out = kept.join(each, list(key), "left")
    return out.withColumns({"media": F.coalesce("media", none), "n_fallback": F.coalesce("n_fallback", F.lit(0).cast("bigint")), "media_bytes": F.coalesce("media_bytes", F.lit(0).cast("bigint"))})
