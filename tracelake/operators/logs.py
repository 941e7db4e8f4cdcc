"""Log maintenance: filtered scans, summaries, state filters, cuts, media references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.formats import SECOND

ORDER = ("ts_ns", "seq")


def scan(events: DataFrame, *, topics: list[str] | None = None, exclude: list[str] | None = None, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """Rows of the topics with start <= time < end; every condition reaches the scan."""
    if topics is not None:
        events = events.where(F.col("topic").isin(topics))
    if exclude:
        events = events.where(~F.col("topic").isin(exclude))
    if start_ns is not None:
        events = events.where(F.col("ts_ns") >= start_ns)
    return events if end_ns is None else events.where(F.col("ts_ns") < end_ns)


def seconds_range(start_s: float | None, end_s: float | None) -> dict[str, int | None]:
    return {"start_ns": None if start_s is None else int(start_s * SECOND), "end_ns": None if end_s is None else int(end_s * SECOND)}


def ordered(events: DataFrame, *, reverse: bool = False, limit: int | None = None) -> DataFrame:
    """Rows in time order, the first ``limit`` of them if given."""
    keys = [F.col(c).desc() if reverse else F.col(c).asc() for c in ("ts_ns", "episode", "seq")]
    out = events.orderBy(*keys)
    return out if limit is None else out.limit(limit)


def summary(events: DataFrame) -> DataFrame:
    """One row per episode, and one with a null episode for all: messages, topics, start, end, duration."""
    rolled = events.rollup("episode").agg(
        F.count(F.lit(1)).alias("messages"),
        F.count_distinct("topic").alias("topics"),
        F.min("ts_ns").alias("start_ns"),
        F.max("ts_ns").alias("end_ns"),
        F.grouping("episode").cast("int").alias("is_total"),
    )
    return rolled.withColumn("duration_ns", F.col("end_ns") - F.col("start_ns"))


def channels(events: DataFrame) -> DataFrame:
    """(episode, topic, messages, message types); a topic must have one type in an episode."""
    found = events.groupBy("episode", "topic").agg(F.count(F.lit(1)).alias("messages"), F.count_distinct("message_type").alias("n_types"))
    return found.withColumn("consistent", F.col("n_types") <= 1)


def title_matches(title: Column, wanted: str, exact: bool) -> Column:
    """Exact titles by case, parts of titles whatever the case."""
    return title == wanted if exact else F.lower(title).contains(wanted.lower())


def _marked(events: DataFrame, is_state: Column, matches: Column) -> DataFrame:
    """``events`` with ``_m``: whether the latest state row of their episode matches."""
    order = Window.partitionBy("episode").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(is_state, F.coalesce(matches, F.lit(False))), ignorenulls=True).over(order)
    return events.withColumn("_m", F.coalesce(last, F.lit(False)))


def keep_while(events: DataFrame, is_state: Column, matches: Column) -> DataFrame:
    """Rows while the latest state row of their episode matches; state rows themselves if they match; nothing before the first."""
    return _marked(events, is_state, matches).where("_m").drop("_m")


def checked_sanitize(events: DataFrame, is_state: Column, matches: Column, max_removed: float = 1.0) -> DataFrame:
    """``keep_while``; ValueError where a larger share than ``max_removed`` of all rows would go."""
    marked = _marked(events, is_state, matches)
    ratio = marked.agg(F.coalesce(F.avg((~F.col("_m")).cast("double")), F.lit(0.0))).first()[0]
    if ratio > max_removed:
        raise ValueError(f"{ratio:.1%} of the rows would be removed; the limit is {max_removed:.1%}")
    return marked.where("_m").drop("_m")


def mode_title(states: DataFrame, title: str = "title") -> DataFrame:
    """The most frequent non-blank title, of equal ones the first seen."""
    rows = states.where(F.trim(F.coalesce(F.col(title), F.lit(""))) != "")
    return rows.groupBy(title).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*ORDER)).alias("_at")).orderBy(F.desc("n"), "_at").limit(1).select(title, "n")


def cut(events: DataFrame, start_ns: int, end_ns: int, media: Column | None = None, uris: dict[str, str] | None = None) -> DataFrame:
    """Rows in [start, end) with absolute times. ``media`` (struct uri, pts_ns, utc_ns) gets new URIs and times from the start."""
    rows = scan(events, start_ns=start_ns, end_ns=end_ns)
    if media is None:
        return rows
    new = F.create_map(*[F.lit(x) for kv in (uris or {}).items() for x in kv]) if uris else F.create_map().cast("map<string,string>")
    at = F.coalesce(F.when(media["utc_ns"] != 0, media["utc_ns"]), F.col("ts_ns")) - start_ns
    return rows.withColumn("media", F.when(media.isNotNull(), F.struct(F.coalesce(new[media["uri"]], media["uri"]).alias("uri"), at.alias("pts_ns"))))


def rename_media(events: DataFrame, uri: str, media: str = "media_ref") -> DataFrame:
    """All media references of ``events`` point to ``uri``; their times stay."""
    return events.withColumn(media, F.when(F.col(media).isNotNull(), F.col(media).withField("uri", F.lit(uri))))


def rename_report(events: DataFrame, uri: str, media: str = "media_ref") -> DataFrame:
    """What ``rename_media`` would do: rows, media rows, changed rows, URIs before."""
    ref = F.col(media)["uri"]
    return events.agg(F.count(F.lit(1)).alias("total"), F.count(ref).alias("screens"), F.count(F.when(ref != uri, 1)).alias("modified"), F.sort_array(F.collect_set(ref)).alias("originals"))


def referenced_media(events: DataFrame, media: str = "media_ref") -> DataFrame:
    return events.select(F.col(media)["uri"].alias("uri")).where("uri is not null").distinct()


def episode_path(path: Column, root: str | None) -> Column:
    """Empty and absolute paths as they are; others under ``root``, an error without one."""
    fixed = (path == "") | path.startswith("/")
    other = F.concat(F.lit(f"{root.rstrip('/')}/"), path) if root else F.raise_error(F.lit("a relative path needs a root")).cast("string")
    return F.when(path.isNull() | fixed, path).otherwise(other)


def media_path(uri: Column, base: Column) -> Column:
    """A relative URI beside its log file, or in its folder."""
    folder = F.when(base.rlike(r"\.mcap$"), F.regexp_replace(base, "/?[^/]*$", "")).otherwise(F.regexp_replace(base, "/$", ""))
    plain = uri.rlike("^([a-z]+:|/)") | (folder == "")
    return F.when(plain, uri).otherwise(F.concat(folder, F.lit("/"), uri))


def key_labels(events: DataFrame, names: DataFrame, vk: str = "vk") -> DataFrame:
    """``events`` with ``label``: the key's name without ``KEY_``, or ``?`` and its code; names: (code, name), at most 256 rows."""
    label = F.coalesce(F.regexp_replace("_name", "^KEY_", ""), F.concat(F.lit("?"), F.col(vk).cast("string")))
    table = F.broadcast(names.where("code between 0 and 255").select(F.col("code").alias("_code"), F.col("name").alias("_name")))
    return events.join(table, F.col(vk) == F.col("_code"), "left").withColumn("label", label).drop("_code", "_name")


#: Raw mouse button flags (fixed values): button -> press bit, release bit; by priority.
BUTTONS = {"left": (0x1, 0x2), "right": (0x4, 0x8), "middle": (0x10, 0x20)}


def button_events(flags: Column) -> Column:
    """array<struct<button, pressed>>: at most one press and one release of raw mouse flags."""

    def first(bit: int) -> Column:
        out = F.lit(None).cast("string")
        for name, bits in reversed(BUTTONS.items()):
            out = F.when(flags.bitwiseAND(bits[bit]) != 0, name).otherwise(out)
        return F.struct(out.alias("button"), F.lit(bit == 0).alias("pressed"))

    return F.filter(F.array(first(0), first(1)), lambda x: x["button"].isNotNull())


def verify(events: DataFrame, counted_topics: list[str], *, least_ns: int = 60 * SECOND, least_messages: int = 1000) -> DataFrame:
    """(episode, duration_ns, messages, valid): long enough, and enough messages of the topics."""
    found = events.groupBy("episode").agg((F.max("ts_ns") - F.min("ts_ns")).alias("duration_ns"), F.count(F.when(F.col("topic").isin(counted_topics), 1)).alias("messages"))
    return found.withColumn("valid", (F.col("duration_ns") > least_ns) & (F.col("messages") > least_messages))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """(episode, reason) of a rewrite check, in order: message counts, topic sets; ``ok`` where both agree."""
    side = lambda df, x: df.groupBy("episode").agg(F.count(F.lit(1)).alias(f"n{x}"), F.sort_array(F.collect_set("topic")).alias(f"t{x}"))
    both = side(before, 0).join(side(after, 1), "episode", "full")
    reason = F.when(~F.col("n0").eqNullSafe(F.col("n1")), "message count").when(F.col("t0") != F.col("t1"), "topics").otherwise("ok")
    return both.select("episode", reason.alias("reason"))


def size_close(before: Column, after: Column, tolerance: float = 0.1) -> Column:
    return F.abs(after - before) <= tolerance * before
