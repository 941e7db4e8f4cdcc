"""Rate control: thinning, delta sums, key repeats, per topic and interval.

State begins anew in each group, so groups are (episode, topic) or (episode,
interval, topic).
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators.ordered import Grid, HoldRepeat, Thin, ordered_scan
from tracelake.schema import PAYLOADS

ORDER = ["ts_ns", "seq"]


def thin(df: DataFrame, every_ns: int, *, keys: tuple[str, ...] = ("episode", "topic"), init: int | None = 0) -> DataFrame:
    """Rows at least ``every_ns`` after the last kept one; a log that begins before ``init + every_ns`` loses its first rows."""
    return ordered_scan(df, list(keys), ORDER, ["ts_ns"], partial(Thin, every_ns, init), "_keep", "boolean").where("_keep").drop("_keep")


def grid_sample(df: DataFrame, every_ns: int, *, keys: tuple[str, ...] = ("episode",), first: int = 0) -> DataFrame:
    """Rows taken whenever a fixed grid is due; after a gap the grid catches up row by row."""
    return ordered_scan(df, list(keys), ORDER, ["ts_ns"], partial(Grid, every_ns, first), "_keep", "boolean").where("_keep").drop("_keep")


def sum_deltas(df: DataFrame, every_ns: int, deltas: list[str], is_move: Column, *, keys: tuple[str, ...] = ("episode",), init: int | None = 0) -> DataFrame:
    """Moves summed up and emitted at least ``every_ns`` apart; other rows pass and flush nothing; moves after the last emission are lost."""
    moves = ordered_scan(df.where(is_move), list(keys), ORDER, ["ts_ns"], partial(Thin, every_ns, init), "_emit", "boolean")
    order = Window.partitionBy(*keys).orderBy(*ORDER)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    grouped = moves.withColumn("_g", F.coalesce(F.sum(F.col("_emit").cast("int")).over(before), F.lit(0)))
    inside = Window.partitionBy(*keys, "_g")
    summed = grouped.withColumns({d: F.sum(d).over(inside).cast(dict(df.dtypes)[d]) for d in deltas}).where("_emit")
    return summed.drop("_emit", "_g").unionByName(df.where(~is_move))


def first_presses(df: DataFrame, key: str, pressed: Column, *, keys: tuple[str, ...] = ("episode",)) -> DataFrame:
    """Presses that do not follow a press of the same key, and all other rows."""
    order = Window.partitionBy(*keys, key).orderBy(*ORDER)
    return df.withColumn("_was", F.lag(pressed).over(order)).where(~pressed | F.col("_was").isNull() | ~F.col("_was")).drop("_was")


def key_repeat(df: DataFrame, every_ns: int, reset_ns: int = 1_000_000_000, *, key: str = "vk", pressed: str = "pressed", keys: tuple[str, ...] = ("episode",)) -> DataFrame:
    """Presses at a uniform rate while a key is held.

    The first press of a key stays, its repeats go, releases stay. At every row,
    of whatever topic, each held key gets presses every ``every_ns`` since its
    last one; after a gap of ``reset_ns`` it starts anew without any. ``pressed``
    is true, false, or null on rows of other topics. Made rows have ``made``
    true, the time and key of the press, and the row's other columns.
    """
    kind = dict(df.dtypes)[key]
    label = f"struct<keep:boolean,made:array<struct<key:{kind},t:bigint>>>"
    rows = ordered_scan(df, list(keys), ORDER, ["ts_ns", key, pressed], partial(HoldRepeat, every_ns, reset_ns), "_r", label)
    own = rows.where("_r.keep").withColumn("made", F.lit(False)).drop("_r")
    made = rows.select("*", F.explode("_r.made").alias("_m")).withColumns({"ts_ns": F.col("_m.t"), key: F.col("_m.key"), pressed: F.lit(True), "made": F.lit(True)})
    return own.unionByName(made.drop("_r", "_m"))


def periods(rates_hz: dict[str, float]) -> dict[str, int]:
    """Topic -> nanoseconds between rows; rate 0 is 0 (pass all)."""
    return {t: int(1e9 / r) if r else 0 for t, r in rates_hz.items()}


MOUSE, KEYBOARD = "mouse/raw", "keyboard"


def raw_moves(events: DataFrame, every_ns: int, *, keys: tuple[str, ...] = ("episode",), init: int | None = 0) -> DataFrame:
    """Raw mouse rows with their moves summed up (``sum_deltas``); rows with button flags pass."""
    fields = F.from_json("payload", PAYLOADS["desktop/RawMouseEvent"])
    part = lambda name: F.coalesce(fields[name], F.lit(0)).cast("bigint")
    rows = events.withColumns({"_x": part("last_x"), "_y": part("last_y"), "_flags": part("button_flags")})
    out = sum_deltas(rows, every_ns, ["_x", "_y"], F.col("_flags") == 0, keys=keys, init=init)
    summed = F.to_json(fields.withField("last_x", F.col("_x")).withField("last_y", F.col("_y")))
    return out.withColumn("payload", F.when(F.col("_flags") == 0, summed).otherwise(F.col("payload"))).drop("_x", "_y", "_flags")


def held_keys(events: DataFrame, every_ns: int, *, keys: tuple[str, ...] = ("episode",)) -> DataFrame:
    """Keyboard rows at a uniform rate (``key_repeat``); rows of all topics of ``events`` are the clock and go."""
    fields = F.from_json("payload", "vk int, event_type string")
    own = F.col("topic") == KEYBOARD
    rows = events.withColumns({"_vk": F.when(own, fields["vk"]), "_pressed": F.when(own, fields["event_type"] == "press")})
    out = key_repeat(rows, every_ns, key="_vk", pressed="_pressed", keys=keys).where(own | F.col("made"))
    press = F.to_json(F.struct(F.lit("press").alias("event_type"), F.col("_vk").alias("vk"), F.col("ts_ns").alias("timestamp")))
    made = {"topic": F.lit(KEYBOARD), "payload": press, "message_type": F.lit("desktop/KeyboardEvent")}
    return out.withColumns({c: F.when(F.col("made"), v).otherwise(F.col(c)) for c, v in made.items() if c in events.columns}).select(*events.columns)


def cursor_sample(events: DataFrame, every_ns: int, *, keys: tuple[str, ...] = ("episode",)) -> DataFrame:
    """The first row, and then rows at least ``every_ns`` after the last kept one."""
    return thin(events, every_ns, keys=keys, init=None)


def resample(events: DataFrame, rates_hz: dict[str, float], *, keys: tuple[str, ...] = ("episode",), init: int | None = 0) -> DataFrame:
    """Each topic at its rate: raw mouse moves are summed up, held keys repeat uniformly, other topics are thinned.

    Topics without a rate pass; thinned topics with one rate share a scan.
    """
    limited = {t: d for t, d in periods(rates_hz).items() if d}
    parts = [events.where(F.col("topic").isNull() | ~F.col("topic").isin(list(limited)))] if limited else [events]
    if MOUSE in limited:
        parts.append(raw_moves(events.where(F.col("topic") == MOUSE), limited.pop(MOUSE), keys=keys, init=init))
    if KEYBOARD in limited:
        parts.append(held_keys(events, limited.pop(KEYBOARD), keys=keys))
    for d in sorted(set(limited.values())):
        parts.append(thin(events.where(F.col("topic").isin([t for t, x in limited.items() if x == d])), d, keys=(*keys, "topic"), init=init))
    return reduce(DataFrame.unionByName, parts)
