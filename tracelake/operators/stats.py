"""Statistics over rows: rolling metrics, gaps, frame groups, motion, resets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000_000
ORDER = ("ts_ns", "seq")


def shares(df: DataFrame, by: str) -> DataFrame:
    """(by, n, percent)."""
    found = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("_t"))
    return found.crossJoin(F.broadcast(total)).select(by, "n", (100.0 * F.col("n") / F.col("_t")).alias("percent"))  # one row by aggregation


def ratio_verdict(good: Column, warn: float, fail: float) -> Column:
    """PASS, WARN or FAIL from the share of rows for which ``good`` holds."""
    share = F.avg(good.cast("double"))
    return F.when(share >= warn, "PASS").when(share >= fail, "WARN").otherwise("FAIL")


#: Ranges into which ``quantiles`` cuts the distinct values of a group.
RANGES = 64


def quantiles(df: DataFrame, value: str, shares: dict[str, float], *by: str) -> DataFrame:
    """(by, one column for each share): exact quantiles, interpolated between neighbours; a group's values never meet in one task.

    Values are counted; the distinct ones fall into ranges by approximate cuts, whose
    exact counts tell in which range a rank lies, and only those ranges are sorted.
    A group without values has no row.
    """
    keys = list(by) or ["_all"]
    rows = df.where(F.col(value).isNotNull()).withColumn("_all", F.lit(0)).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    cuts = rows.groupBy(*keys).agg(F.percentile_approx("_v", [k / RANGES for k in range(1, RANGES)], 10_000).alias("_cuts"))
    same = lambda a, b: [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    ranged = rows.alias("a").join(cuts.alias("b"), same("a", "b")).select("a.*", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_r"))
    sums = ranged.groupBy(*keys, "_r").agg(F.sum("_n").alias("_in"))
    order = Window.partitionBy(*keys).orderBy("_r")
    sums = sums.withColumns({"_before": F.sum("_in").over(order) - F.col("_in"), "_total": F.sum("_in").over(Window.partitionBy(*keys))})
    rank = lambda p: (F.col("_total") - 1) * p
    asked = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(rank(p)), F.ceil(rank(p))) for p in shares.values()])))
    sums = sums.withColumn("_asked", F.filter(asked, lambda x: (x >= F.col("_before")) & (x < F.col("_before") + F.col("_in")))).where(F.size("_asked") > 0)
    near = ranged.alias("a").join(sums.alias("b"), [*same("a", "b"), F.col("a._r") == F.col("b._r")]).select("a.*", "_before", "_total", "_asked")
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_r").orderBy("_v")) + F.col("_before")
    near = near.withColumn("_upto", upto).withColumn("_hit", F.filter("_asked", lambda x: (x >= F.col("_upto") - F.col("_n")) & (x < F.col("_upto")))).where(F.size("_hit") > 0)
    at = F.map_from_entries(F.collect_list(F.struct(F.col("_x").cast("bigint").alias("k"), F.col("_v").alias("v"))))  # two for each share at most
    found = near.select(*keys, "_total", "_v", F.explode("_hit").alias("_x")).groupBy(*keys, "_total").agg(at.alias("_at"))

    def between(p: float) -> Column:
        low, high = (F.col("_at")[f(rank(p)).cast("bigint")] for f in (F.floor, F.ceil))
        return low + (high - low) * (rank(p) - F.floor(rank(p)))

    return found.select(*by, *[between(p).alias(name) for name, p in shares.items()])


def _with(found: DataFrame, more: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``found`` with the columns of ``more`` for its groups; null groups are groups."""
    if not by:
        return found.crossJoin(more)  # a row each
    there = more.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], *[c for c in more.columns if c not in by])
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(by)]
    return found.join(there, on, "left").drop(*[f"_k{i}" for i in range(len(by))])


def key_gaps(frames: DataFrame, is_key: Column, fps: float) -> DataFrame:
    """Per episode, gaps between key frames: number, min, max, mean, median, consistent."""
    order = Window.partitionBy("episode").orderBy(*ORDER)
    gaps = frames.where(is_key).withColumn("gap", F.col("ts_ns") - F.lag("ts_ns").over(order)).where("gap is not null")
    found = gaps.groupBy("episode").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("gap").alias("min_gap"),
        F.max("gap").alias("max_gap"),
        F.avg("gap").alias("mean_gap"),
        (F.max("gap") - F.min("gap") < F.lit(0.1 * fps * SECOND)).alias("consistent"),
    )
    return _with(found, quantiles(gaps, "gap", {"median_gap": 0.5}, "episode"), ("episode",))


def frame_groups(frames: DataFrame, is_key: Column, kind: str, first: int | None = None, *, keep_last: bool = False) -> DataFrame:
    """(episode, gop, n, start_ns, end_ns, kinds): frames from each key frame to the next; the last, unfinished group is left out."""
    order = Window.partitionBy("episode").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = frames.withColumn("gop", F.sum(is_key.cast("int")).over(order) - 1).where("gop >= 0")
    if first is not None:
        rows = rows.where(F.col("gop") < first + 1)
    found = rows.groupBy("episode", "gop").agg(F.count(F.lit(1)).alias("n"), F.min("ts_ns").alias("start_ns"), F.max("ts_ns").alias("end_ns"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*ORDER, F.col(kind).alias("k")))), lambda x: x["k"]), "").alias("kinds"))
    if not keep_last:
        found = found.withColumn("_last", F.max("gop").over(Window.partitionBy("episode"))).where("gop < _last").drop("_last")
    return found if first is None else found.where(F.col("gop") < first)


def variable_rate(avg: Column, nominal: Column, tolerance: float = 0.01) -> Column:
    """Whether two frame rates, as ``a/b`` texts, differ or are zero."""

    def value(text: Column) -> Column:
        a, b = (F.get(F.split(text, "/"), F.lit(i)).try_cast("double") for i in (0, 1))
        return F.when(F.coalesce(b, F.lit(1.0)) == 0, 0.0).otherwise(F.coalesce(a / F.coalesce(b, F.lit(1.0)), F.lit(0.0)))

    x, y = value(avg), value(nominal)
    return (x == 0) | (y == 0) | (F.abs(x - y) > tolerance)


def spread(df: DataFrame, value: Column, *by: str) -> DataFrame:
    """mean, median, q1, q3, max, min; quantiles interpolate."""
    rows = df.select(*by, value.alias("v"))
    found = rows.groupBy(*by).agg(F.avg("v").alias("mean"), F.max("v").alias("max"), F.min("v").alias("min"))
    out = _with(found, quantiles(rows, "v", {"q1": 0.25, "median": 0.5, "q3": 0.75}, *by), by)
    return out.select(*by, "mean", "median", "q1", "q3", "max", "min")


def latency_summary(df: DataFrame, latency: str, duration_s: Column) -> DataFrame:
    """mean, population deviation, p95, p99 and throughput."""
    found = df.agg(F.avg(latency).alias("mean"), F.stddev_pop(latency).alias("std"), (F.count(F.lit(1)) / F.max(duration_s)).alias("throughput"))
    return _with(found, quantiles(df, latency, {"p95": 0.95, "p99": 0.99}), ()).select("mean", "std", "p95", "p99", "throughput")


def rolling(df: DataFrame, value: str, rows: int = 100) -> DataFrame:
    """``df`` with the mean of the last ``rows`` values and their rate per second; the rate is 0 for one row or no time."""
    frame = Window.partitionBy("episode").orderBy(*ORDER).rowsBetween(-(rows - 1), 0)
    span = F.col("ts_ns") - F.min("ts_ns").over(frame)
    rate = F.when(span > 0, (F.count(F.lit(1)).over(frame) - 1) * float(SECOND) / span).otherwise(0.0)
    return df.withColumns({"rolling_mean": F.avg(value).over(frame), "rolling_rate": rate})


def velocity(df: DataFrame, dx: str, dy: str, span_ns: int = SECOND) -> DataFrame:
    """``df`` with sums of deltas over (now - span, now]; null for fewer than two rows."""
    frame = Window.partitionBy("episode").orderBy("ts_ns").rangeBetween(-(span_ns - 1), 0)
    two = F.count(F.lit(1)).over(frame) >= 2
    return df.withColumns({"vx": F.when(two, F.sum(dx).over(frame)), "vy": F.when(two, F.sum(dy).over(frame))})


def ema(values: Column, keep: float = 0.9) -> Column:
    """Exponential mean of an array in order, seeded with its first value."""
    rest = F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))
    return F.when(F.size(values) > 0, F.aggregate(rest, F.get(values, F.lit(0)).cast("double"), lambda acc, x: acc * keep + x * (1 - keep)))


def ema_by(df: DataFrame, value: str, keep: float = 0.9, *, by: tuple[str, ...] = ("episode",), order: tuple[str, ...] = tuple(ORDER)) -> DataFrame:
    """(by, ema): the exponential mean of each group's last row, as a sum of weights by place; nulls are left out.

    A row k places before the last one weighs keep ** k, and all but the first also
    1 - keep; so the sum needs no array of a group, and partial sums add up.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, *order, F.col(value).cast("double").alias("_v"))
    back = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    rows = rows.withColumns({"_k": F.row_number().over(back) - 1, "_first": F.lead(F.lit(False), 1, True).over(back)})
    return rows.groupBy(*by).agg(F.sum(F.col("_v") * F.pow(F.lit(keep), F.col("_k")) * F.when(F.col("_first"), 1.0).otherwise(1 - keep)).alias("ema"))


def motion(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """``df`` with dx, dy, dt_s, distance and speed from the row before; no time gives an infinite speed."""
    order = Window.partitionBy("episode").orderBy(*ORDER)
    rows = df.withColumns({"dx": F.col(x) - F.lag(x).over(order), "dy": F.col(y) - F.lag(y).over(order), "dt_s": (F.col("ts_ns") - F.lag("ts_ns").over(order)) / float(SECOND)})
    rows = rows.withColumn("distance", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    return rows.withColumn("speed", F.when(F.col("dt_s") > 0, F.col("distance") / F.col("dt_s")).otherwise(F.when(F.col("dt_s").isNotNull(), F.lit(float("inf")))))


def screen_centre(df: DataFrame, step: int = 10, default: tuple[int, int] = (960, 540)) -> DataFrame:
    """The most frequent position, rounded to ``step`` half to even; of equal ones the first; a default without rows."""
    near = lambda c: (F.bround(F.col(c) / step) * step).cast("long")
    found = df.select(near("x").alias("cx"), near("y").alias("cy"), *ORDER).groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*ORDER)).alias("_at"))
    best = found.agg(F.max_by(F.struct("cx", "cy"), F.struct("n", (-F.col("_at.ts_ns")).alias("a"), (-F.col("_at.seq")).alias("b"))).alias("c"))
    return best.select(F.coalesce("c.cx", F.lit(default[0])).alias("cx"), F.coalesce("c.cy", F.lit(default[1])).alias("cy"))


def reset_flags(moves: DataFrame, *, quick_s: float = 0.001, tolerance: float = 2.0, least: float = 3.0, speed: float = 5000.0, ahead: int = 3) -> DataFrame:
    """``moves`` (of ``motion``) with is_reset: too quick, too fast, or undone by one of the next moves.

    Of the next ``ahead`` moves the first that is opposite within ``tolerance``
    is the one that undoes; both it and the move count. Moves without ``ahead``
    others after them are not looked at.
    """
    order = Window.partitionBy("episode").orderBy(*ORDER)

    def undone(i: int) -> Column:
        ox, oy, od = (F.lead(c, i).over(order) for c in ("dx", "dy", "distance"))
        return (F.abs(F.col("dx") + ox) <= tolerance) & (F.abs(F.col("dy") + oy) <= tolerance) & (F.col("distance") > least) & (od > least)

    which = F.when(F.lead("ts_ns", ahead).over(order).isNull(), 0)
    for i in range(1, ahead + 1):
        which = which.when(undone(i), i)
    rows = moves.withColumn("_undone", F.coalesce(which.otherwise(0), F.lit(0)))
    by_other = F.lit(False)
    for i in range(1, ahead + 1):
        by_other = by_other | F.coalesce(F.lag("_undone", i).over(order) == i, F.lit(False))
    quick = F.coalesce((F.col("dt_s") <= quick_s) | (F.col("speed") > speed), F.lit(False))
    return rows.withColumn("is_reset", quick | (F.col("_undone") > 0) | by_other).drop("_undone")


def reset_summary(flagged: DataFrame) -> DataFrame:
    """(is_reset, n, mean and max distance, mean finite speed)."""
    finite = F.when(F.col("speed") < float("inf"), F.col("speed"))
    return flagged.where("distance is not null").groupBy("is_reset").agg(F.count(F.lit(1)).alias("n"), F.avg("distance").alias("mean_distance"), F.max("distance").alias("max_distance"), F.avg(finite).alias("mean_speed"))
