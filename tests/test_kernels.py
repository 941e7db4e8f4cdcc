"""Order-dependent kernels: golden cases, properties, and independence of partitioning."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracelake.operators import bins, resample, timelines, tokens
from tracelake.operators.ordered import Clamped, Grid, HoldRepeat, NextFit, Thin


def labels(kernel, rows):
    return [kernel.step(*(r if isinstance(r, tuple) else (r,))) for r in rows]


def kept(kernel, rows):
    return [t for t, k in zip(rows, labels(kernel, rows), strict=True) if k]


def test_golden():
    assert kept(Thin(5), [1, 5, 9, 12, 30]) == [5, 12, 30]
    assert kept(Thin(100), [0, 50, 100, 149, 200]) == [100, 200]
    assert kept(Thin(100, None), [0, 50, 100]) == [0, 100]
    assert kept(Grid(10), [0, 4, 30, 31, 32, 40]) == [0, 30, 31, 32, 40]
    assert labels(NextFit(10), [3, 4, 5, 11, 2, 10, 1]) == [0, 0, 1, None, 1, 2, 3]
    assert labels(Clamped(5, 0, 9), [(10, None), (-3, None), (-20, None), (2, None)]) == [9, 6, 0, 2]
    assert labels(Clamped(5, 0, 9), [(1, 8), (None, None)]) == [8, 8]


def repeats(rows, every=100, reset=1000):
    kernel, out = HoldRepeat(every, reset), []
    for t, key, pressed in rows:
        r = kernel.step(t, key, pressed)
        out += [("made", m["t"]) for m in r["made"]] + ([("row", t)] if r["keep"] and key is not None else [])
    return out


def test_key_repeat():
    other = lambda *ts: [(t, None, None) for t in ts]
    assert repeats([(0, 1, True), *other(50, 130, 250), (310, 1, False)]) == [("row", 0), ("made", 100), ("made", 200), ("row", 310)]
    assert repeats([(0, 1, True), *other(1500, 1650), (1700, 1, False)]) == [("row", 0), ("made", 1600), ("row", 1700)]
    assert repeats([(0, 1, True), (20, 1, True), (40, 1, False)]) == [("row", 0), ("row", 40)]


@settings(max_examples=50)
@given(st.lists(st.integers(0, 1000)), st.integers(1, 100))
def test_thin_keeps_all_it_can(times, every):
    times = sorted(times)
    got = kept(Thin(every, None), times)
    assert all(b - a >= every for a, b in zip(got, got[1:], strict=False))
    assert kept(Thin(every, None), got) == got
    assert all(any(0 <= t - k < every for k in got) for t in times)


@settings(max_examples=50)
@given(st.lists(st.integers(0, 20)), st.integers(1, 15))
def test_packing_respects_the_capacity(lengths, capacity):
    got = labels(NextFit(capacity), lengths)
    sums = {}
    for n, g in zip(lengths, got, strict=True):
        assert (g is None) == (n > capacity)
        if g is not None:
            sums[g] = sums.get(g, 0) + n
    assert all(s <= capacity for s in sums.values())
    numbers = [g for g in got if g is not None]
    assert numbers == sorted(numbers)


def events(spark, rows):
    return spark.createDataFrame([("e", i, t, topic, p) for i, (topic, t, p) in enumerate(rows)], "episode string, seq bigint, ts_ns bigint, topic string, payload string")


def test_deltas(spark):
    df = events(spark, [("m", 100, None), ("m", 120, None), ("m", 149, None), ("m", 150, None), ("m", 199, None), ("b", 160, None)]).withColumn("d", F.when(F.col("topic") == "m", F.col("seq") + 1).otherwise(0))
    got = sorted((r.ts_ns, r.d) for r in resample.sum_deltas(df, 50, ["d"], F.col("topic") == "m").collect())
    assert got == [(100, 1), (150, 9), (160, 0)]


def test_bins(spark):
    df = events(spark, [("screen", 0, "s0"), ("key", 3, "k3"), ("screen", 12, "s12"), ("key", 25, "k25")])
    state, action = F.col("topic") == "screen", F.col("topic") == "key"
    got = [(r.bin_idx, r.timestamp_ns, r.state, r.actions) for r in bins.time_bins(df, 10, state, action).orderBy("bin_idx").collect()]
    assert got == [(0, 0, "s0", ["k3"]), (1, 10, "s12", []), (2, 20, "s12", ["k25"])]
    assert [r.bin_idx for r in bins.time_bins(df, 10, state, action, drop_empty=True).orderBy("bin_idx").collect()] == [0, 2]


def test_resampling_does_not_depend_on_partitions(spark):
    df = events(spark, [(f"t{i % 3}", i * 7 % 101, None) for i in range(100)])
    found = set()
    for n in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.add(tuple(sorted(r.seq for r in resample.thin(df.repartition(n, "seq"), 13).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(found) == 1


def test_holds_clicks_and_changes(spark):
    rows = [("p", 1, None), ("p", 3, None), ("r", 4, None), ("r", 5, None)]
    df = events(spark, rows).withColumn("b", F.lit("left"))
    assert [(r.start_ns, r.end_ns) for r in timelines.click_pairs(df, "b", F.col("topic") == "p", 0).collect()] == [(3, 4)]
    assert [(r.start_ns, r.end_ns) for r in timelines.key_holds(df, "b", F.col("topic") == "p", 0).collect()] == [(1, 4)]
    ticks = spark.createDataFrame([("e", i, i, s) for i, s in enumerate([[], ["a"], ["a", "b"], ["b"], None])], "episode string, seq bigint, ts_ns bigint, held array<string>")
    got = [(r.ts_ns, r.change, r.member) for r in timelines.state_changes(ticks, "held").orderBy("ts_ns", "place").collect()]
    assert got == [(1, "press", "a"), (2, "press", "b"), (3, "release", "a"), (4, "release", "b")]


def test_asof_and_unwrap(spark):
    q = spark.createDataFrame([("e", 2), ("e", 5), ("e", 7), ("e", 11)], "episode string, ts_ns bigint")
    f = spark.createDataFrame([("e", 0, 0), ("e", 5, 5), ("e", 10, 10)], "episode string, ts_ns bigint, frame bigint")
    assert [r.frame for r in tokens.asof(q, f).orderBy("ts_ns").collect()] == [5, 5, 10, None]
    assert [r.frame for r in tokens.asof(q, f, forward=False).orderBy("ts_ns").collect()] == [0, 5, 5, 10]
    t = spark.createDataFrame([("e", i, x) for i, x in enumerate([8, 9, 1, 2])], "episode string, seq bigint, t bigint")
    assert [r.t for r in tokens.unwrap(t, 10).orderBy("seq").collect()] == [8, 9, 11, 12]


def test_resample_routes_by_topic(spark):
    """At 20 Hz: raw moves are summed up, button rows pass, held keys repeat uniformly and keep their release, screens are thinned."""
    ms = 10**6
    move = lambda x, flags=0: f'{{"last_x":{x},"last_y":1,"button_flags":{flags}}}'
    key = lambda kind: f'{{"event_type":"{kind}","vk":65}}'
    rows = [
        ("e", 1, 1000 * ms, "mouse/raw", move(1)), ("e", 2, 1010 * ms, "mouse/raw", move(2)), ("e", 3, 1020 * ms, "mouse/raw", move(7, 1)), ("e", 4, 1060 * ms, "mouse/raw", move(4)),
        ("e", 5, 1100 * ms, "keyboard", key("press")), ("e", 6, 1130 * ms, "keyboard", key("press")), ("e", 7, 1210 * ms, "screen", "{}"), ("e", 8, 1220 * ms, "screen", "{}"), ("e", 9, 1230 * ms, "keyboard", key("release")),
        ("e", 10, 1240 * ms, "window", "{}"),
    ]
    log = spark.createDataFrame(rows, "episode string, seq bigint, ts_ns bigint, topic string, payload string")
    out = resample.resample(log, {"mouse/raw": 20.0, "keyboard": 20.0, "screen": 20.0}).withColumn("x", F.get_json_object("payload", "$.last_x").cast("int"))
    got = sorted((r.topic, r.ts_ns // ms, r.x) for r in out.collect())
    assert got == [
        ("keyboard", 1100, None), ("keyboard", 1150, None), ("keyboard", 1200, None), ("keyboard", 1230, None),
        ("mouse/raw", 1000, 1), ("mouse/raw", 1020, 7), ("mouse/raw", 1060, 6), ("screen", 1210, None), ("window", 1240, None),
    ]
    kinds = [F.get_json_object("payload", "$.event_type").alias("k")]
    assert [r.k for r in out.where("topic = 'keyboard'").orderBy("ts_ns").select(*kinds).collect()] == ["press", "press", "press", "release"]


def test_logs_are_numbered_alike_however_they_are_read(spark, tmp_path):
    from tracelake.sources.logs import read_jsonl, read_log, write_log

    for name in ("a", "b"):
        (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"episode":"{name}","ts_ns":{(i * 7) % 10},"topic":"t","message_type":"x/Y","payload":"{i}"}}\n' for i in range(10)))
    both, one = read_jsonl(spark, str(tmp_path)), read_jsonl(spark, str(tmp_path / "a.jsonl"))
    of = lambda df: {(r.episode, r.payload): r.seq for r in df.where("episode = 'a'").collect()}
    assert of(both) == of(one) and sorted(of(one).values()) == list(range(10))
    write_log(both, str(tmp_path / "log"))
    assert sorted(map(tuple, read_log(spark, str(tmp_path / "log")).select(*both.columns).collect())) == sorted(map(tuple, both.collect()))
