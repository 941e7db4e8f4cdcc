"""Frames, cuts, samples, isolation, listings and registered types on cases of their own."""

import json

import pytest
from pyspark.sql import functions as F

from tracelake.operators import frames
from tracelake.plans import isolation
from tracelake.plans.stages import EventConfig
from tracelake.schema import decoded, message_types, parses, register_message_type, typed
from tracelake.sources import listing

S = 10**9


def frame(spark, rows):
    return spark.createDataFrame(rows, "episode string, seq bigint, ts_ns bigint, pts bigint")


def test_pts_follow_the_last_kept_frame(spark):
    rows = frame(spark, [("a", 0, 0, None), ("a", 1, 1, None), ("a", 2, 2, 1400), ("a", 3, 3, 1600), ("a", 4, 4, None), ("b", 0, 0, 7)])
    got = frames.written_pts(rows, "pts", fps=60, rate=60_000)
    assert sorted((r.episode, r.seq, r.out_pts) for r in got.collect()) == [("a", 0, 0), ("a", 1, 1000), ("a", 3, 1600), ("a", 4, 2600), ("b", 0, 7)]
    constant = frames.written_pts(rows.where("episode = 'a'"), "pts", fps=30)  # a frame is a tick, so nothing is a duplicate
    assert [r.out_pts for r in constant.orderBy("seq").collect()] == [0, 1, 1400, 1600, 1601]


def test_pts_need_a_rate(spark):
    with pytest.raises(ValueError):
        frames.written_pts(frame(spark, []), "pts", fps=0)
    with pytest.raises(Exception, match="fps is needed"):
        frames.written_pts(frame(spark, [("a", 0, 0, None)]), "pts").collect()


def test_constant_rate_repeats_and_drops(spark):
    times = [0, S // 10, S // 5, S, 4 * S, 4 * S]
    rows = spark.createDataFrame([("a", i, 7 + t) for i, t in enumerate(times)] + [("b", 0, 5)], "episode string, seq bigint, ts_ns bigint")
    got = sorted((r.episode, r.slot, r.seq, r.slot_ns, r.repeated) for r in frames.constant_rate(rows, 2).collect())
    assert got == [("a", 0, 0, 7, False), ("a", 1, 2, 7 + S // 2, False), *[("a", k, 3, 7 + k * S // 2, k > 2) for k in range(2, 8)], ("a", 8, 5, 7 + 4 * S, False), ("b", 0, 0, 5, False)]


def test_gaps_are_not_scanned(spark):
    rows = spark.createDataFrame([("a", 0, 0), ("a", 1, 86_400 * S)], "episode string, seq bigint, ts_ns bigint")
    got = frames.constant_rate(rows, 1)
    assert got.count() == 86_401 and got.where("repeated").count() == 86_399


def test_index_prunes_row_groups(spark, tmp_path):
    rows = spark.range(20_000).select(F.lit("e").alias("episode"), F.lit("v").alias("uri"), F.expr(f"id * {S} div 30").alias("pts_ns"), "id")
    path = str(tmp_path / "index")
    frames.frame_index(rows, F.col("id") % 30 == 0, path, parts=8)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    index = spark.read.parquet(path)
    got = frames.frames_between(index, 100.0, 101.0, uri="v")
    assert got.count() == 31 and {r.key_pts_ns for r in got.collect()} == {100 * S, 101 * S}
    plan = got._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(pts_ns,100000000000)" in plan and "LessThanOrEqual(pts_ns,101000000000)" in plan
    assert frames.frames_between(index, 600.0).count() == 20_000 - 18_000
    assert frames.frames_between(index, 0, -1.0).agg(F.max("pts_ns")).first()[0] <= 20_000 * S // 30 - S


def test_ladder_takes_the_first_margin_for_all(spark):
    keys = spark.createDataFrame([("e", "a", 8), ("e", "a", 20), ("e", "b", 3), ("e", "b", 30), ("f", "a", 50), ("g", "a", 1)], "episode string, uri string, ts_ns bigint")
    ends = spark.createDataFrame([("e", "a", 99), ("e", "b", 41), ("f", "a", 99), ("g", "a", 99)], "episode string, uri string, end_ns bigint")
    targets = spark.createDataFrame([(x, 10, 40) for x in "efg"], "episode string, start_ns bigint, end_ns bigint")
    got = {r.episode: tuple(r)[1:] for r in frames.cut_plan(keys, ends, targets, margins_ns=[1, 2, 7, 9], max_margin_ns=7).collect()}
    assert got["e"] == (2, 7, 8, 41, "ok", [])
    assert got["f"] == (None, None, None, None, "not covered", ["a"])
    assert got["g"] == (3, 9, 1, 49, "too wide", [])


def test_samples_fall_back(spark):
    rows = [("e", 0, [1, 1, 0], ["x", "a", "x", "b", "x"]), ("e", 1, [1, 0, 0], ["x"]), ("e", 2, [0, 0, 0], []), ("e", 3, [1], None)]
    samples = spark.createDataFrame(rows, "episode string, seq_no int, attention_mask array<int>, images array<string>")
    media = spark.createDataFrame([("a", bytearray(b"AA")), ("b", bytearray(b"B"))], "uri string, value binary")
    got = {r.seq_no: r for r in frames.read_samples(samples, media, F.lit("-").cast("binary")).collect()}
    assert [(bytes(m.value), m.how) for m in got[0].media] == [(b"-", "blank"), (b"AA", "own"), (b"AA", "previous"), (b"B", "own"), (b"B", "previous")]
    assert (got[0].n_tokens, got[0].n_images, got[0].n_fallback, got[0].media_bytes) == (2, 5, 3, 7)
    assert [(got[k].n_tokens, got[k].n_images, got[k].n_fallback, len(got[k].media)) for k in (1, 2, 3)] == [(1, 1, 1, 1), (0, 0, 0, 0), (1, 0, 0, 0)]
    listed = {r.seq_no: [m.uri for m in r.media] for r in frames.read_samples(samples, media, F.lit(None), load=False).collect()}
    assert listed == {0: rows[0][3], 1: ["x"], 2: [], 3: []}


def test_one_bad_episode_in_a_hundred(spark, tmp_path):
    press = json.dumps({"event_type": "press", "vk": 1, "timestamp": 0})
    rows = [(f"e{i}", j, j * S, "keyboard", "desktop/KeyboardEvent", press) for i in range(100) for j in range(5)]
    rows[7 * 5 + 2] = ("e7", 2, 2 * S, "keyboard", "desktop/KeyboardEvent", "{broken")
    logs = spark.createDataFrame(rows, "episode string, seq bigint, ts_ns bigint, topic string, message_type string, payload string")
    bad = isolation.write_isolated(logs, str(tmp_path / "out"), EventConfig())
    assert [tuple(r) for r in bad.collect()] == [("e7", "payload does not parse", 2, 1, 5)]
    events = spark.read.parquet(str(tmp_path / "out" / "events"))
    assert {r.episode for r in events.collect()} == {f"e{i}" for i in range(100) if i != 7}
    alone = isolation.isolated_events(logs.where("episode <> 'e7'"), EventConfig())[0]
    assert sorted(map(tuple, events.collect())) == sorted(map(tuple, alone.select(*events.columns).collect()))


def test_rules_name_the_first_break(spark):
    rows = [("a", 0, None, "t"), ("a", 1, -1, "t"), (None, 0, 1, None), (None, 1, 0, "t"), ("c", 0, 5, "t")]
    logs = spark.createDataFrame(rows, "episode string, seq bigint, ts_ns bigint, topic string")
    sound, bad = isolation.isolated(logs, isolation.log_rules(logs))
    assert {r.episode: (r.reason, r.at_seq, r.broken, r.rows) for r in bad.collect()} == {"a": ("no time", 0, 2, 2), None: ("no topic", 0, 1, 2)}
    assert [r.episode for r in sound.collect()] == ["c"]


def test_types_are_registered_at_run_time(spark):
    register_message_type("lab/Reading", "value double, unit string")
    register_message_type("lab/Reading", "value double, unit string")
    with pytest.raises(ValueError, match="other fields"):
        register_message_type("lab/Reading", "value int")
    with pytest.raises(ValueError, match="domain/Name"):
        register_message_type("Reading", "value int")
    with pytest.raises(KeyError):
        decoded(F.col("payload"), "lab/Unknown")
    rows = spark.createDataFrame([("lab/Reading", '{"value": 1.5, "unit": "V"}'), ("lab/Reading", '{"value": "x"}'), ("lab/Other", "{}"), ("lab/Reading", None)], "message_type string, payload string")
    got = typed(rows, ["lab/Reading"]).select("typed.lab__Reading", parses(F.col("payload"), "lab/Reading").alias("ok")).collect()
    assert got[0].lab__Reading.value == 1.5 and [r.ok for r in got] == [True, False, True, False] and got[2].lab__Reading is None
    assert "lab/Reading" in message_types() and "desktop/MouseEvent" in message_types()


def test_references_resolve_beside_the_log_first(spark, tmp_path):
    for name in ("logs/one/a.mkv", "root/a.mkv", "root/b.mkv", "shared/c.mkv"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    found = listing.files(spark, str(tmp_path))
    assert found.count() == 4 and listing.files(spark, str(tmp_path), pattern="b*").first()["bytes"] == len("root/b.mkv")
    log = f"file:{tmp_path}/logs/one/x.mcap"
    uris = ["a.mkv", "b.mkv", "../../shared/c.mkv", "none.mkv", f"{tmp_path}/root/b.mkv", "data:image/png;base64,", None]
    got = {r.uri: r for r in listing.resolved(spark.createDataFrame([(u, log) for u in uris], "uri string, log_path string"), found, root=str(tmp_path / "root")).collect()}
    assert {u: r.path and r.path[len(f"file:{tmp_path}/") :] for u, r in got.items()} == {"a.mkv": "logs/one/a.mkv", "b.mkv": "root/b.mkv", "../../shared/c.mkv": "shared/c.mkv", "none.mkv": None, uris[4]: "root/b.mkv", uris[5]: None, None: None}
    assert [got[u].found for u in uris] == [True, True, True, False, True, True, False]
    totals = {r.folder: (r.files, round(r.share, 6)) for r in listing.folder_totals(found, str(tmp_path)).collect()}
    assert totals["root"][0] == 2 and sum(s for _, s in totals.values()) == pytest.approx(1)
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        listing.files(spark, str(tmp_path / "empty"))
