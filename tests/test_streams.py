"""Streams over shuffled files equal batches; state goes; late rows come out aside."""

import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import resample, timelines
from tracelake.streaming import ordered
from tracelake.streaming.live import log_stream

S = 10**9
SCHEMA = "episode string, seq bigint, ts_ns bigint, topic string, vk int, pressed boolean, dx bigint, dy bigint, x bigint, y bigint"


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(4)
    out = []
    for e in ("a", "b", "c"):
        t = S
        for i in range(120):
            t += draw.randrange(S // 5, 2 * S)
            absolute = draw.random() < 0.1
            out.append((e, i, t, draw.choice(["m", "k"]), draw.randrange(2), draw.random() < 0.6, draw.randrange(-40, 40), draw.randrange(-40, 40), draw.randrange(100) if absolute else None, draw.randrange(80) if absolute else None))
    return out


@pytest.fixture(scope="module")
def stream(spark, rows, tmp_path_factory):
    """Files of ten seconds each, rows of neighbouring files mixed, then a row of another day that lets time pass."""
    ordered.state_store(spark)
    path = str(tmp_path_factory.mktemp("stream") / "in")
    draw = random.Random(8)
    parts = {}
    for r in rows:
        parts.setdefault(int((r[2] + draw.randrange(8 * S)) // (10 * S)), []).append(r)
    for k in sorted(parts):
        draw.shuffle(parts[k])
        spark.createDataFrame(parts[k], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    for day in (1, 2, 3):
        spark.createDataFrame([("end", day, day * 86_400 * S, "m", 0, None, 0, 0, None, None)], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def run(spark, made, path, tmp_path, name):
    """All output rows of a stream over the files, one file a batch, and the query's last progress with state."""
    out = made(log_stream(spark, path, files_per_trigger=1, schema=SCHEMA))
    query = out.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name), [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]


HOW = {"late_ms": 20_000}


def test_thin_equals_batch_and_leaves_no_state(spark, rows, stream, tmp_path):
    got, state = run(spark, lambda s: ordered.thin(s, 3 * S, **HOW), stream, tmp_path, "thin")
    batch = resample.thin(spark.createDataFrame(rows, SCHEMA), 3 * S)
    assert got.where("late").count() == 0
    assert sorted((r.episode, r.seq) for r in got.where("episode <> 'end'").collect()) == sorted((r.episode, r.seq) for r in batch.collect())
    assert max(state) > 10 and state[-1] <= 4  # at most the rows of the last day


def test_sums_equal_batch(spark, rows, stream, tmp_path):
    got, _ = run(spark, lambda s: ordered.sum_deltas(s.where("topic = 'm'"), 3 * S, **HOW), stream, tmp_path, "sums")
    batch = resample.sum_deltas(spark.createDataFrame(rows, SCHEMA).where("topic = 'm'"), 3 * S, ["dx", "dy"], F.lit(True))
    assert sorted((r.episode, r.seq, *r.sums) for r in got.where("episode <> 'end'").collect()) == sorted((r.episode, r.seq, r.dx, r.dy) for r in batch.collect())


def test_repeats_equal_batch(spark, rows, stream, tmp_path):
    got, _ = run(spark, lambda s: ordered.key_repeat(s, S // 4, **HOW), stream, tmp_path, "repeats")
    batch = resample.key_repeat(spark.createDataFrame(rows, SCHEMA), S // 4).where("made")
    made = [(r.episode, m.key, m.t) for r in got.where("episode <> 'end'").collect() for m in r.made]
    assert sorted(made) == sorted((r.episode, r.vk, r.ts_ns) for r in batch.collect()) and made


def test_holds_equal_batch(spark, rows, stream, tmp_path):
    got, state = run(spark, lambda s: ordered.holds(s, "vk", F.coalesce("pressed", F.lit(False)), S, idle_ns=600 * S, **HOW), stream, tmp_path, "holds")
    batch = timelines.key_holds(spark.createDataFrame(rows, SCHEMA), "vk", F.col("pressed"), S)
    assert sorted(tuple(r)[:4] for r in got.where("episode <> 'end'").collect()) == sorted(map(tuple, batch.collect()))
    assert state[-1] <= 4


def test_cursor_equals_batch(spark, rows, stream, tmp_path):
    got, _ = run(spark, lambda s: ordered.cursor(s, 100, 80, **HOW), stream, tmp_path, "cursor")
    batch = timelines.cursor(spark.createDataFrame(rows, SCHEMA), {"px": ("dx", "x"), "py": ("dy", "y")}, {"px": 100, "py": 80})
    assert sorted((r.episode, r.seq, r["at"].x, r["at"].y) for r in got.where("episode <> 'end'").collect()) == sorted((r.episode, r.seq, r.px, r.py) for r in batch.collect())


def test_late_rows_are_a_side_output(spark, tmp_path):
    ordered.state_store(spark)
    row = lambda i, t: ("a", i, t * S, "m", 0, None, 0, 0, None, None)
    for part in ([row(0, 10)], [row(1, 100)], [row(2, 200)], [row(3, 300)], [row(4, 60), row(5, 190)], [row(6, 1)], [row(7, 5000)], [row(8, 9000)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got, _ = run(spark, lambda s: ordered.thin(s, S, keys=("episode",), late_ms=20_000, grace_ms=150_000), str(tmp_path / "in"), tmp_path, "late")
    found = {r.seq: r.late for r in got.collect()}
    # 60 comes when rows up to 180 have been worked on; 190 is in time; 1 is beyond the grace.
    assert found == {0: False, 1: False, 2: False, 3: False, 4: True, 5: False, 7: False}
