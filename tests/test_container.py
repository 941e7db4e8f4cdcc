"""Log containers: what is written is what is read, only what is asked for is opened, damage is found."""

import io
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan, StringStartsWith

from tracelake.sources import container
from tracelake.sources.container import ContainerFile, PushingReader, read_containers, write_containers

SCHEMA = "episode string, seq bigint, ts_ns bigint, topic string, message_type string, payload string"


class Sink(io.BytesIO):
    def close(self):
        self.whole = self.getvalue()


@pytest.fixture(scope="module")
def events(spark):
    rows = [(f"e{i % 3}", i, 1000 * i, ["screen", "keyboard", "näme", "rare"][3 if i == 700 else i % 3], f"d/T{3 if i == 700 else i % 3}", f'{{"i": {i}, "é": "{"x" * (i % 50)}"}}') for i in range(3000)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def folder(events, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("logs") / "out")
    write_containers(events, path, chunkBytes=4000)
    return path


def same(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_round_trip(spark, events, folder):
    assert same(read_containers(spark, folder), events)
    assert not [f for f in os.listdir(folder) if not f.endswith(".mcap")]


@pytest.mark.parametrize("pushed", ["true", "false"])
def test_filters(spark, events, folder, pushed):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", pushed)
    got = read_containers(spark, folder)
    for rule in ("topic = 'keyboard'", "topic in ('rare', 'screen') and ts_ns > 5000", "episode = 'e1' and ts_ns <= 900000 and ts_ns >= 100000", "ts_ns = 700000", "topic is null", "seq < 5 and topic like 'n%'"):
        assert same(got.where(rule), events.where(rule)), rule
    assert same(read_containers(spark, folder, topics=["rare", "none"], start_ns=0, end_ns=700_000), events.where("topic = 'rare'"))
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def opened(folder, filters=(), **options):
    reader = PushingReader(None, {"path": folder, "partitionBytes": "1"} | options)
    assert list(reader.pushFilters(list(filters))) == list(filters)  # Spark applies them again
    return sum(len(refs) for part in reader.partitions() for *_, refs in part.places)


def test_one_topic_opens_only_its_chunks(folder):
    whole = opened(folder)
    assert whole > 50 and opened(folder, [EqualTo(("topic",), "rare")]) == 1 == opened(folder, [In(("topic",), ("rare",))])
    assert opened(folder, [EqualTo(("topic",), "none")]) == 0
    assert 0 < opened(folder, [GreaterThanOrEqual(("ts_ns",), 0), LessThan(("ts_ns",), 300_000)]) < 0.2 * whole
    assert opened(folder, [EqualTo(("episode",), "e0")]) < 0.5 * whole
    assert opened(folder, [StringStartsWith(("topic",), "ra")]) == whole


def test_index_is_a_table(spark, events, folder):
    chunks = read_containers(spark, folder, table="chunks")
    assert chunks.agg(F.sum("messages")).first()[0] == 3000
    rare = chunks.where(F.array_contains("topics", "rare")).collect()
    assert len(rare) == 1 and rare[0].start_ns <= 700_000 <= rare[0].end_ns
    assert {r["values"]["episode"] for r in read_containers(spark, folder, table="metadata").where("name = 'episode'").collect()} == {"e0", "e1", "e2"}


def test_attachments_and_foreign_metadata(spark, tmp_path):
    out = Sink()
    f = ContainerFile(out, "own", metadata={"session": {"os": "linux"}})
    f.attach("shot.png", "image/png", b"\x00\x01", log_ns=5)
    f.message(1, 7, "t", "d/T", "{}")
    f.close()
    (tmp_path / "a.mcap").write_bytes(out.whole)
    got = read_containers(spark, str(tmp_path), table="attachments").collect()
    assert [(r.episode, r.name, r.media_type, r.log_ns, bytes(r.data)) for r in got] == [("own", "shot.png", "image/png", 5, b"\x00\x01")]
    assert {(r.name, tuple(r["values"].items())) for r in read_containers(spark, str(tmp_path), table="metadata").collect()} == {("episode", (("episode", "own"),)), ("session", (("os", "linux"),))}
    assert [tuple(r) for r in read_containers(spark, str(tmp_path)).collect()] == [("own", 1, 7, "t", "d/T", "{}")]


def test_empty_file_and_missing_files(spark, tmp_path):
    with pytest.raises(Exception, match="no .mcap files"):
        read_containers(spark, str(tmp_path)).count()
    out = Sink()
    ContainerFile(out, "none").close()
    (tmp_path / "a.mcap").write_bytes(out.whole)
    assert read_containers(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("how", ["zstd", ""])
def test_damage_is_found(spark, tmp_path, how):
    out = Sink()
    f = ContainerFile(out, "own", compression=how)
    for i in range(50):
        f.message(i, i, "t", "d/T", "some payload")
    f.close()
    whole = out.whole
    at = whole.index(b"\x06", 8)
    for k, broken in enumerate((whole[:-20], whole[: at + 150] + bytes([whole[at + 150] ^ 1]) + whole[at + 151 :], whole[:-60] + bytes([whole[-60] ^ 1]) + whole[-59:])):
        path = tmp_path / f"{how}{k}"
        path.mkdir()
        (path / "a.mcap").write_bytes(broken)
        with pytest.raises(Exception, match="(?i)checksum|ends early|container|zstd|decompress"):
            read_containers(spark, str(path)).collect()


def test_failed_writes_leave_nothing(spark, tmp_path, events):
    mixed = events.limit(40).unionByName(events.limit(1).withColumn("message_type", F.lit("d/Other")))
    path = str(tmp_path / "out")
    with pytest.raises(Exception, match="message types"):
        write_containers(mixed, path)
    with pytest.raises(Exception, match="can't be stored"):
        write_containers(events.limit(5).withColumn("ts_ns", F.lit(-1).cast("bigint")), path)
    assert not os.path.exists(path) or not [f for _, _, names in os.walk(path) for f in names]


def test_types_of_an_episode_in_several_tasks(spark, tmp_path):
    """An episode's parts that disagree are found when all tasks have ended."""
    rows = [("e", i, i, "t", "d/A" if i < 500 else "d/B", "{}") for i in range(1000)]
    frame = spark.createDataFrame(rows, SCHEMA).repartitionByRange(4, "ts_ns").sortWithinPartitions("ts_ns")
    spark.dataSource.register(container.LogContainer)
    with pytest.raises(Exception, match="message types"):
        frame.write.format("log_container").mode("append").save(str(tmp_path / "out"))
    assert not [f for _, _, names in os.walk(tmp_path / "out") for f in names]


def test_overwrite(spark, tmp_path, events):
    path = str(tmp_path / "out")
    write_containers(events.limit(10), path)
    write_containers(events.where("seq < 4"), path, mode="overwrite")
    assert read_containers(spark, path).count() == 4
