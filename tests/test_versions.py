"""Versions: a failed or killed rewrite leaves the old one current, rollbacks, conflicts, expiry."""

import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from tracelake.plans import versions
from tracelake.plans.evolve import Migration, rename_prefix
from tracelake.schema import register_message_type

SCHEMA = "episode string, seq bigint, ts_ns bigint, topic string, message_type string, payload string"


@pytest.fixture
def root(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = [(f"e{i % 3}", i, i, "t", "old/Thing", '{"n": 1}') for i in range(30)]
    versions.write(spark.createDataFrame(rows, SCHEMA), path, label="0.1.0")
    return path


def names(spark, root):
    return {r.message_type for r in versions.read(spark, root).collect()}


RENAME = Migration((0, 1, 0), (0, 2, 0), lambda d: d.withColumn("message_type", rename_prefix(F.col("message_type"), "old", "new")))


def test_migration_and_rollback(spark, root):
    assert versions.migrate(spark, root, [RENAME], "0.2.0").number == 2
    assert names(spark, root) == {"new/Thing"} and versions.current(spark, root).label == "0.2.0"
    assert versions.migrate(spark, root, [RENAME], "0.2.0").number == 2  # it is there already
    back = versions.rollback(spark, root)
    assert (back.number, back.label, back.reason) == (3, "0.1.0", "rollback to 1") and names(spark, root) == {"old/Thing"}
    assert versions.rollback(spark, root, to=2).label == "0.2.0" and names(spark, root) == {"new/Thing"}
    assert [r.current for r in versions.history(spark, root).orderBy("number").collect()] == [False, False, False, True]
    with pytest.raises(ValueError):
        versions.rollback(spark, root, to=9)


@pytest.mark.parametrize(
    ("step", "said"),
    [
        (lambda d: d.where("seq <> 7"), "message count of e1"),
        (lambda d: d.withColumn("topic", F.when(F.col("episode") == "e2", "u").otherwise(F.col("topic"))), "topics of e2"),
        (lambda d: d.where("episode <> 'e0'"), "message count of e0"),
    ],
)
def test_failed_checks_leave_the_old_version(spark, root, step, said):
    with pytest.raises(ValueError, match=said):
        versions.rewrite(spark, root, [Migration((0,), (1,), step)])
    assert versions.current(spark, root).number == 1 and len([d for d in os.listdir(root) if d.startswith("data-")]) == 1


def test_payloads_are_validated(spark, root):
    register_message_type("made/Thing", "n int")
    good = Migration((0,), (1,), lambda d: d.withColumn("message_type", F.lit("made/Thing")))
    broken = Migration((0,), (1,), lambda d: d.withColumn("payload", F.lit('{"n": "x"}')))
    with pytest.raises(ValueError, match="payload of made/Thing of e0"):
        versions.rewrite(spark, root, [good, broken])
    assert versions.rewrite(spark, root, [good]).number == 2


def test_a_step_that_raises(spark, root):
    bad = Migration((0,), (1,), lambda d: d.withColumn("payload", F.when(F.col("seq") == 20, F.raise_error(F.lit("broken row")).cast("string")).otherwise(F.col("payload"))))
    with pytest.raises(Exception, match="broken row"):
        versions.rewrite(spark, root, [bad])
    assert versions.current(spark, root).number == 1 and versions.read(spark, root).count() == 30


def test_a_killed_writer(spark, root):
    """A process that dies after it has written its data, and before they are published."""
    code = f"""
        import os, sys
        sys.path.insert(0, {os.getcwd()!r})
        from pyspark.sql import SparkSession
        from tracelake.plans import versions
        spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
        versions._publish = lambda *a: os._exit(9)
        versions.write(spark.range(5).selectExpr("'x' as episode", "id as seq"), {root!r})
    """
    died = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, timeout=120)
    assert died.returncode == 9
    assert versions.current(spark, root).number == 1 and versions.read(spark, root).count() == 30
    loose = [d for d in os.listdir(root) if d.startswith("data-") and d != versions.current(spark, root).data]
    assert len(loose) == 1 and versions.expire(spark, root, older_than_s=3600) == []  # it may still be written
    assert versions.expire(spark, root, older_than_s=-10) == loose and versions.read(spark, root).count() == 30


def test_two_writers(spark, root):
    rows = versions.read(spark, root)
    versions.write(rows.limit(5), root, based_on=1)
    with pytest.raises(versions.Conflict):
        versions.write(rows.limit(9), root, based_on=1)
    assert versions.read(spark, root).count() == 5 and versions.read(spark, root, 1).count() == 30
    assert not os.listdir(f"{root}/drafts")


def test_expiry_keeps_what_is_named(spark, root):
    for n in (3, 4):
        versions.write(versions.read(spark, root).limit(n), root)
    versions.rollback(spark, root, to=1)
    told = versions.expire(spark, root, keep=2, dry=True)
    assert told == versions.expire(spark, root, keep=2) and len(told) == 3  # two files, and version 2's data
    assert [v.number for v in versions.versions(spark, root)] == [3, 4] and versions.read(spark, root).count() == 30 and versions.read(spark, root, 3).count() == 3
    with pytest.raises(ValueError):
        versions.expire(spark, root, keep=0)


def test_no_table(spark, tmp_path):
    assert versions.versions(spark, str(tmp_path / "none")) == []
    for f in (versions.current, versions.read, versions.rollback):
        with pytest.raises(FileNotFoundError):
            f(spark, str(tmp_path / "none"))
