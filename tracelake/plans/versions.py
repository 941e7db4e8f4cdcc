"""Versioned rewrites of a table: a new version beside the old ones, checked, then made current by one small file.

    root/data-<id>/...            the rows of a version, never changed once written
    root/versions/00000003.json   what version 3 is; the highest number is current

A rewrite writes a new data folder, checks it against what it came from, and then
creates the next number's file, which fails where another writer was first. Readers
read the highest number, so a writer that dies, or fails its checks, leaves the old
version current and a data folder that nothing names; ``expire`` removes such folders
once they are old enough. A rollback names an earlier version's data anew, so it is
itself a version, and nothing is lost by it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators.logs import compare
from tracelake.plans.evolve import Migration, path
from tracelake.schema import message_types, parses

Check = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Version:
    """A version of a table: its data folder, the schema version of its payloads, and why it was made."""

    number: int
    data: str
    label: str
    reason: str
    made_s: float


class Conflict(RuntimeError):
    """Another writer made the next version first."""


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, root: str) -> list[Version]:
    """All versions, oldest first; none where there is no table yet."""
    fs, where = _fs(spark, f"{root}/versions")
    if not fs.exists(where):
        return []
    names = sorted(str(s.getPath().getName()) for s in fs.listStatus(where))
    out = []
    for name in (n for n in names if n.endswith(".json")):
        stream = fs.open(_fs(spark, f"{root}/versions/{name}")[1])
        out.append(Version(**json.loads(str(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))))
        stream.close()
    return out


def current(spark: SparkSession, root: str) -> Version:
    found = versions(spark, root)
    if not found:
        raise FileNotFoundError(f"no version of {root}")
    return found[-1]


def read(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """Rows of the current version, or of a numbered one."""
    found = [v for v in versions(spark, root) if number in (None, v.number)]
    if not found:
        raise FileNotFoundError(f"no version {'' if number is None else number} of {root}")
    return spark.read.parquet(f"{root}/{found[-1].data}")


def _publish(spark: SparkSession, root: str, version: Version) -> Version:
    """Create the version's file, which exists whole or not at all; ``Conflict`` where it exists."""
    fs, _ = _fs(spark, root)
    drafts = f"{root}/drafts"
    draft, final = (_fs(spark, p)[1] for p in (f"{drafts}/{uuid.uuid4().hex}", f"{root}/versions/{version.number:08d}.json"))
    fs.mkdirs(_fs(spark, drafts)[1])
    fs.mkdirs(_fs(spark, f"{root}/versions")[1])
    stream = fs.create(draft, False)
    stream.write(bytearray(json.dumps(asdict(version), sort_keys=True).encode()))
    stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE  # fails where the name is taken
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(final), options)
    except Exception as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" in str(e):
            raise Conflict(f"version {version.number} of {root} exists") from e
        raise
    return version


def write(rows: DataFrame, root: str, *, label: str = "", reason: str = "write", based_on: int | None = None) -> Version:
    """Write ``rows`` as the next version; ``based_on`` is the version they came from, by default the current one."""
    spark = rows.sparkSession
    found = versions(spark, root)
    at = based_on if based_on is not None else found[-1].number if found else 0
    data = f"data-{uuid.uuid4().hex}"
    rows.write.parquet(f"{root}/{data}")
    return _publish(spark, root, Version(at + 1, data, label, reason, time.time()))


def typed_payloads(before: DataFrame, after: DataFrame) -> DataFrame:
    """(episode, reason) of episodes with a payload that does not parse as its registered message type."""
    fits = F.lit(True)
    for name in message_types():
        fits = F.when(F.col("message_type") == name, parses(F.col("payload"), name)).otherwise(fits)
    bad = F.first(F.when(~fits, F.col("message_type")), ignorenulls=True)
    return after.groupBy("episode").agg(bad.alias("_t")).where("_t is not null").select("episode", F.concat(F.lit("payload of "), "_t").alias("reason"))


def same_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """(episode, reason) of episodes whose rows a step lost, made or moved to other topics."""
    return compare(before, after).where("reason <> 'ok'")


def nothing_missing(key: str = "episode") -> Check:
    """A check that every key is there still."""
    return lambda before, after: before.select(key).distinct().join(after.select(key).distinct(), key, "left_anti").select(F.col(key).alias("episode"), F.lit("missing").alias("reason"))


def rewrite(spark: SparkSession, root: str, steps: list[Migration], *, label: str = "", checks: tuple[Check, ...] = (same_rows, typed_payloads)) -> Version:
    """The current version through the steps, as the next version.

    It is checked as written; where a check has findings, a ValueError names the first
    ones, the new data are deleted, and the old version stays current.
    """
    now = current(spark, root)
    before = spark.read.parquet(f"{root}/{now.data}")
    after = before
    for s in steps:
        after = s.step(after)
    data = f"data-{uuid.uuid4().hex}"
    after.write.parquet(f"{root}/{data}")
    written = spark.read.parquet(f"{root}/{data}")
    for check in checks:
        bad = check(before, written).orderBy("episode").limit(3).collect()
        if bad:
            _delete(spark, f"{root}/{data}")
            raise ValueError("; ".join(f"{r['reason']} of {r['episode']}" for r in bad))
    return _publish(spark, root, Version(now.number + 1, data, label or now.label, "rewrite", time.time()))


def migrate(spark: SparkSession, root: str, steps: list[Migration], to: str, *, checks: tuple[Check, ...] = (same_rows, typed_payloads)) -> Version:
    """Rewrite to schema version ``to`` by the chain of steps from the current label; nothing is done where that is it."""
    now = current(spark, root)
    chain = path(steps, now.label, to)
    return rewrite(spark, root, chain, label=to, checks=checks) if chain else now


def rollback(spark: SparkSession, root: str, to: int | None = None) -> Version:
    """Make an earlier version's data current again: the one before the current data, or version ``to``."""
    found = versions(spark, root)
    if not found:
        raise FileNotFoundError(f"no version of {root}")
    earlier = [v for v in found if (v.data != found[-1].data if to is None else v.number == to)]
    if not earlier:
        raise ValueError(f"{root} has no version to go back to")
    back = earlier[-1]
    return _publish(spark, root, Version(found[-1].number + 1, back.data, back.label, f"rollback to {back.number}", time.time()))


def _delete(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def expire(spark: SparkSession, root: str, *, keep: int = 2, older_than_s: float = 86_400.0, dry: bool = False) -> list[str]:
    """Delete version files beyond the last ``keep``, and data folders that no version names and that are old enough; returns their names.

    The age protects a rewrite that is still being written.
    """
    if keep < 1:
        raise ValueError("the current version is always kept")
    found = versions(spark, root)
    kept, gone = found[-keep:], found[:-keep]
    named = {v.data for v in kept}
    fs, where = _fs(spark, root)
    limit = (time.time() - older_than_s) * 1000
    data = [s for s in fs.listStatus(where) if s.isDirectory() and str(s.getPath().getName()).startswith("data-")]
    listed = {v.data for v in gone}
    loose = [n for s in data if (n := str(s.getPath().getName())) not in named and (n in listed or s.getModificationTime() <= limit)]
    names = [*(f"versions/{v.number:08d}.json" for v in gone), *sorted(loose)]
    if not dry:
        for name in names:  # version files first: what is named is there
            _delete(spark, f"{root}/{name}")
    return names


def history(spark: SparkSession, root: str) -> DataFrame:
    """(number, data, label, reason, made_s, current) as a table."""
    found = versions(spark, root)
    rows = [(*asdict(v).values(), v is found[-1]) for v in found]
    return spark.createDataFrame(rows, "number int, data string, label string, reason string, made_s double, current boolean")
