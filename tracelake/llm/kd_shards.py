"""Sharding by a k-d tree over metadata: weighted medians along the widest dimension until a leaf is one shard.

A node that stands for k shards is split where the sizes of its documents reach the
share of k // 2 of them, along the dimension that is widest in it: a number's range,
or a text's number of distinct values, against those of the whole table. All nodes of
a level are split together. Spark range-partitions the metadata by (node, value, text
digest, id) and sorts it; running sums within partitions and one total for each
partition give every document its exact place in its node, so the median is exact,
no task holds a node, and a value that most documents share is cut within by the
digests. Only one row for each node and each partition reaches the driver.

Texts are read once for size and digests; what is sorted is metadata alone. Documents
of equal text are a group: all of them take the metadata of the one with the smallest
id, so they stand side by side; where a median falls into a group, it moves to the
group's nearer end if that moves no more than ``slack`` of a shard's bytes. Larger
groups are divided, so that a group that holds a third of all rows does not make one
shard of them.

Defined cases: a null text is empty and has the size of the fixed part alone; null
metadata come first; null and repeated ids are documents of their own, each in one
slot; an empty table gives an empty result. Extra columns are not read by
``kd_shards`` and kept by ``write_shards``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import shuffle_parts, stored

#: Bytes that a document costs besides its text.
FIXED_BYTES = 16


def sums_before(rows: DataFrame, order: list[str], weight: str) -> DataFrame:
    """``rows`` with ``before``: the sum of ``weight`` over all rows before it in ``order``. The last of ``order`` is unique.

    The sums within partitions are written; what reaches the driver is one number for
    each partition.
    """
    spark = rows.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            values = batch.column(weight).to_numpy()
            upto = np.cumsum(values) + total
            within = upto - values
            total = int(upto[-1]) if len(upto) else total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(within), pa.array(np.full(len(within), part, np.int32))], names=[*batch.schema.names, "within", "part"])

    ranged = rows.repartitionByRange(shuffle_parts(spark), *order).sortWithinPartitions(*order)
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), "within bigint", "part int"])
    summed = stored(ranged.mapInArrow(run, schema), "ordered")
    at, starts = 0, []
    for part, total in sorted(summed.groupBy("part").agg(F.sum(weight)).collect()):
        starts.append((part, at))
        at += total
    before = F.broadcast(spark.createDataFrame(starts, "part int, start bigint"))
    return summed.join(before, "part").withColumn("before", F.col("start") + F.col("within")).drop("part", "start", "within")


def metadata(docs: DataFrame, dims: list[str | Column], id_col: str, text_col: str, row: Column) -> DataFrame:
    """(row, id, size, text_crc32, digest, d0, d1, ...), written; dimensions of equal texts are those of the first of them."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    names = [f"d{k}" for k in range(len(dims))]
    found = docs.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for c, n in zip(dims, names, strict=True)]).dtypes
    columns = [(F.col(c) if isinstance(c, str) else c).cast("string" if kind in ("string", "binary") else "double").alias(n) for c, (n, kind) in zip(dims, found, strict=True)]
    size = (F.octet_length(text) + FIXED_BYTES).cast("long")
    rows = stored(docs.select(row.alias("row"), F.col(id_col).alias("id"), size.alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("digest"), *columns), "metadata")
    first = rows.groupBy("digest").agg(F.min(F.struct("id", "row", *names)).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # Written, so that Spark can split a text that a third of all rows have.
    both = rows.join(stored(first, "groups"), "digest", "left")
    own = [F.when(F.col("first").isNull(), F.col(n)).otherwise(F.col(f"first.{n}")).alias(n) for n in names]
    return stored(both.select("row", "id", "size", "text_crc32", "digest", *own), "units")


def _widths(rows: DataFrame) -> tuple[dict[int, int], dict[int, list[float]]]:
    """Bytes of each node, and how wide each dimension is in it: one row for each node reaches the driver."""
    dims = [(n, t) for n, t in rows.dtypes if n[0] == "d" and n[1:].isdigit()]
    wide = [F.coalesce(F.max(n) - F.min(n) if t == "double" else F.approx_count_distinct(n).cast("double") - 1, F.lit(0.0)).alias(n) for n, t in dims]
    found = rows.groupBy("node").agg(F.sum("size").alias("bytes"), *wide).collect()
    return {r.node: r.bytes for r in found}, {r.node: [max(0.0, r[n]) for n, _ in dims] for r in found}


def kd_leaves(units: DataFrame, shards: int | None, target_bytes: int | None, slack: float) -> DataFrame:
    """``units`` with ``node``, the number of its shard."""
    spark = units.sparkSession
    dims = [(n, t) for n, t in units.dtypes if n[0] == "d" and n[1:].isdigit()]
    rows = units.withColumn("node", F.lit(0))
    nodes, whole, most = {}, None, 0.0
    while True:
        size, width = _widths(rows)
        if not size:
            return rows
        if whole is None:  # the root
            whole = width[0]
            shards = shards or max(1, round(size[0] / target_bytes))
            nodes, most = {0: shards}, slack * size[0] / shards
        if all(n == 1 for n in nodes.values()):
            return rows
        splits, at = [], 0
        for node in sorted(size):
            k = nodes[node]
            shares = [w / r if r else 0.0 for w, r in zip(width[node], whole, strict=True)]
            cut = size[node] * (k // 2) // k if k > 1 else size[node] + 1
            splits.append((node, shares.index(max(shares)) if shares else 0, at, cut, k // 2))
            at += size[node]
        plan = F.broadcast(spark.createDataFrame(splits, "node int, dim int, node_start bigint, cut bigint, left int"))
        chosen = rows.join(plan, "node")
        # The value in the chosen dimension; a column for each type, of which one is set.
        number, text = (F.coalesce(*[F.when(F.col("dim") == k, F.col(n)) for k, (n, t) in enumerate(dims) if t == kind], F.lit(None).cast(kind)) for kind in ("double", "string"))
        placed = sums_before(chosen.withColumn("number", number).withColumn("name", text), ["node", "number", "name", "digest", "id", "row"], "size")
        place = F.col("before") - F.col("node_start") + F.expr("size div 2")
        placed = placed.withColumn("right", place >= F.col("cut"))
        moved = _whole_groups(placed, most)
        if moved:
            table = F.broadcast(spark.createDataFrame(moved, "node int, digest binary, to_right boolean"))
            placed = placed.join(table, ["node", "digest"], "left").withColumn("right", F.coalesce("to_right", "right")).drop("to_right")
        node = F.when(F.col("right"), F.col("node") + F.col("left")).otherwise(F.col("node")).cast("int")
        rows = placed.withColumn("node", node).select(*units.columns, "node")
        nodes = {child: n for node, k in nodes.items() for child, n in ([(node, k // 2), (node + k // 2, k - k // 2)] if k > 1 else [(node, k)])}


def _whole_groups(placed: DataFrame, most: float) -> list[tuple[int, bytearray, bool]]:
    """(node, digest, to the right) of groups that a median divides and that can be whole: one row for each node at most."""
    last, first = F.when(~F.col("right"), F.col("before")), F.when(F.col("right"), F.col("before"))
    ends = placed.groupBy("node").agg(F.max_by("digest", last).alias("digest"), F.min_by("digest", first).alias("next")).where("digest = next").select("node", "digest")
    found = F.broadcast(placed.sparkSession.createDataFrame(ends.collect(), "node int, digest binary"))
    sides = placed.join(found, ["node", "digest"]).groupBy("node", "digest").agg(F.sum(F.when(F.col("right"), F.col("size")).otherwise(0)).alias("there"), F.sum(F.when(F.col("right"), 0).otherwise(F.col("size"))).alias("here")).collect()
    return [(r.node, r.digest, r.there >= r.here) for r in sides if min(r.here, r.there) <= most]


def kd_shards(docs: DataFrame, dims: list[str | Column], *, shards: int | None = None, target_bytes: int | None = None, slack: float = 0.01, id_col: str = "doc_id", text_col: str = "text", row: Column | None = None) -> DataFrame:
    """(row, id, size, text_crc32, shard, slot) of every document: ``shards`` of near equal bytes, or as many as ``target_bytes`` asks for.

    ``row`` is a unique number of the row, by default one of its own. Slots follow the ids.
    """
    if (shards is None) == (target_bytes is None):
        raise ValueError("give either shards or target_bytes")
    units = metadata(docs, dims, id_col, text_col, row if row is not None else F.monotonically_increasing_id())
    leaves = kd_leaves(units, shards, target_bytes, slack).select("row", "id", "size", "text_crc32", F.col("node").alias("shard"), F.lit(1).cast("long").alias("one"))
    counted = sums_before(leaves, ["shard", "id", "row"], "one")
    first = F.broadcast(stored(counted.groupBy("shard").agg(F.min("before").alias("first")), "starts"))  # one row for each shard
    return counted.join(first, "shard").select("row", "id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("before") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, dims: list[str | Column], **how) -> DataFrame:
    """Write ``docs`` as Parquet, a folder ``shard=k`` for each shard with its rows in the order of their slots; returns the table."""
    spark = docs.sparkSession
    numbered = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc")), "numbered")
    flat = numbered.select("row", "doc.*") if "row" not in docs.columns else numbered.select(F.col("row").alias("_row"), "doc.*")
    placed = kd_shards(flat, dims, row=F.col(flat.columns[0]), **how).select("row", F.col("shard").alias("to"), "slot")
    rows = numbered.join(placed, "row").repartitionByRange(shuffle_parts(spark), "to", "slot").sortWithinPartitions("to", "slot")
    rows.select(F.col("to").alias("shard"), "slot", "doc").write.partitionBy("shard").parquet(path)
    return spark.read.parquet(path)
