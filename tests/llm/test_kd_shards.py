"""K-d shards: sizes, slots, groups, and the tree against a walk in one process."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tracelake.llm.kd_shards import kd_shards, sums_before, write_shards
from tracelake.llm.queries import op11_kd_shards

DIMS = ["source", "n_chars"]


def check(rows, ids, shards):
    """rows (id, size, shard, slot): every id once, slots gapless and in the order of ids."""
    assert Counter(r.id for r in rows) == Counter(list(ids))
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append((r.slot, r.id))
    assert all([s for s, _ in sorted(x)] == list(range(len(x))) for x in slots.values())
    assert all([k for _, k in sorted(x)] == sorted((k for _, k in x), key=lambda k: (k is not None, k)) for x in slots.values())
    assert set(slots) <= set(range(shards))


@pytest.mark.parametrize("table", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query(spark, table):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{table}/documents.parquet").collect()}
    got = op11_kd_shards(spark, table).withColumnRenamed("doc_id", "id").collect()
    check(got, docs, 40)
    sizes, largest = Counter(), max(len((t or "").encode()) + 16 for t in docs.values())
    for r in got:
        raw = (docs[r.id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        sizes[r.shard] += r.size
    mean = sum(sizes.values()) / 40
    assert len(sizes) == 40 and max(sizes.values()) <= 1.1 * mean + largest


def test_many_small_documents_are_near_equal_and_groups_stay_whole(spark):
    rows = [(i, f"text {i % 1500} " + "w" * (i % 1500 % 7), f"s{i % 5}", i % 1500 % 13) for i in range(3000)]
    rows += [(10_000 + i, "copied " * 3, "s1", 21) for i in range(1500)]  # a third of all rows
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint").repartition(7)
    got = kd_shards(docs, DIMS, shards=12).collect()
    check(got, [r[0] for r in rows], 12)
    sizes, shards_of, text = Counter(), defaultdict(set), {r[0]: r[1] for r in rows}
    for r in got:
        sizes[r.shard] += r.size
        shards_of[text[r.id]].add(r.shard)
    mean = sum(sizes.values()) / 12
    assert max(abs(s - mean) for s in sizes.values()) < 0.05 * mean
    divided = [t for t, s in shards_of.items() if len(s) > 1]
    assert divided == ["copied copied copied "]  # though copies lie in other sources


def test_tree_equals_a_walk(spark):
    rows = [(i, "x" * (i * 37 % 91), f"s{i * i % 11}", i * 53 % 97) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint")
    text_of = {}
    for i, t, s, n in rows:  # equal texts take the metadata of the first
        text_of.setdefault(t, (s, n))
    items = [(len(t) + 16, text_of[t][0], float(text_of[t][1]), hash_of(t), i) for i, t, *_ in rows]
    names, span = len({x[1] for x in items}) - 1, max(x[2] for x in items) - min(x[2] for x in items)
    out = {}

    def walk(part, first, k):
        if k == 1:
            out.update({x[4]: first for x in part})
            return
        wide = [(len({x[1] for x in part}) - 1) / names, (max(x[2] for x in part) - min(x[2] for x in part)) / span]
        d = wide.index(max(wide))
        part = sorted(part, key=lambda x: (x[1 + d], x[3], x[4]))
        total, at = sum(x[0] for x in part), 0
        sides = ([], [])
        for x in part:
            sides[at + x[0] // 2 >= total * (k // 2) // k].append(x)
            at += x[0]
        walk(sides[0], first, k // 2)
        walk(sides[1], first + k // 2, k - k // 2)

    walk(items, 0, 9)
    got = kd_shards(docs, DIMS, shards=9, slack=-1.0)  # no median is moved
    assert {r.id: r.shard for r in got.collect()} == out


def hash_of(text):
    import hashlib

    return hashlib.md5(text.encode()).digest()


def test_target_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * 84, "s", i) for i in range(100)], "doc_id bigint, text string, source string, n_chars bigint")
    assert Counter(r.shard for r in kd_shards(docs, DIMS, target_bytes=2000).collect()) == {k: 20 for k in range(5)}
    with pytest.raises(ValueError):
        kd_shards(docs, DIMS)


def test_sums_before(spark):
    rows = spark.createDataFrame([(i * 7 % 50, i) for i in range(50)], "k int, w bigint")
    at = 0
    for r in sorted(sums_before(rows, ["k"], "w").collect(), key=lambda r: r.k):
        assert r.before == at
        at += r.w


def test_messy_empty_and_written(spark, messy, none, tmp_path):
    ids = [r.doc_id for r in messy.collect()]
    check(kd_shards(messy, ["source", "n_chars", F.col("kept")], shards=3).collect(), ids, 3)
    assert kd_shards(none, DIMS, shards=40).count() == 0
    table = write_shards(messy, str(tmp_path / "shards"), DIMS, shards=3)
    assert sorted(map(repr, (r.doc for r in table.collect()))) == sorted(map(repr, messy.collect()))
    assert table.groupBy("shard").agg((F.max("slot") + 1 == F.count(F.lit(1))).alias("gapless")).where("not gapless").count() == 0
