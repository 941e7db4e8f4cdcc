"""Fingerprints against a plain computation, and the properties of closed syncmers."""

import hashlib
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from tracelake.llm.queries import op2_syncmers
from tracelake.llm.syncmers import K, SIZE, S, anchor_rows, fingerprints

UNIT = re.compile(r"[^\x20\x09-\x0D]{1,16}")
MASK = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def of_longs(*values):
    """Spark's xxhash64 of bigint arguments: each hashes with the digest so far as its seed."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return signed(seed)


def anchors(text):
    units = [signed(xxhash.xxh64_intdigest(u.encode(), 42)) for u in UNIT.findall(text)]
    if not units:
        return []
    whole = [(0, of_longs(*units) & 0xFFFFFFFF)]
    if len(units) < K:
        return whole
    h = [of_longs(a, b) for a, b in zip(units, units[1:], strict=False)]
    out = []
    for i in range(len(units) - K + 1):
        inner = h[i : i + K - S + 1]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, of_longs(inner[0], inner[-1]) & 0xFFFFFFFF))
    return out or whole


def distinct(text):
    """All distinct digests of a text, and where each stands first."""
    first = {}
    for pos, d in anchors(text):
        first.setdefault(d, pos)
    return dict(sorted(first.items()))


def likeness(a, b):
    """The share of common anchors, of all of them."""
    return len(a.keys() & b.keys()) / len(a.keys() | b.keys()) if a or b else 1.0


def expected(rows):
    """(id, text) with distinct ids -> the query's rows."""
    rows = sorted(((k, t or "") for k, t in rows), reverse=True)
    out = {}
    for (k, text), (_, follow) in zip(rows, rows[1:] + rows[:1], strict=True):
        m = len(text) // 3
        edited = text[: len(text) - m] + follow[:m]
        s, e = distinct(text), distinct(edited)
        hexes = lambda x: "".join(f"{d:08x}" for d in list(x)[:SIZE])
        out[k] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), hexes(s), hexes(e), likeness(s, e), likeness(s, distinct(follow)))
    return out


COLUMNS = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def test_query_equals_plain_computation(spark, sf_dir, texts):
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in op2_syncmers(spark, sf_dir).collect()}
    want = expected(texts.items())
    assert got.keys() == want.keys()
    for k, row in want.items():
        assert got[k] == pytest.approx(row)


def test_few_rows_and_edges(spark):
    for rows in ([(4, "alone")], [(1, None), (2, "")], [(1, "a b c d e f g"), (5, "a b c d e f g"), (3, "x" * 100), (2, "é漢😀 " * 40)]):
        got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
        want = expected(rows)
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_anchors_do_not_depend_on_the_context(spark):
    passage = " ".join(f"w{i * i % 1009}" for i in range(60))
    rows = spark.createDataFrame([(1, f"before it {passage} after"), (2, f"{passage} something else")], "doc_id bigint, text string")
    found = {(r.doc_id, r.pos, r.digest) for r in anchor_rows(rows).collect()}
    inside = lambda k, at: {(p - at, d) for i, p, d in found if i == k and at <= p <= at + 60 - K}
    assert inside(1, 2) == inside(2, 0) and len(inside(2, 0)) > 20
    assert {(p, d) for k, p, d in found if k == 2} == set(anchors(f"{passage} something else"))


def test_equal_texts_and_partitions(docs):
    twice = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1_000_000))
    got = fingerprints(twice).groupBy((F.col("doc_id") % 1_000_000).alias("k")).agg(F.count_distinct("fingerprint").alias("n")).where("n > 1")
    assert got.count() == 0
    a = fingerprints(docs.repartition(9)).select("doc_id", *COLUMNS).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, fingerprints(docs.coalesce(1)).select("doc_id", *COLUMNS).collect()))


def test_messy(messy, none):
    rows = fingerprints(messy).collect()
    assert len(rows) == messy.count()
    assert all(r.fingerprint == "" and r.n_chars == 0 for r in rows if r.doc_id in (1, 2))
    assert fingerprints(none).count() == 0 and anchor_rows(none).count() == 0


def test_positions_of_the_fingerprint(spark, texts):
    rows = [(k, t) for k, t in texts.items() if t][:40]
    for r in fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        found = distinct(dict(rows)[r.doc_id])
        assert r.positions == list(found.values())[:SIZE] and r.fingerprint == "".join(f"{d:08x}" for d in list(found)[:SIZE])


def test_text_ids(spark):
    """Ids that are no numbers: the next document is the one before it in the order of texts."""
    rows = [(f"k{i:03d}", f"one two three four five six seven eight nine text {i} " * 3) for i in range(60)] + [(None, "no id")]
    got = {r.doc_id: r for r in fingerprints(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert len(got) == 61
    texts = dict(rows)
    for i in range(1, 60):
        text, after = texts[f"k{i:03d}"], texts[f"k{i - 1:03d}"]
        third = len(text) // 3
        assert got[f"k{i:03d}"].edited_sha256 == hashlib.sha256((text[: len(text) - third] + after[:third]).encode()).hexdigest()
