"""Line dedup against SQL and against a plain walk over the lines."""

import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import SPACE
from tracelake.llm.line_dedup import keep_bitmaps, line_dedup
from tracelake.llm.oracle import ORACLE
from tracelake.llm.queries import op8_line_dedup

LOWER = {c: c + 32 for c in range(65, 91)}


def walked(rows, min_chars=40, min_docs=5):
    """id -> (n_lines, n_dropped, text) for rows (id, text) with distinct ids."""
    key = lambda line: line.strip(SPACE).translate(LOWER)
    holds = defaultdict(set)
    for k, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holds[key(line)].add(k)
    out = {}
    for k, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holds.get(key(x), ())) < min_docs or max(holds[key(x)]) == k]
        out[k] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_query_equals_sql_and_walk(spark, sf_dir, duck, texts):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in op8_line_dedup(spark, sf_dir).collect()}
    assert got == {r[0]: r[1:] for r in duck.execute(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({ORACLE['op8_line_dedup']})").fetchall()}
    assert got == {k: (n, d, hashlib.sha256(t.encode()).hexdigest()) for k, (n, d, t) in walked(list(texts.items())).items()}


LINES = ["short", "", "A line of forty characters or more, in two cases", "a line of FORTY characters or more, in two cases  ", "\tanother line that is long enough to be a key", "ünïcode line, long enough to be one of the keys 😀"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(LINES), max_size=6), max_size=9))
def test_any_lines(spark, some):
    rows = [(i, "\n".join(x) if x else None) for i, x in enumerate(some)]
    got = line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), min_docs=2).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in got} == walked(rows, min_docs=2)


def test_bitmaps_are_runs(spark):
    drops = spark.createDataFrame([(1, p) for p in (0, 1, 2, 5, 7, 8)] + [(2, 4), (2, 4)], "doc bigint, pos int")
    got = {r.doc: (r.n_dropped, [tuple(x) for x in r.dropped_runs]) for r in keep_bitmaps(drops).collect()}
    assert got == {1: (6, [(0, 3), (5, 1), (7, 2)]), 2: (1, [(4, 1)])}


def test_messy(messy, none):
    got = line_dedup(messy)
    assert set(messy.columns) <= set(got.columns)
    rows = got.collect()
    assert len(rows) == messy.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[1].text == "" and by[1].n_lines == 1
    assert by[16].n_dropped == 0 and all(by[10 + i].n_dropped == 2 for i in range(6))
    assert by[12].text == "own line number 2\n"
    assert sorted(r.n_dropped for r in rows if r.doc_id is None) == [0, 0]
    assert by[5].h == "h" and by[5].hub == 1
    assert line_dedup(none).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_partitions_do_not_matter(docs, parts):
    a = line_dedup(docs.repartition(parts, F.col("lang"))).select("doc_id", "text").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, line_dedup(docs).select("doc_id", "text").collect()))
