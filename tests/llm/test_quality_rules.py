"""Quality rules against SQL and against plain counts."""

import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracelake.llm.oracle import ORACLE
from tracelake.llm.quality_rules import base_failed, bin_of, bin_top, quality_features, quality_rules, quantile_sketch, text_features, thresholds
from tracelake.llm.queries import op3_quality_rules

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {p for i, w in enumerate(windows) if n[w] > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_query_equals_sql(spark, sf_dir, duck):
    order = [*COUNTS, "base_failed", "kept"]
    got = {r.doc_id: tuple(r[c] for c in order) for r in op3_quality_rules(spark, sf_dir).collect()}
    want = {r[0]: r[1:] for r in duck.execute(f"SELECT doc_id, {', '.join(order)} FROM ({ORACLE['op3_quality_rules']})").fetchall()}
    assert got == want
    assert 0 < sum(not v[-1] for v in got.values()) < len(got)


def test_counts_equal_a_walk(docs, texts):
    got = {r.doc_id: tuple(r[c] for c in COUNTS) for r in text_features(docs).collect()}
    assert got == {k: counted(t) for k, t in texts.items()}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet=list("ab #\n\t é"), max_size=80), min_size=1, max_size=30))
def test_counts_of_any_text(spark, some):
    rows = spark.createDataFrame(list(enumerate(some)), "doc_id bigint, text string")
    got = {r.doc_id: tuple(r[c] for c in COUNTS) for r in text_features(rows).collect()}
    assert got == {i: counted(t) for i, t in enumerate(some)}


def test_bins_are_narrow_and_merge(spark):
    rows = spark.range(0, 5000).withColumn("c", bin_of(F.col("id"))).withColumn("top", bin_top(F.col("c")))
    found = rows.groupBy("c").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min("top").alias("top")).where("high < 4900").collect()
    assert all(r.top == r.high and r.high - r.low <= r.low / 16 for r in found)
    values = {"v": F.col("id")}
    whole = quantile_sketch(spark.range(1000), [], values)
    parts = quantile_sketch(spark.range(300), [], values).unionByName(quantile_sketch(spark.range(300, 1000), [], values)).groupBy("measure", "code").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


def test_clean_documents_stay(spark):
    clean = [(i, " ".join(f"word{(i * 31 + k * k) % 9973}" for k in range(60)), "en", "web") for i in range(200)]
    loud = [(1000 + i, " ".join(["buy!!!"] + [f"w{(i * 17 + k * k) % 9967}!!" for k in range(60)]), "en", "web") for i in range(3)]
    got = {r.doc_id: r.kept for r in quality_features(spark.createDataFrame(clean + loud, "doc_id bigint, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(200)) and not any(got[1000 + i] for i in range(3))


def test_a_source_full_of_junk(spark):
    """Fences follow each source's own texts; a source with much junk can't raise its own."""
    clean = lambda i, mark: " ".join(f"word{(i * 31 + k * k) % 9973}{mark if k % 6 == i % 3 else ''}" for k in range(60))
    rows = [(i, clean(i, ""), "en", f"s{i % 5}") for i in range(500)]
    rows += [(1000 + i, clean(i, "#"), "en", f"marked{i % 2}") for i in range(160)]  # sources whose clean texts have marks
    rows += [(2000 + i, clean(i, ""), "en", "hot") for i in range(300)] + [(3000 + i, " ".join(f"#$%{i}w{k}" for k in range(60)), "en", "hot") for i in range(250)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in quality_features(docs).collect()}
    assert not any(got[3000 + i] for i in range(250))
    assert all(kept for k, kept in got.items() if k < 3000)


def test_fences_follow_the_sources(docs):
    """No measure that varies has one fence for all; nearly every source has a word length of its own."""
    features = text_features(docs)
    found = thresholds(features, ["lang", "source"]).collect()
    assert len({r.fence_word_length for r in found}) > 1 and len({r.fence_repeats for r in found}) > 1
    kept = {r.doc_id for r in quality_features(docs).where("kept").collect()}
    base = {r.doc_id for r in base_failed(features).where("not base_failed").select("doc_id").collect()}
    assert kept <= base and len(kept) > 0.8 * len(base)


def test_messy(messy, none):
    rows = quality_features(messy).collect()
    assert len(rows) == messy.count()
    assert all(r.base_failed and not r.kept for r in rows if r.doc_id in (1, 2, 4) and r.n_words == 0)
    kept = quality_rules(messy)
    assert kept.columns == messy.columns
    found = {r.doc_id: r for r in kept.collect()}
    assert {10, 16, 20} <= found.keys() and not {1, 2, 4, 5} & found.keys()
    assert found[10].n_words == "x" and found[10].kept is True  # the columns of docs, not the operator's own
    assert kept.where("doc_id = 20").count() == 2
    assert quality_rules(none).count() == 0 and quality_features(none).count() == 0
