"""Source mixing: the weights, and the plan against a walk in hash order."""

import math
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm.queries import op1_source_mixing
from tracelake.llm.source_mixing import bisect_exponent, budgets, entropy, mix_sources, shuffle_hash, temperature_weights


def test_exponent_meets_the_entropy():
    tokens = np.array([9_000_000, 500_000, 400_000, 100_000])
    e = bisect_exponent(tokens, int(tokens.sum()), 0.9, 1e9)
    w = temperature_weights(tokens, e)
    assert 0 < e < 1 and entropy(w) == pytest.approx(0.9 * math.log(4), abs=1e-6) and w.sum() == pytest.approx(1)
    assert bisect_exponent(np.array([5, 5, 5]), 15, 0.9, 4) == 1.0
    assert bisect_exponent(np.array([5, 0]), 5, 0.9, 4) == 1.0


def test_exponent_meets_the_repetition_limit():
    tokens = np.array([10_000_000, 1000])
    w = temperature_weights(tokens, bisect_exponent(tokens, int(tokens.sum()), 0.9, 4.0))
    assert w[1] * tokens.sum() / 1000 == pytest.approx(4.0, rel=1e-6)


def test_budgets_add_up():
    w = np.array([0.5, 0.3333, 0.1667])
    assert budgets(np.array([1, 1, 1]), w, 1001).sum() == 1001
    assert np.abs(budgets(np.array([1, 1, 1]), w, 1001) - w * 1001).max() < 1


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_query_equals_a_walk(spark, sf_dir, docs):
    h = {r.doc_id: r.h for r in docs.select("doc_id", shuffle_hash(F.col("doc_id"), 17).alias("h")).collect()}
    sources = defaultdict(list)
    for r in docs.collect():
        sources[r.source].append((h[r.doc_id], r.doc_id, words(r.text)))
    names = sorted(sources, key=lambda s: (s is not None, s))
    tokens = np.array([sum(n for *_, n in sources[s]) for s in names])
    weights = temperature_weights(tokens, bisect_exponent(tokens, int(tokens.sum()), 0.9, 4.0))
    want = {}
    for s, budget, t in zip(names, budgets(tokens, weights, int(tokens.sum())), tokens, strict=True):
        passes, rest = (divmod(int(budget), int(t))) if t else (1, 0)
        used, open_ = 0, rest > 0
        for _, k, n in sorted(sources[s]):
            open_ = open_ and used + n <= rest
            used += n
            want[k] = passes + open_
    got = defaultdict(list)
    for r in op1_source_mixing(spark, sf_dir).collect():
        got[r.doc_id].append(r.epoch)
    assert {k: sorted(e) for k, e in got.items()} == {k: list(range(n)) for k, n in want.items() if n}


def test_shares_come_near_the_weights(spark):
    rows = [(i, "big" if i % 10 else "small", "a b c d e f g h i j") for i in range(20_000)]
    out = mix_sources(spark.createDataFrame(rows, "doc_id bigint, source string, text string"), entropy_share=0.95)
    found = {r.source: (r.t, r.w) for r in out.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.max("weight").alias("w")).collect()}
    total = sum(t for t, _ in found.values())
    assert total == pytest.approx(200_000, rel=0.001)
    assert all(t / total == pytest.approx(w, abs=0.001) for t, w in found.values())
    assert out.groupBy("epoch", "place").count().where("count > 1").count() == 0
    assert out.where("epoch = 0").select("block").distinct().count() == 1024


def test_messy(messy, none):
    out = mix_sources(messy)
    assert set(messy.columns) <= set(out.columns)
    rows = out.collect()
    assert {r.kept for r in rows} and all(r.n_tokens == words(r.text) for r in rows)
    assert {(r.source, r.epoch) for r in rows if r.doc_id == 2} <= {(None, 0)}
    assert mix_sources(none).count() == 0
