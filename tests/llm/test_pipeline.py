"""The corpus pipeline: each stage against its own input by a plain computation."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tests.llm.test_line_dedup import walked
from tests.llm.test_near_dedup import groups
from tests.llm.test_source_mixing import words
from tracelake.llm.common import stored
from tracelake.llm.quality_rules import quality_features


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """The input of each stage and the last one's result."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in cp.STAGES:
        out.append(docs)
        docs = stored(stage(spark, docs, sf_dir), f"test-{name}")
    return [*out, docs]


def rows(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_contract(stages, spark, sf_dir):
    assert 4 <= len(cp.STAGES) <= 5
    assert all(s.columns == cp.COLUMNS and dict(s.dtypes) == dict(stages[0].dtypes) for s in stages[:5])
    assert sorted(map(str, cp.run(spark, sf_dir).collect())) == sorted(map(str, stages[5].collect()))


def test_quality(stages):
    kept = {r.doc_id for r in quality_features(stages[0]).where("kept").collect()}
    assert rows(stages[1]) == {k: t for k, t in rows(stages[0]).items() if k in kept} and 0 < len(kept) < stages[0].count()


def test_lines(stages):
    assert rows(stages[2]) == {k: t for k, (_, _, t) in walked(list(rows(stages[1]).items())).items()}
    assert all(r.n_chars == len(r.text) for r in stages[2].collect())


def test_near(stages):
    before = rows(stages[2])
    assert rows(stages[3]) == {k: before[k] for k, (_, c) in groups(list(before.items()), 5, 80).items() if c == k}


def test_mixing(stages):
    before, after = stages[3].collect(), stages[4].collect()
    assert {(r.doc_id, r.text) for r in after} <= {(r.doc_id, r.text) for r in before}
    assert max(Counter(r.doc_id for r in after).values()) <= 5
    tokens = defaultdict(int)
    for r in after:
        tokens[r.source] += words(r.text)
    total = sum(words(r.text) for r in before)
    assert 0.9 * total < sum(tokens.values()) <= total
    assert {r.source for r in after} == {r.source for r in before}


def test_tokens(stages):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in stages[4].collect():
        ids = np.array(t.encode(r.text or "", add_special_tokens=False).ids, "<u4").tobytes()
        want.append((r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), True))
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.round_trip) for r in stages[5].collect()) == sorted(want)


def test_messy(spark, messy, none, sf_dir):
    for start in (messy.select(*cp.COLUMNS), none.select(*cp.COLUMNS), messy):
        docs = start
        for name, stage in cp.STAGES:
            docs = stored(stage(spark, docs, sf_dir), f"test-{name}")
        assert docs.where("not round_trip").count() == 0
