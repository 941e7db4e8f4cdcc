"""Near-duplicate groups against all pairs of full sets."""

import random
import re

import numpy as np
import pytest

from tracelake.llm import near_dedup as nd
from tracelake.llm.components import connected_components
from tracelake.llm.queries import op9_near_dedup

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def groups(rows, k, threshold):
    """id -> (set size, smallest id reachable)."""
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= threshold * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= threshold * (len(x) + len(y) - both):
                    p, q = sorted((root(a), root(b)))
                    parent[q] = p
    return {i: (len(s), root(i)) for i, s in sets.items()}


def found(df):
    return {r.doc: (r.n_shingles, r.component_id) for r in df.collect()}


def test_query_equals_all_pairs(spark, sf_dir, texts):
    got = {r.doc_id: r for r in op9_near_dedup(spark, sf_dir).collect()}
    want = groups(list(texts.items()), 3, 85)
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == want
    assert all(r.kept == (r.component_id == k) for k, r in got.items())


def test_a_text_of_one_shingle_meets_longer_ones(spark):
    """A text of exactly k words has the shingle that a longer run of them has."""
    rows = [(1, "a a a"), (2, "a a a a a"), (3, "b b"), (4, "b b b"), (5, "A A A")]
    assert found(nd.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), words=3, threshold=85)) == groups(rows, 3, 85)


def test_pipeline_parameters_equal_all_pairs(docs, texts):
    assert found(nd.near_groups(docs)) == groups(list(texts.items()), 5, 80)


@pytest.fixture(scope="module")
def chains():
    """Families whose members drift: neighbours are alike, ends are not; ids are in random order."""
    draw = random.Random(4)
    rows, ids = [], random.Random(5).sample(range(10_000), 900)
    for _ in range(12):
        words = [f"w{draw.randrange(5000)}" for _ in range(120)]
        for _ in range(60):
            rows.append((ids.pop(), " ".join(words)))
            for _ in range(draw.randrange(1, 4)):
                words[draw.randrange(len(words))] = f"w{draw.randrange(5000)}"
    for _ in range(100):
        rows.append((ids.pop(), " ".join(f"x{draw.randrange(5000)}" for _ in range(draw.randrange(1, 60)))))
    return rows


@pytest.mark.parametrize(("k", "threshold"), [(3, 85), (5, 80)])
def test_drifting_families(spark, chains, k, threshold):
    df = spark.createDataFrame(chains, "doc_id bigint, text string")
    assert found(nd.near_groups(df, words=k, threshold=threshold)) == groups(chains, k, threshold)


def test_chunks_and_salts_lose_nothing(spark, chains, monkeypatch):
    """A bucket that holds more than a task's share is dealt out to several tasks."""
    monkeypatch.setattr(nd, "OUTSIDE", 3)
    monkeypatch.setattr(nd, "STREAM", 5)
    df = spark.createDataFrame(chains, "doc_id bigint, text string")
    assert found(nd.near_groups(df, words=3, threshold=85)) == groups(chains, 3, 85)


def test_registers_merge_and_estimate():
    draw = np.random.default_rng(3)
    for share in (0.3, 0.6, 0.8, 0.9, 1.0):
        n = 4000
        common = draw.integers(0, 2**63, int(n * share), dtype=np.uint64)
        a = np.unique(np.concatenate([common, draw.integers(0, 2**63, n - len(common), dtype=np.uint64)]))
        b = np.unique(np.concatenate([common, draw.integers(0, 2**63, n - len(common), dtype=np.uint64)]))
        u, v = nd.registers(a), nd.registers(b)
        assert np.array_equal(np.maximum(u, v), nd.registers(np.union1d(a, b)))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        got = nd.likely_similarity(u[None], v[None], np.array([float(len(a))]), np.array([float(len(b))]))[0]
        assert abs(got - true) < 4 * (true * (1 - true) / nd.M) ** 0.5 + 0.011


def test_bounds_keep_every_link():
    draw = np.random.default_rng(8)
    for n in (20, 150, 192, 400, 3000):
        for _ in range(40):
            fresh = lambda k: draw.integers(0, 2**63, k, dtype=np.uint64)
            k = int(n * 0.08)
            common = fresh(n - k)
            a, b = np.unique(np.concatenate([common, fresh(k)])), np.unique(np.concatenate([common, fresh(k)]))
            low = lambda s: np.unique(s.astype("<u4"))[: nd.LOW].tobytes()
            true = (n - k) / (n + k)
            least = int(100 * true)
            assert nd._close(low(a), low(b), len(a), len(b), least)
            assert not nd._close(low(a), low(fresh(n)), len(a), n, least)
            u, v, sizes = nd.registers(a)[None], nd.registers(b)[None], (np.array([float(len(a))]), np.array([float(len(b))]))
            at = nd.likely_similarity(u, v, *sizes)[0]
            assert nd.reaches(u, v, *sizes, at - 0.01)[0] and not nd.reaches(u, v, *sizes, at + 0.01)[0]


def test_components(spark):
    draw = random.Random(1)
    edges = [(a, a + 1) for a in range(100, 160)] + [(500, x) for x in range(501, 560)] + [(draw.randrange(1000, 1100), draw.randrange(1000, 1100)) for _ in range(60)] + [(7, 7)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = sorted((root(a), root(b)))
        parent[q] = p
    assert got == {x: root(x) for x in parent if x != 7}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_messy(messy, none):
    rows = nd.near_groups(messy, words=3, threshold=85).collect()
    assert len(rows) == messy.count()
    by = {r.doc: r for r in rows if r.doc is not None}
    assert [by[i].n_shingles for i in (1, 2, 4)] == [0, 0, 0] and all(by[i].component_id == i for i in (1, 2, 4))
    assert all(r.component_id is None for r in rows if r.doc is None)
    kept = nd.near_dedup(messy, words=3, threshold=85)
    assert kept.columns == messy.columns
    assert kept.where("doc_id = 20").count() == 2 and kept.where("doc_id is null").count() == 2
    assert nd.near_dedup(none).count() == 0 and nd.near_groups(none).count() == 0


def test_equal_and_short_texts(spark):
    rows = [(5, "one two"), (3, "ONE  two\n"), (4, "one"), (9, "one two three"), (8, "one two three"), (1, "two one")]
    assert found(nd.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), words=3, threshold=85)) == groups(rows, 3, 85)
