"""LM scoring: the base against plain counts, the model's normalisation and its held-out gain."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tracelake.llm import log_bilinear as lb
from tracelake.llm.queries import op4_log_bilinear

LOWER = {c: c + 32 for c in range(65, 91)}


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def held(k):
    return zlib.crc32(str(k).encode()) % 7 == 2


@pytest.fixture(scope="module")
def scored(spark, sf_dir):
    return op4_log_bilinear(spark, sf_dir).collect()


def test_base_equals_plain_counts(scored, texts):
    counts = Counter(w for k, t in texts.items() if not held(k) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in scored}
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        r, own = got[k], tokens(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(k), len(own), sum(counts[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + 1 * (v + 1))) for w in own), rel=1e-9)


def test_model_beats_the_base_on_held_out_texts(scored):
    out = [r for r in scored if r.held_out]
    n = sum(r.n_tokens for r in out)
    assert len(out) > 10 and all(math.isfinite(r.score) and r.score < 0 for r in scored)
    assert sum(r.score for r in out) / n > sum(r.base_score for r in out) / n


def test_probabilities_add_up():
    draw = np.random.default_rng(0)
    model = lb.LogBilinear(np.array([50.0, 30, 15, 5]))
    contexts = draw.integers(0, 5, (20, lb.CONTEXT))
    total = sum(np.exp(model.log_probability(contexts, np.full(20, w))) for w in range(4))
    assert np.allclose(total, 1, atol=1e-5)


def test_training_learns_a_pattern():
    draw = np.random.default_rng(0)
    ids = [np.tile([0, 1, 2, 3], 500)]
    model, state = lb.LogBilinear(np.array([1.0, 1, 1, 1])), {}
    contexts, targets = lb.windows(ids, 4)
    before = model.log_probability(contexts, targets).mean()
    for _ in range(60):
        model.train(contexts, targets, draw, state)
    assert before < -1.2 and model.log_probability(contexts, targets).mean() > -0.4
    again = lb.LogBilinear(np.array([1.0, 1, 1, 1]), seed=9).load(model.parameters())
    assert np.allclose(again.log_probability(contexts, targets), model.log_probability(contexts, targets))


def test_rare_tokens_count_over_all_documents(docs, texts, monkeypatch):
    """Tokens beyond the table that tasks hold get their counts by a join."""
    monkeypatch.setattr(lb, "FREQUENT", 40)
    monkeypatch.setattr(lb, "SHORTLIST", 20)
    counts = Counter(w for k, t in texts.items() if not held(k) for w in tokens(t))
    for r in lb.lm_scores(docs).collect():
        assert r.n_known == sum(counts[w] > 0 for w in tokens(texts[r.doc_id]))
        assert math.isfinite(r.score)


def test_vocabulary_grows_with_the_counts(spark, monkeypatch):
    """Words beyond the upper level, and tokens beyond the table, are scored by what stands before them."""
    monkeypatch.setattr(lb, "FREQUENT", 80)
    monkeypatch.setattr(lb, "SHORTLIST", 4)
    pairs = [(f"{x}{i}", f"{y}{i}") for x, y in (("a", "b"), ("c", "d")) for i in range(30)]
    rows = [(k, " ".join(w for j in range(40) for w in pairs[(k * 7 + j * j) % 60])) for k in range(1500)]
    rows += [(5000 + i, f"rare{i}") for i in range(900)]
    rows += [(9000, " ".join(w for p in pairs for w in p)), (9001, " ".join(w for p, q in zip(pairs, pairs[30:] + pairs[:30], strict=True) for w in (p[0], q[1])))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(2)
    got = {r.doc_id: r for r in lb.lm_scores(docs).where("doc_id >= 9000").collect()}
    assert got[9000].base_score == pytest.approx(got[9001].base_score)
    assert got[9000].score > got[9001].score + 10


def test_probabilities_over_groups_and_buckets_add_up(monkeypatch):
    monkeypatch.setattr(lb, "SHORTLIST", 5)
    frequent = [(f"w{i}".encode(), 100 - i) for i in range(40)]
    v = lb.Vocabulary(frequent, np.array([[7.0, 3], [0, 0], [2, 2]]))
    assert sorted([*v.known.values(), *v.bucket]) == list(range(43)) and len(v.offsets) > 3
    assert [v.unigram[v.known[w]] for w, _ in frequent] == [n for _, n in frequent]
    model, draw = lb.LogBilinear(v.unigram, offsets=v.offsets), np.random.default_rng(0)
    model.load_rows(model.rows() + draw.normal(0, 0.5, model.rows().shape))
    contexts = draw.integers(0, 44, (20, lb.CONTEXT))
    total = sum(np.exp(model.log_probability(contexts, np.full(20, w))) for w in range(43))
    assert np.allclose(total, 1, atol=1e-4)
    again = lb.LogBilinear(v.unigram, seed=9, offsets=v.offsets).load(model.parameters())
    targets = draw.integers(0, 43, 20)
    assert np.allclose(again.log_probability(contexts, targets), model.log_probability(contexts, targets))


def test_scores_do_not_depend_on_partitions(docs, monkeypatch):
    monkeypatch.setattr(lb, "SHARD", 50)
    one, eight = ({r.doc_id: r.score for r in lb.lm_scores(docs.repartition(k)).collect()} for k in (1, 8))
    assert one.keys() == eight.keys() and all(one[k] == pytest.approx(eight[k], rel=1e-6) for k in one)


def test_scores_equal_plain_softmax(docs, texts, monkeypatch):
    """Scores from the trained parameters: every distribution is summed up in full, one token after the other."""
    monkeypatch.setattr(lb, "FREQUENT", 300)
    monkeypatch.setattr(lb, "SHORTLIST", 60)
    kept, own = [], lb.trained
    monkeypatch.setattr(lb, "trained", lambda rows, vocabulary, **k: kept.append((own(rows, vocabulary, **k), vocabulary)) or kept[-1][0])
    got = {r.doc_id: r for r in lb.lm_scores(docs).collect()}
    model, v = kept[0]
    counts = Counter(w for k, t in texts.items() if not held(k) for w in lb.tokens_of(t))
    bucket = lambda w: v.bucket[zlib.crc32(w) % len(v.bucket)]
    sums = Counter()
    for w, n in counts.items():
        if w not in v.known:
            sums[bucket(w)] += n + 1
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    for k in sorted(texts)[:12]:
        words = lb.tokens_of(texts[k])[-120:] if len(lb.tokens_of(texts[k])) < 120 else lb.tokens_of(texts[k])
        ids, total = [v.known.get(w, None) if w in v.known else bucket(w) for w in words], 0.0
        for i, (w, x) in enumerate(zip(words, ids, strict=True)):
            before = [ids[i - 1 - j] if i - 1 - j >= 0 else len(v.unigram) for j in range(lb.CONTEXT)]
            h = sum(model.r[b].astype(float) * model.c[j] for j, b in enumerate(before))
            p = soft(model.q @ h + model.b)[model.top[x]]
            if x >= model.head:
                a, e = v.offsets[model.group[x - model.head] :][:2]
                p *= soft(model.qm[a:e] @ h + model.bm[a:e])[x - model.head - a]
            if w not in v.known:
                p *= (counts[w] + 1) / (sums[x] + 1)
            total += math.log10(p)
        assert got[k].score == pytest.approx(total, rel=1e-4)


def test_long_tokens_are_tokens(spark):
    """Tokens of any length can be frequent, and each is a token of its own."""
    long = ["x" * 70 + c for c in "ab"]
    rows = [(k, f"one {long[k % 2]} two") for k in range(400)]
    out = {r.doc_id: r for r in lb.lm_scores(spark.createDataFrame([*rows, (900, f"one {'x' * 70}c two")], "doc_id bigint, text string")).collect()}
    assert out[0].n_known == 4 and out[900].n_known == 3 and out[900].score < out[0].score - 1


def test_messy(messy, none, spark):
    rows = lb.lm_scores(messy).collect()
    assert len(rows) == messy.count()
    assert all(r.n_tokens == 1 and math.isfinite(r.score) for r in rows if r.doc_id in (1, 2, 4))
    assert lb.lm_scores(none).count() == 0
    alone = next(k for k in range(100) if held(k))
    r = lb.lm_scores(spark.createDataFrame([(alone, "only held out")], "doc_id bigint, text string")).first()
    assert r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score)


def test_tokens_of_many_texts_at_once():
    """All texts of a batch are split together, each as a walk over its own bytes would."""
    draw = np.random.default_rng(4)
    letters = np.array(list(" \t\n\x0b\x0c\r\x1c\x85 \0aAZzÀß漢😀.-"))
    texts = [None, "", " ", " a", "a ", "A\x1cb c", "X" * 70 + " B", *("".join(draw.choice(letters, draw.integers(0, 60))) for _ in range(500))]
    n, words = lb.split_tokens(pa.array(texts, pa.string()).slice(1))
    words, ends = words.to_pylist(), np.cumsum(n)
    for text, a, b in zip(texts[1:], ends - n, ends, strict=True):
        own = [*(w.encode() for w in tokens(text)[:-1]), b""]
        assert [len(w) > lb.LONGEST or w == x for w, x in zip(own, words[a:b], strict=True)] == [True] * len(own)
        assert words[a:b] == lb.tokens_of(text)


def test_sums_by_row():
    draw = np.random.default_rng(5)
    for width in (lb.DIM, lb.DIM + 1):
        rows, values, times = draw.integers(0, 50, 3000), draw.normal(size=(3000, width)).astype(np.float32), draw.integers(1, 4, 3000)
        found, sums, met = lb.sums_by_row(rows, values, 80, times)
        assert found.tolist() == sorted(set(rows.tolist())) and met.tolist() == [times[rows == r].sum() for r in found]
        assert np.allclose(sums[:, :width], [values[rows == r].sum(0) for r in found], atol=1e-4)


def test_words_that_end_alike_share_a_group():
    """Most groups hold words of one ending, and buckets have groups of their own."""
    ends = ["tion", "ung", "eur", "ado"]
    frequent = [(f"{i:05d}{ends[i * i % 7 % 4]}".encode(), 40_000 // (i + 10) + 1) for i in range(12_000)]
    v = lb.Vocabulary(frequent, np.full((200, 2), [9.0, 3]))
    group = np.repeat(np.arange(len(v.offsets) - 1), np.diff(v.offsets))
    words = {w: group[i - lb.SHORTLIST] for w, i in v.known.items() if i >= lb.SHORTLIST}
    alone = {g for g in set(words.values()) if len({w[5:] for w, x in words.items() if x == g}) == 1}
    assert len(alone) > 0.7 * len(set(words.values())) and not {group[i - lb.SHORTLIST] for i in v.bucket} & set(words.values())


def test_runs_train_as_tokens_with_their_contexts():
    """A mini-batch of runs moves the parameters as the same tokens do with a context each."""
    draw, offsets = np.random.default_rng(6), np.array([0, 4, 9])
    n = draw.integers(1, 50, 8)
    ids = draw.integers(0, 20, n.sum())
    runs = lb.runs_of(ids, n, 20)
    contexts, targets = lb.windows(np.split(ids, np.cumsum(n)[:-1]), 20)
    kept = runs[:, lb.CONTEXT :] != 20
    assert runs.shape[1] == lb.CONTEXT + lb.RUN and runs[:, lb.CONTEXT :][kept].tolist() == ids.tolist()
    found = []
    for step in ((runs,), (contexts, targets)):
        model, state, draw = lb.LogBilinear(np.arange(1.0, 21), offsets=offsets), {}, np.random.default_rng(1)
        for _ in range(3):
            (model.train_runs if len(step) == 1 else model.train)(*step, draw, state)
        found.append((model.parameters(), state["met_r"], state["met_qm"]))
    assert all(np.allclose(a, b, atol=1e-4) for a, b in zip(*found, strict=True)) and found[0][1].sum() == lb.CONTEXT * 3 * len(ids)


def test_sums_of_far_logits():
    draw = np.random.default_rng(7)
    h, q = draw.normal(size=(700, lb.DIM)).astype(np.float32), draw.normal(size=(9, lb.DIM + 1)).astype(np.float32)
    h[::3] *= 60
    q[:, -1] -= 90
    chosen = draw.integers(0, 9, 700)
    logits = lb.with_ones(h).astype(float) @ q.T
    most = logits.max(1)
    plain = logits[np.arange(700), chosen] - most - np.log(np.exp(logits - most[:, None]).sum(1))
    assert np.allclose(lb.log_sums(lb.with_ones(h), q, chosen), plain, rtol=1e-4, atol=1e-4)
