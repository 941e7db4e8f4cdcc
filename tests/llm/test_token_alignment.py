"""Token alignment: the query against plain loops over both libraries' tokens, odd texts, hot ids, messy rows."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tracelake.llm.queries import op13_token_alignment
from tracelake.llm.token_alignment import Aligner, align_tokens, buckets_of, pack, pair_counts, unpack

REST = [*range(33), *range(127, 161), 173]
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=B)


def first_bytes(token):
    """Bytes of a token of the first vocabulary: its printable characters stand for themselves, the rest from 256 on."""
    return bytes(ord(c) if ord(c) < 256 else REST[ord(c) - 256] for c in token)


def second_bytes(piece):
    return bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode()


def spans(parts):
    at, out = 0, []
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def plain(libraries, text):
    """n_a, n_b, n_groups, digest and the linked pairs with their number."""
    first, second = libraries
    if not text:
        return 0, 0, 0, "", Counter()
    found = first.encode(f" {text}", add_special_tokens=False)
    pieces = second.encode(text, out_type=str)
    ids, first_ids = second.encode(text), found.ids
    left, right = [first_bytes(t) for t in found.tokens], [second_bytes(p) for p in pieces]
    whole = f" {text}".encode()
    if b"".join(left) != whole or b"".join(right) != whole:
        return 0, 0, 0, "", Counter()
    left, right = spans(left), spans(right)
    cuts = sorted({e for _, e in left} & {e for _, e in right})
    groups, links, i, j = [], Counter(), 0, 0
    for cut in cuts:
        some_a, some_b = [], []
        while i < len(left) and left[i][1] <= cut:
            some_a.append(i)
            i += 1
        while j < len(right) and right[j][1] <= cut:
            some_b.append(j)
            j += 1
        groups.append(",".join(str(first_ids[x]) for x in some_a) + "|" + ",".join(str(ids[x]) for x in some_b))
        for x in some_a:
            for y in some_b:
                if left[x][0] < right[y][1] and right[y][0] < left[x][1]:
                    links[first_ids[x], ids[y]] += 1
    return len(left), len(right), len(cuts), hashlib.sha256(";".join(groups).encode()).hexdigest(), links


def expected(libraries, rows):
    """Sorted result rows of (id, text) pairs."""
    laid = [(k, *plain(libraries, t)) for k, t in rows]
    counts = Counter(pair for *_, links in laid for pair in links)
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    out = []
    for k, n_a, n_b, n_groups, digest, links in laid:
        best = sum(n for pair, n in links.items() if counts[pair] == most[pair[0]])
        out.append((k, n_a, n_b, n_groups, sum(links.values()), best, sum(n * counts[p] for p, n in links.items()), digest))
    return sorted(out, key=repr)


def test_query_equals_plain_loops(spark, sf_dir, texts, libraries):
    rows = sorted((tuple(r) for r in op13_token_alignment(spark, sf_dir).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr)
    assert rows == expected(libraries, list(texts.items())) and sum(r[4] for r in rows) > 100_000


PARTS = ["a", "The", " ", "  ", "\n", "\n\n", "\t", "é", "漢字", "😀", "▁", "<s>", "</s>", "<unk>", "<|endoftext|>", "<0x0A>", "'s", "don't", "123", "!!", " ", "　", "\u0085", "\x1c", "\0", "\r\n", "ﬁ", "²", "́", "​", "﻿", "Überraschung", " x"]


def test_odd_texts(libraries):
    random.seed(11)
    some = ["".join(random.choice(PARTS) for _ in range(random.randint(1, 12))) for _ in range(1500)]
    some += [*PARTS, "", "x" * 3000, "word " * 500, "\n" * 40, " " * 40]
    stats, said, pair, doc, times = Aligner(A, B).block(some)
    links = defaultdict(dict)
    for p, d, n in zip(pair.tolist(), doc.tolist(), times.tolist(), strict=True):
        links[d][divmod(p, 32000)] = n
    for k, text in enumerate(some):
        n_a, n_b, n_groups, digest, want = plain(libraries, text)
        assert (*stats[k].tolist(), said[k], links[k]) == (n_a, n_b, n_groups, sum(want.values()), digest, dict(want)), repr(text)


def test_cache_may_be_cleared_at_any_time(monkeypatch, texts):
    some = [t or "" for t in list(texts.values())[:60]]
    whole = Aligner(A, B).block(some)
    monkeypatch.setattr("tracelake.llm.token_alignment.CACHE_ENTRIES", 10)
    small = Aligner(A, B)
    said = [x for i in range(0, 60, 7) for x in small.block(some[i : i + 7])[1]]
    assert said == whole[1]


def test_postings_survive_packing():
    pair, doc, times = np.array([3, 3, 2**40, 2**40 + 1]), np.array([0, 70_000, 5, 5]), np.array([1, 300, 2, 1])
    pairs, n, docs, found = unpack(pack(pair, doc, times))
    assert (pairs.tolist(), n.tolist(), docs.tolist(), found.tolist()) == ([3, 2**40, 2**40 + 1], [2, 1, 1], doc.tolist(), times.tolist())
    assert [len(x) for x in unpack(pack(pair[:0], doc[:0], times[:0]))] == [0, 0, 0, 0]


def test_hot_ids_have_cells_of_their_own():
    firsts, first_cell, cells = buckets_of([1, 5, 9, 12], [10, 1000, 10, 10], [5, 5, 5, 5], 16)
    assert firsts == [0, 5, 9, 12] and cells[1] > 2 * cells[0] and first_cell == [sum(cells[:k]) for k in range(4)]
    assert buckets_of([], [], [], 8) == ([0], [0], [1])


def test_a_hot_word_and_repeated_rows(spark, libraries):
    rows = [(i % 50, "the the the naïve") for i in range(200)] + [(1000 + i, f"own words {i} 漢{i}") for i in range(40)]
    got = align_tokens(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(9), A, B)
    assert sorted((tuple(r) for r in got.select("doc", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr) == expected(libraries, rows)


def test_pairs_are_an_output(spark, libraries):
    rows = [(1, "a naïve text"), (2, "a naïve text"), (3, "a text")]
    counts = Counter(p for _, t in rows for p in plain(libraries, t)[4])
    got = pair_counts(spark.createDataFrame(rows, "doc_id bigint, text string"), A, B).collect()
    assert {(r.a, r.b): r.n for r in got} == counts and all(r.best == (r.n == max(n for (a, _), n in counts.items() if a == r.a)) for r in got)


def test_messy_and_empty_tables(messy, none, libraries):
    got = align_tokens(messy, A, B).select("doc", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected(libraries, [(r.doc_id, r.text) for r in messy.select("doc_id", "text").collect()])
    assert align_tokens(none, A, B).count() == 0
