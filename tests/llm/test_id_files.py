"""Token-ID files: the coder's round trip and checks, the query against the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracelake.llm import id_files
from tracelake.llm.common import new_path
from tracelake.llm.id_coder import BLOCK, decode_segment, encode_segment
from tracelake.llm.queries import op7_id_coder

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 65535), st.integers(0, 5)), max_size=200), st.integers(1, 40))
def test_round_trip(some, times):
    ids = np.array(some * times, "<u4")
    assert np.array_equal(decode_segment(encode_segment(ids)), ids)


@pytest.mark.parametrize("n", [0, 1, BLOCK - 1, BLOCK, BLOCK + 1, 3 * BLOCK, 5 * BLOCK + 7])
def test_block_edges(n):
    draw = np.random.default_rng(n)
    for ids in (draw.integers(0, 65536, n), draw.zipf(1.3, n) % 65536, np.zeros(n), np.full(n, 65535), np.arange(n) % 3):
        ids = ids.astype("<u4")
        assert np.array_equal(decode_segment(encode_segment(ids)), ids)


def test_repeats_cost_less():
    ids = np.tile(np.random.default_rng(1).integers(0, 49408, 40), 500).astype("<u4")
    assert len(encode_segment(ids)) < 0.2 * 2 * len(ids)


@pytest.mark.parametrize("most", [2**20, 2**32])
def test_large_vocabularies(most):
    ids = np.random.default_rng(3).integers(0, most, 5 * BLOCK).astype("<u4")
    assert np.array_equal(decode_segment(encode_segment(ids)), ids)


def test_smaller_than_frequencies_and_zlib(texts):
    """All ids of the table: fewer bits than their order-0 entropy, and than zlib's on 16-bit ids."""
    found = id_files.WordCache(PATH).encode([(t or "").encode() for _, t in sorted(texts.items())])
    ids = np.frombuffer(b"".join(x + b"\1\0\0\0" for x in found), "<u4")
    n = np.unique(ids, return_counts=True)[1] / len(ids)
    size = len(encode_segment(ids))
    assert 8 * size < -(n * np.log2(n)).sum() * len(ids)
    assert size < len(zlib.compress(ids.astype("<u2").tobytes(), 9))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_any_tokenizer(name, texts):
    """Byte-level vocabularies keep white space, so their texts are encoded whole."""
    path = public_tokenizers.path(name)
    t = Tokenizer.from_file(path)
    some = [*(x or "" for x in texts.values()), "A\x01b <|endoftext|>, a<|endoftext|>... x\x01 \x01", "It's 'S 12.3!! ÀÉ. é, ﬁ́ \u0301, #$%", "\x0b\x1c\u2028 a\u00a0b", "a.'s a..'ll B'S, ß ẞ İ ΑΣ ΑΣ,"]
    cache = id_files.WordCache(path)
    assert cache.habits.space == (name == "word_bpe_49k.json")
    got = [np.frombuffer(x, "<u4").tolist() for x in cache.encode([x.encode() for x in some])]
    assert got == [t.encode(x, add_special_tokens=False).ids for x in some]


def test_damage_is_found():
    ids = np.random.default_rng(2).integers(0, 49408, 3 * BLOCK).astype("<u4")
    data = bytearray(encode_segment(ids))
    data[-10] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        decode_segment(bytes(data))
    with pytest.raises(ValueError, match="segment"):
        decode_segment(b"something else")


def expected(rows):
    """(id, start, n, crc) of (id, text) in order, end id 1 after each."""
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    at, out = 0, []
    for k, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.fixture
def small_segments(monkeypatch):
    monkeypatch.setattr(id_files, "SEGMENT_IDS", 5000)


def test_query(spark, sf_dir, texts, small_segments):
    got = sorted(tuple(r) for r in op7_id_coder(spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == expected(sorted(texts.items()))


def test_messy(spark, messy, none):
    path = new_path(spark, "test-ids")
    rows = messy.where("doc_id is not null")
    id_files.write_ids(rows, PATH, path)
    got = sorted(tuple(r) for r in id_files.read_ids(spark, path).select("doc", "start", "n_tokens", "ids_crc32").collect())
    assert got == expected(sorted((r.doc_id, r.text) for r in rows.collect()))
    path = new_path(spark, "test-ids")
    id_files.write_ids(messy, PATH, path)
    found = id_files.read_ids(spark, path).orderBy("start").collect()
    assert len(found) == messy.count() and [r.doc for r in found[:2]] == [None, None]
    path = new_path(spark, "test-ids")
    id_files.write_ids(none, PATH, path)
    assert id_files.read_ids(spark, path).count() == 0


def test_added_tokens_in_any_case():
    """Upper- and mixed-case forms of every added token, alone, inside words and among others, as the library has them."""
    t, cache = Tokenizer.from_file(PATH), id_files.WordCache(PATH)
    forms = [f(c.content) for c in t.get_added_tokens_decoder().values() for f in (str, str.upper, str.title, str.swapcase, lambda c: c[:5] + c[5:].upper())]
    texts = [x for f in forms for x in (f, f"a{f}b", f"The {f} End", f"{f}{f.lower()}", f"x\n{f}.", f[:-1], f.replace("|", " |"))]
    assert [np.frombuffer(x, "<u4").tolist() for x in cache.encode([x.encode() for x in texts])] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert np.frombuffer(cache.encode([b"<|ENDOFTEXT|>"])[0], "<u4").tolist() != [49407]


def test_unknown_forms_take_the_library(tmp_path):
    """A file whose normalizer does something else is never encoded by stretches."""
    import json

    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"]["normalizers"].append({"type": "Replace", "pattern": {"String": "qq"}, "content": "a b"})
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec))
    cache, t = id_files.WordCache(str(other)), Tokenizer.from_file(str(other))
    assert not cache.habits.space
    assert np.frombuffer(cache.encode([b"xqqy Word"])[0], "<u4").tolist() == t.encode("xqqy Word", add_special_tokens=False).ids


def test_many_texts_at_once():
    """Texts encoded together, one by one and by the library: marks at the ends, white space of all kinds, nothing at all."""
    t, cache = Tokenizer.from_file(PATH), id_files.WordCache(PATH)
    draw = np.random.default_rng(6)
    letters = np.array(list(" \t\n\x0b\x0c\r\x1c\x85 \x01\0aZß漢😀.,!'\"-7"))
    texts = ["", " ", "\n", "...", "a...", ".a", "é,", "a!b!", " x ", *("".join(draw.choice(letters, draw.integers(0, 40))) for _ in range(400))]
    together = cache.encode([x.encode() for x in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in together] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert together == [cache.encode([x.encode()])[0] for x in texts] and cache.encode([b"", b" "]) == [b"", b""] and cache.encode([]) == []


def test_marks_are_no_entries_of_their_stretches(monkeypatch):
    """Stretches that differ in the marks at their ends share an entry, and a cache that is full starts anew with the same ids."""
    cache = id_files.WordCache(PATH)
    cache.encode([b"alpha alpha, alpha. alpha... alpha!? (alpha) caf\xc3\xa9,"])
    assert sorted(cache) == sorted([b"alpha", b",", b".", b"...", b"!?", b"(alpha", b")", b"caf\xc3\xa9,"])
    monkeypatch.setattr(id_files, "CACHE_ENTRIES", 3)
    t = Tokenizer.from_file(PATH)
    for text in ("alpha beta, gamma", "beta, gamma delta.", "alpha alpha, (gamma)"):
        assert np.frombuffer(cache.encode([text.encode()])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_stretches_of_letters_go_to_the_model(texts):
    """They have the library's ids, and only where its steps leave them whole."""
    cache, t = id_files.WordCache(PATH), Tokenizer.from_file(PATH)
    assert cache.habits.letters and not id_files.WordCache(public_tokenizers.path("byte_bpe_50k.json")).habits.letters
    draw = np.random.default_rng(8)
    some = sorted({w.lower() for x in texts.values() for w in (x or "").split() if w.isascii() and w.isalpha()})[:2000]
    some += ["".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz"), draw.integers(1, 30))) for _ in range(500)]
    assert id_files.ids_of_model(cache.tokenizer, some) == [e.ids for e in t.encode_batch(some, add_special_tokens=False)]
