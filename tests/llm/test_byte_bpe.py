"""Byte-level BPE against the tokenizers library."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracelake.llm.byte_bpe import BytePairCoder, decode_frame, encode_frame
from tracelake.llm.queries import op10_byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def own():
    return BytePairCoder(PATH)


def ids(data: bytes) -> list[int]:
    return np.frombuffer(data, "<u4").tolist()


CASES = [
    "", " ", "a", "  two  spaces ", "it's we'll I'M don't 's", "x\n\n\ny \n z", "12345 abc123 _-_!?", "naïve 漢字 😀👩‍👩‍👧 ́", "   wide　spaces\u0085x", "a" * 3000,
    "before<|endoftext|>after", "<|endoftext|><|endoftext|>", " <|endoftext|> x", "\x00\x01\x7f", "\r\n\t tabs\t\tand\x0bmore\x0c",
]


@pytest.mark.parametrize("text", CASES)
def test_cases(own, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert ids(own.encode(text)) == want
    assert own.decode(own.encode(text)) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t'sdlm.,!aAbB01 ́<|>")), st.characters(codec="utf-8")), max_size=60))
def test_any_text(own, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert ids(own.encode(text)) == want
    assert own.decode(own.encode(text)) == library.decode(want, skip_special_tokens=False)


def test_lowest_rank_first(own):
    """The queue gives what repeated search for the lowest rank gives."""
    for piece in (b"aaaaaaa", b"abababab", b"mississippi", b"  hello", "übergrößen".encode()):
        x = [own.byte_id[b] for b in piece]
        while True:
            found = [(own.merge[p][0], i) for i, p in enumerate(zip(x, x[1:], strict=False)) if p in own.merge]
            if not found:
                break
            _, i = min(found)
            x[i : i + 2] = [own.merge[(x[i], x[i + 1])][1]]
        assert own.merge_piece(piece) == x


def test_broken_bytes_decode_to_replacements(own, library):
    some = [own.byte_id[0xE6], own.byte_id[0x41]]
    assert own.decode(np.array(some, "<u4").tobytes()) == library.decode(some, skip_special_tokens=False)


def test_query(spark, sf_dir, texts, library):
    got = {r.doc_id: r for r in op10_byte_bpe(spark, sf_dir).collect()}
    assert got.keys() == texts.keys()
    for k, text in texts.items():
        want = library.encode(text or "", add_special_tokens=False).ids
        assert got[k].n_tokens == len(want)
        assert got[k].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_messy(messy, none, library):
    got = decode_frame(encode_frame(messy.withColumnRenamed("h", "ids"), PATH).withColumnRenamed("text", "was"), PATH)
    rows = got.collect()
    assert len(rows) == messy.count()
    for r in rows:
        assert r.text == (r.was or "")
        assert ids(bytes(r.ids)) == library.encode(r.was or "", add_special_tokens=False).ids
    assert encode_frame(none, PATH).count() == 0
