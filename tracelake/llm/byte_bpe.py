"""Byte-level BPE: encoding by a queue of merge ranks over a linked symbol list, decoding by vocabulary strings.

``BytePairCoder`` is the kernel; ``encode_frame`` and ``decode_frame`` run it in
Arrow batches, ROWS documents at a time. A text is cut into pieces that no merge
crosses; ids of pieces seen before come from a bounded cache, which only saves
time. The new pieces of a batch are merged together: their symbols are one doubly
linked list, in which pieces are not linked with each other, and one queue of ranks
holds the places of each rank. The lowest rank merges at all of its places at once;
places whose pair has another rank by now are stale and skipped.

Defined cases: a null text is empty; an empty text has no ids and decodes to the
empty text; the special tokens' strings in a text become their ids, as the
tokenizers library does by default. Extra columns are kept.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Characters that the word pattern takes for white space (Unicode White_Space), fixed values of the format.
_WHITE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: The word pattern of the vocabulary, a fixed value.
_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
#: Stretches at whose borders the word pattern always cuts.
_STRETCHES = regex.compile(rf" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
#: White space but for blanks and line ends.
_OTHER_WHITE = re.compile(f"[{_WHITE.replace(' ', '').replace(chr(10), '')}\0]")
CACHE_ENTRIES = 150_000
#: Rows of a batch that are worked on at once; from so many places on, a rank is merged by arrays.
ROWS, MANY = 300, 24


def byte_alphabet() -> dict[str, int]:
    """Vocabulary character -> byte: printable Latin-1 stands for itself, the other bytes follow from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairCoder:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        alphabet = byte_alphabet()
        self.strings: dict[int, bytes] = {i: bytes(alphabet[c] for c in s) for s, i in vocab.items() if all(c in alphabet for c in s)}
        self.byte_id = [0] * 256
        for c, b in alphabet.items():
            self.byte_id[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        #: left id and right id, as one number -> rank; rank -> merged id
        self._rank = {vocab[a] << 32 | vocab[b]: rank for rank, (a, b) in enumerate(pairs)}
        self._merged = [vocab[a + b] for a, b in pairs]
        self._twin = [a == b for a, b in pairs]
        self._keys = np.array(sorted(self._rank), np.int64)
        self._key_ranks = np.array([self._rank[k] for k in self._keys.tolist()], np.int64)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings |= {i: s.encode() for s, i in self.special.items()}
        self._special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self._cache: dict[str, bytes] = {}

    @property
    def merge(self) -> dict[tuple[int, int], tuple[int, int]]:
        """(left id, right id) -> (rank, merged id)."""
        return {(k >> 32, k & 0xFFFFFFFF): (r, self._merged[r]) for k, r in self._rank.items()}

    def _ranks(self, left: np.ndarray | int, right: np.ndarray | int) -> np.ndarray:
        """Ranks of pairs of ids, -1 for those that do not merge."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._key_ranks[at], -1)

    def merge_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers: the lowest rank merges first, at equal ranks the leftmost."""
        if not pieces:
            return []
        ids = np.append(np.array(self.byte_id, np.int64)[np.frombuffer(b"".join(pieces), np.uint8)], -1)
        n = len(ids) - 1  # the place n stands for no symbol
        ends = np.cumsum([len(p) for p in pieces])
        right, left = np.arange(1, n + 2), np.arange(-1, n)
        right[ends - 1] = left[0] = left[ends[:-1]] = right[n] = n
        ranks = self._ranks(ids, ids[right])
        places = np.flatnonzero(ranks >= 0)
        places = places[np.argsort(ranks[places], kind="stable")]
        queue, first = np.unique(ranks[places], return_index=True)
        waiting = dict(zip(queue.tolist(), np.split(places, first[1:]), strict=False)) if len(places) else {}
        queue, more, none = queue.tolist(), {}, np.empty(0, np.int64)  # a sorted list is a heap

        def push(ranks: list[int], places: list[int]) -> None:
            for r, place in zip(ranks, places, strict=True):
                if r < 0:
                    continue
                if r in more:
                    more[r].append(place)
                else:
                    more[r] = [place]
                    if r not in waiting:
                        heappush(queue, r)

        while queue:
            rank = heappop(queue)
            at, late = waiting.pop(rank, none), more.pop(rank, [])
            if len(at) + len(late) < MANY or self._twin[rank]:
                self._merge_each(rank, sorted(at.tolist() + late), ids, left, right, ranks, push)
                continue
            at = np.append(at, late) if late else at  # a place that is there twice merges once all the same
            at = at[ranks[at] == rank]
            new = self._merged[rank]
            gone = right[at]
            after = right[gone]
            ids[at], ids[gone], ranks[gone] = new, -1, -1
            right[at], left[after] = after, at
            before = left[at]
            ranks[at], ranks[before] = self._ranks(new, ids[after]), self._ranks(ids[before], new)
            push(ranks[at].tolist(), at.tolist())
            push(ranks[before].tolist(), before.tolist())
        alive = ids[:n] >= 0
        data = ids[:n][alive].astype("<u4").tobytes()
        stops = (4 * np.cumsum(alive)[ends - 1]).tolist()
        return [data[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    def _merge_each(self, rank: int, places: list[int], ids: np.ndarray, left: np.ndarray, right: np.ndarray, ranks: np.ndarray, push) -> None:
        """Merge places one after the other, from the left: few of them, or such that may overlap."""
        new, rank_of = self._merged[rank], self._rank
        for i in places:
            if ranks[i] != rank:
                continue
            j = right[i]
            k, h = int(right[j]), int(left[i])
            ids[i], ids[j], ranks[j] = new, -1, -1
            right[i], left[k] = k, i
            r, s = rank_of.get(new << 32 | int(ids[k]), -1), rank_of.get(int(ids[h]) << 32 | new, -1)
            ranks[i], ranks[h] = r, s
            push((r, s), (i, h))

    def merge_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        return np.frombuffer(self.merge_pieces([piece])[0], "<u4").tolist() if piece else []

    def _stretches(self, text: str) -> list[str]:
        """Stretches of a text, each a blank or none and what is no white space, or white space; an empty one stands for nothing."""
        simple = not ("  " in text or " \n" in text or "\n " in text or "\n\n" in text or _OTHER_WHITE.search(text))
        # Where blanks and line ends stand alone, the pattern cuts before each blank, and before and after each line end.
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0") if simple else _STRETCHES.findall(text)

    def _cut(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self._special is None or not self._special.search(text):
            return self._stretches(text)
        parts, at = [], 0
        for found in self._special.finditer(text):
            parts += [*self._stretches(text[at : found.start()]), found.group()]
            at = found.end()
        return parts + self._stretches(text[at:])

    def _learn(self, stretches: set[str]) -> None:
        """Ids of new stretches: their pieces are cut, and the new ones merged together."""
        cache = self._cache
        # Latin letters, after a blank or not, are one piece.
        pieces = {s: [s] if (s[1:] if s[0] == " " else s).isalpha() and (s.isascii() or max(s) < "\u0250") else _PIECES.findall(s) for s in stretches}
        new = list({p for some in pieces.values() for p in some if p not in cache})
        cache.update(zip(new, self.merge_pieces([p.encode("utf-8", "replace") for p in new]), strict=True))
        for s, some in pieces.items():
            if len(some) > 1:
                cache[s] = b"".join([cache[p] for p in some])

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cache = self._cache
        if len(cache) > CACHE_ENTRIES or not cache:
            cache.clear()
            cache.update({"": b""} | {s: i.to_bytes(4, "little") for s, i in self.special.items()})
        cut = [self._cut(t) for t in texts]
        found = [list(map(cache.get, some)) for some in cut]
        self._learn({s for some, ids in zip(cut, found, strict=True) for s, x in zip(some, ids, strict=True) if x is None})
        return [b"".join([cache[s] if x is None else x for s, x in zip(some, ids, strict=True)]) for some, ids in zip(cut, found, strict=True)]

    def encode(self, text: str | None) -> bytes:
        return self.encode_batch([text])[0]

    def decode(self, ids: bytes) -> str:
        """The strings of the ids, joined; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.strings.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


_coders: dict[str, BytePairCoder] = {}


def coder(path: str) -> BytePairCoder:
    """The coder of a file, loaded once in each Python worker."""
    if path not in _coders:
        _coders[path] = BytePairCoder(path)
    return _coders[path]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def encode_frame(docs: DataFrame, path: str, *, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col`` (binary, little-endian unsigned 32-bit ids) in place of an equal name."""
    kept = [c for c in docs.columns if c != ids_col]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.select(*kept).dtypes), f"`{ids_col}` binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coder(path).encode_batch
        for batch in _parts(batches):
            ids = pa.array(encode(batch.column(text_col).to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, ids_col])

    return docs.select(*kept).mapInArrow(run, schema)


def decode_frame(rows: DataFrame, path: str, *, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``rows`` with ``text_col`` decoded from ``ids_col``; a null list of ids gives a null text."""
    kept = [c for c in rows.columns if c != text_col]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.select(*kept).dtypes), f"`{text_col}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = coder(path).decode
        for batch in _parts(batches):
            text = pa.array([None if x.as_py() is None else decode(x.as_py()) for x in batch.column(ids_col)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, text_col])

    return rows.select(*kept).mapInArrow(run, schema)
