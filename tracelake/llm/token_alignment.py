"""Alignment of two tokenizers over a corpus: linked tokens of each text, how common each pair is, sums by document.

Texts are encoded by both vocabularies and their tokens laid over each other by byte
offsets. Two tokens are linked where their ranges overlap. The number of documents that
hold a pair linked comes from all of them, and each document gets sums over its links.

The pass over the texts is cut into blocks of documents. A block's postings (pair,
document, multiplicity) are sorted by pair and written, so texts are encoded once.
A pair's count is the sum of its blocks' documents. Then counts and postings are
shuffled by the first vocabulary's id: ids are cut into buckets of like cost, and a
bucket's postings are dealt over as many cells as its share asks for, so that an id
that holds a third of all postings is no hot key; each cell has all counts of its
bucket. Spark sorts a cell's rows (spilling where it must): counts first, then
block after block, so a task holds the counts of one bucket and one block's postings.
It takes each id's maximum, emits what the pairs give to each document, and Spark
sums by document.

Both vocabularies cut between a word and the blank before the next one, and around a
line end between words, so what lies between is aligned once and kept in a bounded
cache, which only saves time.

Defined cases: null and empty texts, and texts whose tokens do not join to a blank
and the text, have no tokens: zeros and an empty digest. Rows with equal or null ids
are documents of their own. An empty table gives an empty result. Extra columns are
not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.byte_bpe import _OTHER_WHITE as OTHER_WHITE
from tracelake.llm.byte_bpe import byte_alphabet
from tracelake.llm.common import shuffle_parts, stored

#: The word pattern of the byte-level vocabulary, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Documents and bytes of a block; characters and stretches that a worker keeps aligned.
BLOCK_ROWS, BLOCK_BYTES = 1000, 4_000_000
CACHE_CHARS, CACHE_ENTRIES = 8_000_000, 400_000
#: Words that are encoded as one text.
JOINED = 2000
#: Buckets of first ids, about as many at every size: a document gets a row from each at most, and more tasks share a bucket's blocks.
BUCKETS = 32
#: Where a text can be cut: before a single blank, and around a single line end, between other characters.
_CUTS = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")


def stretches(text: str) -> list[str]:
    """Parts of a text between which no token of either vocabulary lies; empty ones stand for nothing."""
    simple = not ("  " in text or " \n" in text or "\n " in text or "\n\n" in text or OTHER_WHITE.search(text))
    return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0") if simple else _CUTS.split(text)


def byte_encoder(path: str):
    """A function (texts -> lists of ids, special tokens' strings as plain text) and each id's bytes."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet, special = byte_alphabet(), {t["content"] for t in spec.get("added_tokens", [])}
    vocab = {bytes(alphabet[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    made = [spec["model"]["vocab"][a + b] for a, b in pairs]
    strings = [b""] * (1 + max(spec["model"]["vocab"].values()))
    for s, i in vocab.items():
        strings[i] = s
    if made == sorted(set(made)):  # ids are merge ranks
        import tiktoken

        encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={})
        return (lambda texts: list(map(encoding.encode_ordinary, texts))), strings
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return (lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]), strings


class PieceEncoder:
    """Ids of the stretches of a text by a piece vocabulary that puts a blank before each text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.strings = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self._line_end = [self.model.piece_to_id(x) for x in ("▁", "<0x0A>")]
        #: Whether parts can be encoded alone: no piece has a blank after another character, or a line end within.
        self.parts = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces) and self.model.encode("\n") == self._line_end

    def __call__(self, parts: list[str]) -> list[list[int]]:
        plain = [s[:1] == " " and s[1:2] not in ("", " ") for s in parts]
        found = self.model.encode([s[1:] if p else f"\n{s}" for s, p in zip(parts, plain, strict=True)], num_threads=1)
        return [ids if p else ids[2:] for ids, p in zip(found, plain, strict=True)]


class Laid(NamedTuple):
    """Tokens of texts laid over each other: what belongs to text k stands from place ``x[k]`` to ``x[k + 1]`` of its array."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    links: np.ndarray
    first_link: np.ndarray
    groups: list[bytes]


class Aligner:
    """Both vocabularies and the stretches seen so far."""

    def __init__(self, a_path: str, b_path: str):
        self.a_ids, self.a_strings = byte_encoder(a_path)
        self.b_ids = PieceEncoder(b_path)
        self.b_strings = self.b_ids.strings
        self.n_second = len(self.b_strings)
        self._a_len, self._b_len = (np.array([len(s) for s in x], np.int64) for x in (self.a_strings, self.b_strings))
        # An id's text in the list of groups, by whether it is the last of its side.
        self._said = [b"%d%s" % (i, end) for n, ends in ((len(self.a_strings), (b",", b"|")), (self.n_second, (b",", b";"))) for i in range(n) for end in ends]
        self._said_len = np.array([len(s) for s in self._said], np.int64)
        self._clear()

    def _clear(self) -> None:
        self._place, self._chars, self._groups = {"": 0}, 0, [b""]
        self._counts = np.zeros((1024, 4), np.int64)  # of each stretch: ids, ids, groups; -1 where bytes differ; its first link
        self._links, self._n_links = np.zeros(4096, np.int64), 0

    def lay(self, ids_a: np.ndarray, ids_b: np.ndarray, sizes: np.ndarray) -> Laid:
        """Links and groups of texts of ``sizes`` bytes, to which the tokens of all of them join."""
        ends_a, ends_b, ends = np.cumsum(self._a_len[ids_a]), np.cumsum(self._b_len[ids_b]), np.cumsum(sizes)
        every = np.union1d(ends_a, ends_b)
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        links = ids_a[np.searchsorted(ends_a, every)] * self.n_second + ids_b[np.searchsorted(ends_b, every)]
        # How many tokens end within each group or before, and the group of each token.
        until_a, until_b = np.searchsorted(ends_a, both, "right"), np.searchsorted(ends_b, both, "right")
        in_a, in_b = np.repeat(np.arange(len(both)), np.diff(until_a, prepend=0)), np.repeat(np.arange(len(both)), np.diff(until_b, prepend=0))
        at_a, at_b = np.arange(len(ids_a)), np.arange(len(ids_b))
        said = np.empty(len(ids_a) + len(ids_b), np.int64)
        said[at_a + np.append(0, until_b)[in_a]] = 2 * ids_a + (at_a + 1 == until_a[in_a])
        said[at_b + until_a[in_b]] = 2 * (len(self.a_strings) + ids_b) + (at_b + 1 == until_b[in_b])
        text = b"".join(map(self._said.__getitem__, said.tolist()))
        n_a, n_b, n_groups, n_links = (np.append(0, np.searchsorted(x, ends, "right")) for x in (ends_a, ends_b, both, every))
        stops = np.append(0, np.cumsum(self._said_len[said]))[n_a + n_b].tolist()
        return Laid(np.diff(n_a), np.diff(n_b), np.diff(n_groups), links, n_links, [text[i:j] for i, j in zip(stops, stops[1:], strict=False)])

    def _learn(self, new: list[str]) -> None:
        """Words after a blank are encoded many at once, as both vocabularies cut between them; other stretches, and words of
        which a token's bytes are others than the word's, one by one."""
        plain = [s for s in new if s[0] == " " and len(s) > 1 and not s[1:].isspace() and not OTHER_WHITE.search(s) and " " not in s[1:] and "\n" not in s] if self.b_ids.parts else []
        rest = set(new).difference(plain)
        for at in range(0, len(plain), JOINED):
            some = plain[at : at + JOINED]
            text = "".join(some)
            a, b = self.a_ids([text])[0], self.b_ids([text])[0]
            raw = text.encode()
            sizes = np.array([len(s.encode()) for s in some], np.int64)
            if b"".join(map(self.a_strings.__getitem__, a)) == raw == b"".join(map(self.b_strings.__getitem__, b)):
                self._keep(some, self.lay(np.array(a, np.int64), np.array(b, np.int64), sizes))
            else:
                rest.update(some)
        rest = sorted(rest)
        a, b = self.a_ids(rest), self.b_ids(rest)
        raw = [s.encode() for s in rest]
        good = [b"".join(map(self.a_strings.__getitem__, x)) == r == b"".join(map(self.b_strings.__getitem__, y)) for r, x, y in zip(raw, a, b, strict=True)]
        alike = [i for i, ok in enumerate(good) if ok]
        if alike:
            ids = [np.fromiter(chain.from_iterable([x[i] for i in alike]), np.int64) for x in (a, b)]
            self._keep([rest[i] for i in alike], self.lay(*ids, np.array([len(raw[i]) for i in alike], np.int64)))
        if len(alike) < len(rest):
            self._keep([s for s, ok in zip(rest, good, strict=True) if not ok], None)

    def _keep(self, new: list[str], laid: Laid | None) -> None:
        """Enter stretches into the cache; without a layout their bytes differ."""
        n, first, links = len(self._place), self._n_links, laid.links if laid else []
        while n + len(new) >= len(self._counts):
            self._counts = np.concatenate([self._counts, np.zeros_like(self._counts)])
        while first + len(links) > len(self._links):
            self._links = np.concatenate([self._links, np.zeros_like(self._links)])
        self._n_links += len(links)
        rows = self._counts[n : n + len(new)]
        if laid:
            self._links[first : self._n_links] = links
            rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3] = laid.n_a, laid.n_b, laid.n_groups, first + laid.first_link[:-1]
        else:
            rows[:, :3], rows[:, 3] = -1, first
        self._counts[n + len(new), 3] = self._n_links
        self._groups += laid.groups if laid else [b""] * len(new)
        self._place.update(zip(new, range(n, n + len(new)), strict=True))
        self._chars += sum(map(len, new))

    def block(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text n_a, n_b, n_groups and n_links; its groups' digest; the block's postings by pair and text: pair, text, multiplicity."""
        if self._chars > CACHE_CHARS or len(self._place) > CACHE_ENTRIES:
            self._clear()
        cut = [(stretches(f" {t}") if self.b_ids.parts else [f" {t}"]) if t else [] for t in texts]
        new = set(chain.from_iterable(cut)).difference(self._place)
        if new:
            self._learn(sorted(new))
        flat = list(map(self._place.__getitem__, chain.from_iterable(cut)))
        doc, place = np.repeat(np.arange(len(texts)), [len(p) for p in cut]), np.array(flat, np.int64)
        stops = [0, *np.cumsum([len(p) for p in cut]).tolist()]
        groups = list(map(self._groups.__getitem__, flat))
        bad = np.zeros(len(texts), bool)
        bad[doc[self._counts[place, 0] < 0]] = True
        kept = ~bad[doc]
        doc, place = doc[kept], place[kept]
        stats = np.zeros((len(texts), 4), np.int64)
        n_links = self._counts[place + 1, 3] - self._counts[place, 3]
        for k, values in enumerate((*self._counts[place, :3].T, n_links)):
            stats[:, k] = np.bincount(doc, values, len(texts))
        said = [hashlib.sha256(b"".join(groups[i:j])[:-1]).hexdigest() if n else "" for i, j, n in zip(stops, stops[1:], stats[:, 0].tolist(), strict=False)]
        # Of each stretch of a text its multiplicity, then its links.
        seen, times = np.unique(place * len(texts) + doc, return_counts=True) if len(place) else (place, place)
        place, doc = np.divmod(seen, max(1, len(texts)))
        first = self._counts[place, 3]
        n = self._counts[place + 1, 3] - first
        link = np.repeat(first - np.append(0, np.cumsum(n)[:-1]) if len(n) else n, n) + np.arange(n.sum())
        keys = self._links[link] * len(texts) + np.repeat(doc, n)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        begins = np.flatnonzero(np.diff(keys, prepend=-1))
        times = np.add.reduceat(np.repeat(times, n)[order], begins) if len(begins) else times[:0]
        pair, doc = np.divmod(keys[begins], max(1, len(texts)))
        return stats, said, pair, doc, times


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """The aligner of two files, loaded once in each Python worker."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def pack(pair: np.ndarray, doc: np.ndarray, times: np.ndarray) -> bytes:
    """Postings sorted by pair, as bytes: pairs and how many documents each has, then documents and multiplicities."""
    pairs, n = np.unique(pair, return_counts=True)
    arrays = [np.array([len(pairs), len(doc)], "<i8"), np.diff(pairs, prepend=0).astype("<i8"), n.astype("<i4"), doc.astype("<i4"), times.astype("<i4")]
    # Bytes of one weight side by side, as most of them are zero.
    return zstandard.compress(arrays[0].tobytes() + b"".join(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in arrays[1:]), 1)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, documents of each, documents, multiplicities)."""
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    n_pairs, n = raw[:16].view("<i8").tolist()
    found, at = [], 16
    for size, kind in ((n_pairs, "<i8"), (n_pairs, "<i4"), (n, "<i4"), (n, "<i4")):
        width = np.dtype(kind).itemsize
        found.append(np.ascontiguousarray(raw[at : at + size * width].reshape(width, size).T).view(kind).ravel().astype(np.int64))
        at += size * width
    return np.cumsum(found[0]), *found[1:]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of at most BLOCK_ROWS rows and about BLOCK_BYTES of text, one row at least."""
    for batch in batches:
        sizes = np.array([len(t) if t else 0 for t in batch.column(1).to_pylist()], np.int64)
        at = 0
        while at < batch.num_rows:
            n = max(1, min(BLOCK_ROWS, int(np.searchsorted(np.cumsum(sizes[at : at + BLOCK_ROWS]), BLOCK_BYTES, "right"))))
            yield batch.slice(at, n)
            at += n


def aligned_blocks(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, number, n_a, n_b, n_groups, n_links, groups_sha256, block, postings), written.

    ``number`` is a document's own; the first row of a block has its postings.
    """
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("binary").alias("text"))
    names = ["doc", "number", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "block", "postings"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lay, at = aligner(a_path, b_path).block, TaskContext.get().partitionId() << 24
        for part in _blocks(batches):
            stats, said, *postings = lay([(t or b"").decode("utf-8", "replace") for t in part.column(1).to_pylist()])
            n = part.num_rows
            numbers = pa.array((at << 12) + np.arange(n))
            columns = [part.column(0), numbers, *map(pa.array, stats.T), pa.array(said, pa.string()), pa.array(np.full(n, at)), pa.array([pack(*postings), *[None] * (n - 1)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            at += 1

    kind = dict(rows.dtypes)["doc"]
    return stored(rows.mapInArrow(run, f"doc {kind}, number bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, block bigint, postings binary"), "aligned")


def counted_pairs(blocks: DataFrame) -> DataFrame:
    """(pair, n): in how many documents a pair is linked; a task adds its blocks up before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = n = np.empty(0, np.int64)

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], names=["pair", "n"])

        for batch in batches:
            for data in batch.column(0):
                more, times, *_ = unpack(data.as_py())
                pairs, back = np.unique(np.concatenate([pairs, more]), return_inverse=True)
                total = np.zeros(len(pairs), np.int64)
                np.add.at(total, back, np.concatenate([n, times]))
                n = total
                if len(pairs) > 2_000_000:
                    yield rows()
                    pairs = n = np.empty(0, np.int64)
        yield rows()

    found = blocks.where("postings is not null").select("postings").mapInArrow(run, "pair bigint, n bigint")
    return found.groupBy("pair").agg(F.sum("n").alias("n"))


def buckets_of(ids: list[int], postings: list[int], pairs: list[int], cells: int) -> tuple[list[int], list[int], list[int]]:
    """First id of each bucket, its first cell, and its number of cells.

    An id costs its share of all postings and of all pairs. Buckets are runs of ids of
    about one BUCKETS-th of the cost, or one id that costs more; cells follow the cost.
    """
    total, all_pairs = max(1, sum(postings)), max(1, sum(pairs))
    cost = [p / total + q / all_pairs for p, q in zip(postings, pairs, strict=True)]
    most = 2 / BUCKETS
    firsts, sums = [0], [0.0]
    for i, c in zip(ids, cost, strict=True):
        if sums[-1] and sums[-1] + c > most:
            firsts.append(i)
            sums.append(0.0)
        sums[-1] += c
    n = [max(1, round(s * cells / 2)) for s in sums]
    return firsts, [sum(n[:k]) for k in range(len(n))], n


def contributions(blocks: DataFrame, counts: DataFrame, n_second: int) -> DataFrame:
    """(number, count_sum, n_best): what a document's pairs give it, a row for each document and bucket."""
    spark = blocks.sparkSession
    parts = shuffle_parts(spark)
    # One row for each id of the first vocabulary at most.
    weights = counts.groupBy(F.expr(f"pair div {n_second}").alias("a")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("pairs")).orderBy("a").collect()
    firsts, first_cell, n_cells = buckets_of([r.a for r in weights], [r.n for r in weights], [r.pairs for r in weights], max(2 * parts, BUCKETS))
    edges = np.array([*firsts[1:], np.iinfo(np.int64).max // n_second]) * n_second

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = np.searchsorted(edges, batch.column(0).to_numpy(), "right")
            n = np.array(n_cells)[bucket]
            row = np.repeat(np.arange(len(n)), n)
            cell = np.array(first_cell)[bucket][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *(c.take(pa.array(row)) for c in batch.columns), pa.nulls(len(row), pa.int64()), pa.nulls(len(row), pa.binary())], names=["cell", "pair", "n", "block", "postings"])

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pairs, n, doc, times = unpack(data)
                pair, at = np.repeat(pairs, n), np.append(0, np.cumsum(n))
                stops = [0, *at[np.searchsorted(pairs, edges)].tolist()]
                full = [k for k in range(len(firsts)) if stops[k] < stops[k + 1]]
                cell = [first_cell[k] + block % n_cells[k] for k in full]
                packed = [pack(*(x[stops[k] : stops[k + 1]] for x in (pair, doc, times))) for k in full]
                none = pa.nulls(len(full), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), none, none, pa.array([block] * len(full), pa.int64()), pa.array(packed, pa.binary())], names=["cell", "pair", "n", "block", "postings"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, known, fresh, pairs, count, best = None, [], False, *[np.empty(0, np.int64)] * 3
        for batch in batches:
            cells = batch.column(0).to_numpy()
            for at in np.flatnonzero(np.diff(cells, prepend=-1)).tolist():
                part = batch.slice(at, int(np.searchsorted(cells, cells[at], "right")) - at)
                if cells[at] != cell:
                    cell, known = cells[at], []
                n = part.num_rows - part.column(1).null_count  # counts stand first
                if n:
                    known.append((part.column(1).slice(0, n).to_numpy(), part.column(2).slice(0, n).to_numpy()))
                    fresh = True
                if n < part.num_rows and fresh:
                    pairs, count = (np.concatenate(x) for x in zip(*known, strict=True))
                    begins = np.flatnonzero(np.diff(pairs // n_second, prepend=-1))
                    best = count == np.repeat(np.maximum.reduceat(count, begins), np.diff(begins, append=len(pairs)))
                    fresh = False
                for row in range(n, part.num_rows):
                    mine, docs_of, doc, times = unpack(part.column(4)[row].as_py())
                    place = np.repeat(np.searchsorted(pairs, mine), docs_of)
                    docs, back = np.unique(doc, return_inverse=True)
                    sums, bests = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
                    np.add.at(sums, back, count[place] * times)
                    np.add.at(bests, back, best[place] * times)
                    yield pa.RecordBatch.from_arrays([pa.array((part.column(3)[row].as_py() << 12) + docs), pa.array(sums), pa.array(bests)], names=["number", "count_sum", "n_best"])

    schema = "cell int, pair bigint, n bigint, block bigint, postings binary"
    both = counts.select("pair", "n").mapInArrow(cells, schema).unionByName(blocks.where("postings is not null").select("block", "postings").mapInArrow(shares, schema))
    dealt = both.repartitionById(parts, F.col("cell") % parts).sortWithinPartitions("cell", F.col("block").asc_nulls_first(), "pair")
    return dealt.mapInArrow(emit, "number bigint, count_sum bigint, n_best bigint")


def pair_counts(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, n, best): every pair of linked ids, in how many documents it is linked, and whether no other pair of ``a`` is in more."""
    size = PieceEncoder(b_path).model.get_piece_size()
    counts = counted_pairs(aligned_blocks(docs, a_path, b_path, id_col=id_col, text_col=text_col))
    counts = stored(counts.select(F.expr(f"pair div {size}").alias("a"), (F.col("pair") % size).alias("b"), "n"), "pairs")
    return counts.join(counts.groupBy("a").agg(F.max("n").alias("most")), "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def align_tokens(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    blocks = aligned_blocks(docs, a_path, b_path, id_col=id_col, text_col=text_col)
    counts = stored(counted_pairs(blocks), "pairs")
    given = contributions(blocks, counts, PieceEncoder(b_path).model.get_piece_size()).groupBy("number").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    out = blocks.select("doc", "number", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(given, "number", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
