"""Token-ID output: documents encoded, written as coded segments in id order, read back.

``write_ids`` range-partitions documents by id, encodes them with a tokenizers
file (stretch by stretch from a cache where the file's normalizer and cutter are known
to cut at white space, which is tried out too; else, and where a text has an added
token's string in any case, by the library as it is), appends the end id and writes a
table of segments: the ids of a run of documents, coded by ``id_coder``, with the documents' ids and lengths. The table
lies in a folder that all executors share, written by Spark's own commit
protocol, so a lost executor costs its unfinished partitions only. ``read_ids``
decodes segments and gives each document its place among all ids: segments are
summed in a partition and partitions among each other, so only one number per
partition meets in a task.

Defined cases: a null text is empty and has the end id alone; null document ids
come first; equal ids are ordered by a digest of the text; an empty table gives
an empty file. Extra columns are not read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.llm.common import SPACE, shuffle_parts
from tracelake.llm.id_coder import decode_segment, encode_segment

SEGMENT_IDS = 3_000_000
CACHE_ENTRIES = 1_000_000
#: Texts that are encoded together.
TEXTS = 1024

#: A character that stands between the stretches of a batch; stretches that have it are encoded alone.
MARK = "\x01"
#: Stretches that are encoded as one text.
JOINED = 400


def load(path: str):
    """A tokenizers file without truncation and padding; one thread, as a task has one core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def ids_of(tokenizer, texts: list[str]) -> list[list[int]]:
    return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def ids_of_model(tokenizer, pieces: list[str]) -> list[list[int]]:
    """Ids of pieces that a tokenizer's steps before its model would leave as they are."""
    tokenize = tokenizer.model.tokenize
    return [[t.id for t in tokenize(x)] for x in pieces]


#: Marks that often end a stretch.
TAIL = b'.,!?;:#$%&*)-"'
#: By byte: whether it is an ASCII letter or digit.
ALNUM = np.array([bytes([x]).isalnum() for x in range(256)])


def parts_of(spec: dict | None, name: str) -> list[dict]:
    """The steps of a normalizer or pre-tokenizer of a tokenizers file."""
    if not spec:
        return []
    return [x for part in spec[name] for x in parts_of(part, name)] if spec["type"] == "Sequence" else [spec]


def known_forms(tokenizer) -> tuple[bool, bool]:
    """Whether a tokenizer's steps are such that stretches between white space can be encoded alone, and that they are lower-cased."""
    told = lambda part: None if part is None else json.loads(part.__getstate__())
    steps = parts_of(told(tokenizer.normalizer), "normalizers")
    cuts = parts_of(told(tokenizer.pre_tokenizer), "pretokenizers")
    plain = all(x["type"] in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase") or (x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " ") for x in steps)
    # What the cutter's pattern does not find is removed: white space and nothing else.
    white = bool(cuts) and cuts[0]["type"] == "Split" and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"] and all(x["type"] == "ByteLevel" and not x["add_prefix_space"] for x in cuts[1:])
    return plain and white, any(x["type"] == "Lowercase" for x in steps)


class Habits:
    """What a tokenizer of known form does, tried out on short texts that have all of a kind.

    ``space``: a text's ids are those of its stretches without ASCII white space, one
    after the other. ``case``: A-Z and a-z have the same ids. ``tail``: marks that end
    a stretch after an ASCII letter or digit have their own ids. ``letters``: stretches
    of a-z are whole pieces for the model.
    """

    def __init__(self, tokenizer):
        known, lower = known_forms(tokenizer)
        parts = ["ab", "Cd,", "7", "é'", "!", "a1.b", MARK, "'s", "ﬁ", "\u0301x"]
        alone = ids_of(tokenizer, parts)
        self.space = known
        for space in SPACE:
            joined = ids_of(tokenizer, [f"{a}{space}{b}" for a in parts for b in parts] + [f"{space}{a}{space}{space}" for a in parts])
            self.space &= joined == [a + b for a in alone for b in alone] + alone
        letters = [chr(x) for x in range(97, 123)]
        small = [*letters, *(a + b for a in letters for b in letters), "it's", "abcdefghijklmnopqrstuvwxyz"]
        self.case = self.space and lower and ids_of(tokenizer, small) == ids_of(tokenizer, [x.upper() for x in small])
        self.letters = self.space and ids_of(tokenizer, small) == [ids_of_model(tokenizer, [x])[0] if x.isalpha() else y for x, y in zip(small, ids_of(tokenizer, small), strict=True)]
        ends, marks = [*letters, "The", *"0123456789"], [chr(x) for x in TAIL]
        tails = [*marks, *(a + b for a in marks for b in marks), "..."]
        both = ids_of(tokenizer, [e + t for e in ends for t in tails])
        own = not any(m in str(t) for t in tokenizer.get_added_tokens_decoder().values() for m in marks)
        self.tail = self.space and own and both == [a + b for a in ids_of(tokenizer, ends) for b in ids_of(tokenizer, tails)]


def _bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(where each string begins, and the end of the last; the bytes of all)."""
    _, upto, data = strings.buffers()
    upto = np.frombuffer(upto, np.int32)[strings.offset : strings.offset + len(strings) + 1]
    return upto.astype(np.int64), np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)


class WordCache(dict):
    """Stretches without ASCII white space, and without the marks that end them -> their ids as bytes."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = load(path)
        self.habits = Habits(self.tokenizer)
        #: Strings that the library looks for before anything else, in lower case: texts that have one in any case are its own work.
        self.added = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        mark = ids_of(self.tokenizer, [MARK])[0]
        self.mark = mark[0] if len(mark) == 1 else None
        #: By id: whether it ends a word; none if words have no ends of their own.
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = None
        if suffix:
            self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
            self.ends[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith(suffix)]] = True

    def _alone(self, words: list[bytes]) -> None:
        for w, ids in zip(words, ids_of(self.tokenizer, [w.decode() for w in words]), strict=True):
            self[w] = np.array(ids, "<u4").tobytes()

    def _together(self, words: list[bytes], between: str, edges: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> None:
        """Encode many stretches as one text; ``edges`` finds where each begins and ends in its ids."""
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        texts = [b"\n".join(g).decode().replace("\n", between) for g in groups]
        for group, ids in zip(groups, ids_of(self.tokenizer, texts), strict=True):
            ids = np.array(ids, "<u4")
            begins, ends = edges(ids)
            if len(begins) != len(group):  # a stretch has more ends than its own
                self._alone(group)
                continue
            data = ids.tobytes()
            self.update(zip(group, [data[a:b] for a, b in zip((4 * begins).tolist(), (4 * ends).tolist(), strict=True)], strict=True))

    def _at_ends(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.flatnonzero(self.ends[ids]) + 1
        return np.append(0, ends[:-1]), ends

    def _at_marks(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(ids == self.mark)
        return np.append(0, at + 1), np.append(at, len(ids))

    def _learn(self, words: list[bytes]) -> None:
        """Words of letters have one end at least, so as many ends as words tell them apart; other stretches get marks between them."""
        if self.habits.letters:
            whole = [w for w in words if w.isalpha() and w.islower()]  # of bytes: a-z only
            words = [w for w in words if not (w.isalpha() and w.islower())]
            found = ids_of_model(self.tokenizer, [w.decode() for w in whole])
            data, ends = np.array(list(chain.from_iterable(found)), "<u4").tobytes(), [0, *accumulate(4 * len(x) for x in found)]
            self.update(zip(whole, [data[a:b] for a, b in zip(ends, ends[1:], strict=False)], strict=True))
        plain = [w for w in words if w.decode().isalpha()] if self.ends is not None else []
        rest = list(set(words).difference(plain)) if plain else words
        odd = [w for w in rest if b"\x01" in w] if self.mark is not None else rest
        self._alone(odd)
        self._together(plain, " ", self._at_ends)
        self._together([w for w in rest if b"\x01" not in w] if self.mark is not None else [], f" {MARK} ", self._at_marks)

    def _in_two(self, stretches: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Stretches without the marks that end them and have their own ids, and these marks; empty where there are none."""
        n, cores = len(stretches), pc.ascii_rtrim(stretches, TAIL.decode())
        upto, data = _bytes_of(stretches)
        core_upto, core_data = _bytes_of(cores)
        core_sizes = np.diff(core_upto)
        after = ALNUM[core_data[np.maximum(core_upto[1:], 1) - 1]] if len(core_data) else np.zeros(n, bool)
        sizes = np.where(after & (core_sizes > 0) & self.habits.tail, np.diff(upto) - core_sizes, 0)
        ends = np.append(0, np.cumsum(sizes))
        marks = data[np.repeat(upto[1:] - ends[1:], sizes) + np.arange(ends[-1])]
        tails = pa.StringArray.from_buffers(n, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(marks))
        return pc.if_else(pa.array(sizes > 0), cores, stretches), tails

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text (UTF-8) as little-endian unsigned 32-bit integers."""
        if not self.habits.space:
            return [np.array(ids, "<u4").tobytes() for ids in ids_of(self.tokenizer, [t.decode() for t in texts])]
        lower = [t.lower() for t in texts]  # of bytes: A-Z only, and below ASCII white space only
        own = [any(a in t for a in self.added) for t in lower]
        if any(own):
            whole = iter(ids_of(self.tokenizer, [t.decode() for t, o in zip(texts, own, strict=True) if o]))
            rest = iter(self.encode([t for t, o in zip(texts, own, strict=True) if not o]))
            return [np.array(next(whole), "<u4").tobytes() if o else next(rest) for o in own]
        # Each different stretch of the batch is looked up once; what it has in ids is then dealt to its places.
        lists = pc.ascii_split_whitespace(pa.array(lower if self.habits.case else texts, pa.binary()).view(pa.string()))
        words = lists.flatten()
        kept = pc.binary_length(words).to_numpy() > 0  # white space at an edge of a text gives an empty stretch
        ends = np.append(0, np.cumsum(kept))[np.cumsum(pc.list_value_length(lists).to_numpy())]
        coded = words.filter(pa.array(kept)).dictionary_encode()
        if not len(coded):
            return [b""] * len(texts)
        halves = pa.concat_arrays(self._in_two(coded.dictionary)).dictionary_encode()
        at = halves.indices.to_numpy().reshape(2, -1).T[coded.indices.to_numpy()].ravel()  # two for each stretch
        ends *= 2
        whole = pa.ListArray.from_arrays(pa.array([0, len(halves.dictionary)], pa.int32()), halves.dictionary)
        distinct = pc.binary_join(whole, "\n")[0].as_py().encode().split(b"\n")  # much faster than one by one
        pieces = list(map(self.get, distinct))
        new = [w for w, x in zip(distinct, pieces, strict=True) if x is None and w]
        if len(self) + len(new) > CACHE_ENTRIES:
            self.clear()
        self._learn(new)
        pieces = [self.get(w, b"") if x is None else x for w, x in zip(distinct, pieces, strict=True)]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        starts, lengths = (np.cumsum(sizes) - sizes)[at], sizes[at]
        upto = np.append(0, np.cumsum(lengths))
        places = np.repeat(starts - upto[:-1], lengths) + np.arange(upto[-1])
        ids = np.frombuffer(b"".join(pieces), "<u4")[places].tobytes()
        bounds = (4 * upto[np.append(0, ends)]).tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


_caches: dict[str, WordCache] = {}


def _cache(path: str) -> WordCache:
    if path not in _caches:
        _caches[path] = WordCache(path)
    return _caches[path]


def _segment(part: int, at: int, docs: pa.Array, pieces: list[bytes]) -> pa.RecordBatch:
    ids = np.frombuffer(b"".join(pieces), "<u4")
    lengths = pa.array([[len(p) // 4 for p in pieces]], pa.list_(pa.int64()))
    doc_ids = pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)
    columns = [pa.array([part], pa.int32()), pa.array([at], pa.int32()), pa.array([len(ids)], pa.int64()), doc_ids, lengths, pa.array([encode_segment(ids)], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["part", "segment", "n_ids", "docs", "lengths", "data"])


def write_ids(docs: DataFrame, tokenizer_path: str, path: str, *, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode and write all documents in ascending order of ``id_col``."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, n, ids, pieces = TaskContext.get().partitionId(), 0, 0, [], []
        for batch in batches:
            for row in range(0, batch.num_rows, TEXTS):
                some = batch.slice(row, TEXTS)
                coded = _cache(tokenizer_path).encode([t or b"" for t in some.column(1).cast(pa.binary()).to_pylist()])
                pieces += [c + end for c in coded]
                ids.append(some.column(0))
                n += sum(map(len, coded)) // 4 + len(coded)
                if n >= SEGMENT_IDS:
                    yield _segment(part, at, pa.concat_arrays(ids), pieces)
                    at, n, ids, pieces = at + 1, 0, [], []
        if pieces:
            yield _segment(part, at, pa.concat_arrays(ids), pieces)

    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(2 * shuffle_parts(docs.sparkSession), F.col("doc"), F.xxhash64("text")).sortWithinPartitions("doc", F.xxhash64("text"))
    kind = dict(rows.dtypes)["doc"]
    rows.mapInArrow(run, f"part int, segment int, n_ids bigint, docs array<{kind}>, lengths array<bigint>, data binary").write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc, start, n_tokens, ids_crc32) of every document, from the file."""
    segments = spark.read.parquet(path)
    sizes = segments.select("part", "segment", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_ids")
    offsets = sizes.withColumn("within", within).join(before, "part").select("part", "segment", (F.col("before") + F.col("within")).alias("offset"))
    kind = dict(segments.dtypes)["docs"][6:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lengths = batch.column("lengths")[i].values.to_numpy()
                ends = np.cumsum(lengths)
                data = memoryview(decode_segment(batch.column("data")[i].as_py()).tobytes())
                starts = ends - lengths
                crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                same = lambda c: pa.array(np.full(len(lengths), batch.column(c)[i].as_py(), np.int32))  # noqa: B023, E731
                columns = [same("part"), same("segment"), batch.column("docs")[i].values, pa.array(starts), pa.array(lengths), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "segment", "doc", "start", "n_tokens", "ids_crc32"])

    rows = segments.select("part", "segment", "docs", "lengths", "data").mapInArrow(run, f"part int, segment int, doc {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(offsets, ["part", "segment"]).select("doc", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
