"""Substring dedup: digests of lines and of pieces of long lines, first occurrence kept, offsets retained.

A unit is a line; lines of fewer than ``min_words`` words that follow each other are
one paragraph. A unit of more than LONG words is cut into pieces after each word
whose digest is the least among the REACH words to either side, so that a passage is
cut alike wherever it stands. Units are normalised (A-Z lower-cased, white space
single) and hashed to 128 bits. Digests are counted with map-side combine; the
earliest occurrence by (id, position) stays. The others go where all units of their
text are repeated, as an exact copy's are, or where they stand in a run of repeated
units of at least ``min_run`` words: a short sentence that many texts share is no
passage, and units of fewer than ``min_words`` words go with a run, but do not make
one. They are listed with their offsets in the original text (code points) and the
occurrence that stays.

Texts are parsed once: units are written, and so are the first occurrences, so that
Spark can split a digest that holds a third of all rows when the two meet.

Defined cases: null texts and ids have no units; repeats inside one document
count; rows with equal ids rank by position only; an empty table gives an empty
result. Extra columns are kept, whatever their names; ``removed`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import let, stored

LONG, REACH = 24, 5
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def cut_after(digests: np.ndarray) -> np.ndarray:
    """Indices of the words after which a long line is cut."""
    if len(digests) <= 2 * REACH:
        return np.empty(0, np.int64)
    around = sliding_window_view(digests, 2 * REACH + 1)
    here = digests[REACH:-REACH]
    first = around[:, : REACH + 1].argmin(axis=1) == REACH  # no word before it is as small
    return np.flatnonzero(first & (around.min(axis=1) == here)) + REACH


def units(text: str, min_words: int) -> list[tuple[bytes, int, int, int, int, int]]:
    """(digest, start, end, place, n_words, n_units) of each unit: offsets in code points, place among the n_units of the text."""
    raw = text.encode("utf-8", "replace")
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return []
    white = _WHITE[data]
    edge = np.flatnonzero(np.diff(white.astype(np.int8), prepend=1, append=1))
    begins, ends = edge[0::2], edge[1::2]  # of words, in bytes
    if not len(begins):
        return []
    lead = (data & 0xC0) != 0x80
    point = np.concatenate([[0], np.cumsum(lead)])  # bytes -> code points
    words = raw.lower().split()
    line = np.searchsorted(np.flatnonzero(data == 10), begins)
    starts = np.flatnonzero(np.diff(line, prepend=-1))
    short = np.diff(starts, append=len(words)) < min_words
    starts = starts[~(short & np.append(False, short[:-1]))]  # a short line joins one before it
    out = []
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(words)], strict=True):
        marks = [a, b]
        if b - a > LONG:
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, words[a:b]), np.uint64, b - a)
            marks = [a, *(cut_after(h) + a + 1).tolist(), b]
        for i, j in zip(marks, marks[1:], strict=False):
            out.append((xxhash.xxh3_128_digest(b" ".join(words[i:j])), int(point[begins[i]]), int(point[ends[j - 1]]), len(out), j - i))
    return [(*x, len(out)) for x in out]


def unit_rows(docs: DataFrame, *, min_words: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(digest, doc, start, end, place, n_words, n_units) of every unit."""
    names = ["digest", "start", "end", "place", "n_words", "n_units"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [units(text.as_py(), min_words) for text in part.column(1)]
                rows = [x for some in found for x in some]
                doc = part.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(some) for some in found]), pa.int32()))
                columns = [pa.array([x[k] for x in rows], pa.int32() if k else pa.binary()) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([doc, *columns], names=["doc", *names])

    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).where("doc is not null and text is not null")
    return rows.mapInArrow(run, f"doc {dict(rows.dtypes)['doc']}, digest binary, start int, end int, place int, n_words int, n_units int")


def repeated_units(docs: DataFrame, *, min_words: int = 6, min_run: int = 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, start, end, first_doc, first_start) of every unit that occurs earlier, in a run of such units that is long enough or in a text of nothing else; to be removed."""
    rows = stored(unit_rows(docs, min_words=min_words, id_col=id_col, text_col=text_col), "units")
    first = rows.groupBy("digest").agg(F.min(F.struct("doc", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    found = rows.join(stored(first, "firsts"), "digest").where("struct(doc, start) > first")
    # Places that follow each other differ from their rank by the same number; equal places come from rows with equal ids.
    rank = F.dense_rank().over(Window.partitionBy("doc").orderBy("place"))
    runs = found.withColumn("rank", rank).withColumn("run", F.col("place") - F.col("rank"))
    long = F.when(F.col("n_words") >= min_words, F.col("n_words")).otherwise(0)
    runs = runs.withColumn("words", F.sum(long).over(Window.partitionBy("doc", "run"))).withColumn("ranks", F.max("rank").over(Window.partitionBy("doc")))
    runs = runs.where((F.col("words") >= min_run) | (F.col("ranks") == F.col("n_units")))
    return runs.select("doc", "start", "end", F.col("first.doc").alias("first_doc"), F.col("first.start").alias("first_start"))


def substring_dedup(docs: DataFrame, *, min_words: int = 6, min_run: int = 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the repeated units in its texts, plus ``removed``: (start, end) of each in the original text."""
    spans = repeated_units(docs, min_words=min_words, min_run=min_run, id_col=id_col, text_col=text_col)
    spans = spans.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    # The row travels as one column, so that no name of its own meets one of the spans'.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*[c for c in docs.columns if c not in (text_col, "removed")]).alias("row"))
    joined = rows.join(spans, F.col("id") == F.col("doc"), "left")
    begins = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["end"]))
    ends = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.length("text")))
    # Texts become arrays of code points, so that each cut costs its own length only.
    cut = let(F.split("text", ""), lambda t: F.array_join(F.flatten(F.zip_with(begins, ends, lambda a, b: F.slice(t, a + 1, F.greatest(b - a, F.lit(0))))), ""))
    none = F.array().cast("array<struct<start:int,end:int>>")
    new = F.struct(F.when(F.col("spans").isNull(), F.col("text")).otherwise(cut).alias(text_col), F.coalesce("spans", none).alias("removed"))
    return joined.select("row", new.alias("new")).select("row.*", "new.*")
