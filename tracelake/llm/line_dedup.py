"""Line dedup: digests of normalised lines, first occurrences by range order, keep bitmaps.

A line's key is the line stripped of white space with A-Z lower-cased. Keys of
at least ``min_chars`` code points found in at least ``min_docs`` documents stay
only in the document with the largest id. Everything runs as DataFrame
operations. The result is one keep bitmap per document with drops, compressed as
its runs of dropped lines, never text.

Texts are read once for their digests, which are written. Digests are range-
partitioned by (digest, band), a band being a share of the documents, so that the
range splits a digest that holds a third of all rows; each partition is sorted by
document and position and streams its rows: a row begins a document where the row
before it has another. A digest's bands add up to its number of documents and its
first one.

Defined cases: a null or empty text is one empty line; repeated lines of one
document count once for the document number; a null ``doc_id`` takes no part
(all its lines stay); rows that repeat a ``doc_id`` count as one document; an
empty table gives an empty result. Extra columns are kept, whatever their names;
``n_lines`` and ``n_dropped`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import ascii_lower, let, shuffle_parts, stored, strip_space


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_digests(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(digest, doc, pos): one row for each line with a long enough key."""
    rows = docs.select(F.col(id_col).alias("doc"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line")).where("doc is not null")
    key = strip_space(F.col("line"))
    rows = rows.where(F.length("line") >= min_chars).select("doc", "pos", key.alias("key")).where(F.length("key") >= min_chars)
    return rows.select(F.unhex(F.md5(ascii_lower(F.col("key")))).alias("digest"), "doc", "pos")


def first_documents(occurrences: DataFrame, min_docs: int) -> DataFrame:
    """(digest, first_doc) of the digests found in at least ``min_docs`` documents.

    The window and the first aggregate find the rows in place: a range by (digest,
    band) keeps each pair of them in one partition. Only one row for each pair is
    shuffled after that.
    """
    parts = shuffle_parts(occurrences.sparkSession)
    banded = occurrences.withColumn("band", F.pmod(F.xxhash64("doc"), F.lit(parts)))
    ranged = banded.repartitionByRange(parts, "digest", "band").sortWithinPartitions("digest", "band", F.col("doc").desc(), "pos")
    order = Window.partitionBy("digest", "band").orderBy(F.col("doc").desc(), "pos")
    begins = F.coalesce(F.lag("doc").over(order) != F.col("doc"), F.lit(True))
    bands = ranged.select("digest", "band", "doc", begins.alias("begins")).where("begins").groupBy("digest", "band").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("doc"))
    return bands.groupBy("digest").agg(F.sum("n").alias("n"), F.max("doc").alias("first_doc")).where(F.col("n") >= min_docs).drop("n")


def dropped_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc, pos) of every line to drop."""
    occurrences = stored(line_digests(docs, id_col, text_col, min_chars), "lines")
    # Written, so that Spark can broadcast them by their size or split the occurrences of one digest.
    first = stored(first_documents(occurrences, min_docs), "digests")
    return occurrences.join(first, "digest").where(F.col("doc") < F.col("first_doc")).select("doc", "pos")


def keep_bitmaps(dropped: DataFrame) -> DataFrame:
    """(doc, n_dropped, dropped_runs): the run-length form of the keep bitmap.

    ``dropped_runs`` holds (first, n) of each run of dropped lines in order;
    every other line of the document is kept.
    """
    drops = dropped.groupBy("doc").agg(F.sort_array(F.collect_set("pos")).alias("pos"))
    # A run begins where the position before it is not dropped; its rank in pos gives the runs' lengths.
    starts = let(
        F.col("pos"),
        lambda pos: F.filter(
            F.transform(pos, lambda p, i: F.when((i == 0) | (p != F.get(pos, i - 1) + 1), F.struct(p.alias("first"), i.alias("rank")))),
            lambda s: s.isNotNull(),
        ),
    )
    marked = drops.select("doc", F.size("pos").alias("n"), starts.alias("starts"))
    runs = let(
        F.col("starts"),
        lambda s: F.transform(s, lambda x, i: F.struct(x["first"].alias("first"), (F.coalesce(F.get(s, i + 1)["rank"], F.col("n")) - x["rank"]).alias("n"))),
    )
    return marked.select("doc", F.col("n").cast("long").alias("n_dropped"), runs.alias("dropped_runs"))


def apply_bitmap(lines: Column, runs: Column) -> Column:
    """``lines`` without the dropped runs, joined by newline; linear in the number of lines."""

    def kept(all_lines: Column) -> Column:
        begins = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["first"] + r["n"]))
        ends = F.concat(F.transform(runs, lambda r: r["first"]), F.array(F.size(all_lines)))
        return F.array_join(F.flatten(F.zip_with(begins, ends, lambda a, b: F.slice(all_lines, a + 1, b - a))), "\n")

    return let(lines, kept)


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with its text replaced by the kept lines, plus ``n_lines`` and ``n_dropped``."""
    bitmaps = keep_bitmaps(dropped_lines(docs, id_col=id_col, text_col=text_col, min_chars=min_chars, min_docs=min_docs))
    # The row travels as one column, so that no name of its own meets one of the bitmaps'.
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(*[c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]).alias("row"))
    joined = rows.join(bitmaps, F.col("id") == F.col("doc"), "left")
    kept = F.when(F.col("dropped_runs").isNull(), F.col("text")).otherwise(apply_bitmap(lines_of(F.col("text")), F.col("dropped_runs")))
    n_lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    new = F.struct(kept.alias(text_col), n_lines.cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"))
    return joined.select("row", new.alias("new")).select("row.*", "new.*")
