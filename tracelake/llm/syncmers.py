"""Document fingerprints: closed syncmers over words.

A text's units are its words, those longer than 16 code points cut into pieces.
A k-mer of K units is an anchor (a closed syncmer) if the smallest digest of its
S-unit substrings stands first or last in it. The choice depends on the k-mer
alone, so equal passages have equal anchors wherever they stand, which serves
positional matching (``anchor_rows``). Likeness is the share of common anchors
among all distinct anchors of both texts, however many there are. The fingerprint is a
short form, the SIZE smallest distinct anchor digests of the whole text, and
``positions`` tells at which unit each of them stands first.

Everything runs as DataFrame operations. Defined cases: a null text is empty; a
text without words has an empty fingerprint; one with fewer than K units, or
without an anchor, has one anchor, the digest of all its units; two empty
fingerprints are alike (1.0), an empty and another are not (0.0). Equal ids are
ordered by text; null ids come last. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tracelake.llm.common import let, shuffle_parts, stored

K, S, SIZE = 4, 2, 64
UNIT = r"[^\x20\x09-\x0D]{1,16}"


def _units(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), lambda w: F.xxhash64(w))


def _small(digest: Column) -> Column:
    return digest.bitwiseAND(F.lit(0xFFFFFFFF))


def anchors(text: Column) -> Column:
    """array<struct<pos, digest>>: the closed syncmers of a text by the position of their first unit."""

    def edges(h: Column) -> Column:  # h: digests of the S-unit substrings; a k-mer covers K - S + 1 of them
        inner = range(1, K - S)
        last = K - S

        def pick(i: Column) -> Column:
            first, end = F.get(h, i), F.get(h, i + last)
            least = F.least(*[F.get(h, i + j) for j in inner]) if len(inner) > 1 else F.get(h, i + 1)
            chosen = (first <= least) | (end <= least)
            return F.when(chosen, F.struct(i.alias("pos"), _small(F.xxhash64(first, end)).alias("digest")))

        return F.filter(F.transform(F.sequence(F.lit(0), F.size(h) - 1 - last), pick), lambda x: x.isNotNull())

    def pairs(u: Column) -> Column:
        return F.zip_with(F.slice(u, 1, F.size(u) - 1), F.slice(u, 2, F.size(u) - 1), lambda a, b: F.xxhash64(a, b))

    def whole(u: Column) -> Column:
        return F.array(F.struct(F.lit(0).alias("pos"), _small(F.xxhash64(u)).alias("digest")))

    def chosen(u: Column) -> Column:
        many = let(let(pairs(u), edges), lambda found: F.when(F.size(found) > 0, found).otherwise(whole(u)))
        none = F.filter(whole(u), lambda _: F.lit(False))
        return F.when(F.size(u) == 0, none).when(F.size(u) < K, whole(u)).otherwise(many)

    return let(_units(text), chosen)


def anchor_set(text: Column) -> Column:
    """array<struct<digest, pos>>: the distinct anchors of a text by digest, with the first position of each."""

    def firsts(found: Column) -> Column:  # by digest, then position
        return F.filter(found, lambda x, i: (i == 0) | (x["digest"] != F.get(found, i - 1)["digest"]))

    return let(F.array_sort(F.transform(anchors(text), lambda a: F.struct(a["digest"].alias("digest"), a["pos"].alias("pos")))), firsts)


def digests(found: Column) -> Column:
    """The digests of an anchor set as array<int>, half as wide as they are read."""
    return F.transform(found, lambda x: F.when(x["digest"] < 1 << 31, x["digest"]).otherwise(x["digest"] - (1 << 32)).cast("int"))


def likeness(a: Column, b: Column) -> Column:
    """Share of common anchors among all anchors of two texts, from their distinct digests."""
    shared = let(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n).cast("double"))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared)


def as_text(found: Column) -> Column:
    """The SIZE smallest digests of an anchor set, or of its digests, as hex."""
    return F.array_join(F.transform(F.slice(found, 1, SIZE), lambda x: F.lpad(F.lower(F.hex(_small(x.cast("bigint")))), 8, "0")), "")


def anchor_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, digest), one row for each anchor: joined on digest, rows of two documents give their matching positions."""
    return docs.select(F.col(id_col), F.explode(anchors(F.coalesce(F.col(text_col), F.lit("")))).alias("_a")).select(id_col, "_a.pos", "_a.digest")


def with_next(docs: DataFrame, derived: dict[str, Column], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its derived columns, and next_<column> of the text and of these: those of the next document by descending id, after the last of the first.

    Ids are cut at quantiles into buckets that each fit a task (ids that are no
    numbers by a range partitioning, whose rows are written); a window orders each
    bucket on its own. The first document of every bucket, one row a
    bucket, also ends the bucket before it, so no window spans all rows. Only
    the cuts and the largest id of each bucket reach the driver.
    """
    n_buckets = max(2, 4 * shuffle_parts(docs.sparkSession))
    numbers = isinstance(docs.schema[id_col].dataType, NumericType)
    if numbers:
        shares = [i / n_buckets for i in range(1, n_buckets)]
        cuts = sorted(set(docs.agg(F.percentile_approx(id_col, shares, 20 * n_buckets)).first()[0] or []))
        bucket, rows = F.size(F.filter(F.lit(cuts), lambda c: c < F.col(id_col))) if cuts else F.lit(0), docs
    else:
        bucket, rows = F.spark_partition_id(), docs.repartitionByRange(n_buckets, id_col)
    rows = rows.withColumn("_bucket", F.when(F.col(id_col).isNull(), F.lit(-1)).otherwise(bucket).cast("int"))
    rows = rows if numbers else stored(rows, "ranges")
    tops = sorted(rows.groupBy("_bucket").agg(F.max(id_col)).collect(), reverse=True)
    before = {b: tops[i - 1][0] for i, (b, _) in enumerate(tops)}  # the largest bucket comes after the smallest
    goes_to = F.create_map(*[F.lit(x) for kv in (before or {0: 0}).items() for x in kv])
    # Where an id repeats, its rows are ordered by text, so the first is the least.
    firsts = rows.where(F.col(id_col).isin([t for _, t in tops if t is not None]) | F.col(id_col).isNull()).groupBy("_bucket").agg(F.min(text_col).alias(text_col))
    ends = firsts.select(goes_to[F.col("_bucket")].alias("_bucket"), text_col).withColumns(derived).withColumn("_end", F.lit(True))
    both = rows.withColumns(derived).withColumn("_end", F.lit(False)).unionByName(ends, allowMissingColumns=True)
    by = Window.partitionBy("_bucket").orderBy("_end", F.col(id_col).isNull(), F.col(id_col).desc(), F.col(text_col))
    return both.withColumns({f"next_{c}": F.lead(c).over(by) for c in (text_col, *derived)}).where("not _end").drop("_bucket", "_end")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last third comes from the next document."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col))
    # A text's digests and positions travel with it, so that each text is parsed once.
    parsed = let(anchor_set(F.col(text_col)), lambda a: F.struct(digests(a).alias("own"), F.transform(F.slice(a, 1, SIZE), lambda x: x["pos"]).alias("at")))
    rows = with_next(rows, {"_set": parsed}, id_col=id_col, text_col=text_col)
    n = F.length(text_col)
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col(text_col), F.lit(1), n - third), F.substring(F.col(f"next_{text_col}"), F.lit(1), third))
    rows = rows.select(id_col, n.cast("long").alias("n_chars"), F.col("_set.own").alias("_own"), F.col("_set.at").alias("_at"), F.col("next__set.own").alias("_follow"), edited.alias("_edited"))
    rows = rows.withColumn("_new", digests(anchor_set(F.col("_edited"))))
    return rows.select(
        id_col,
        "n_chars",
        F.sha2("_edited", 256).alias("edited_sha256"),
        as_text(F.col("_own")).alias("fingerprint"),
        as_text(F.col("_new")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_new")).alias("near_edited"),
        likeness(F.col("_own"), F.col("_follow")).alias("near_next"),
        F.col("_at").alias("positions"),
    )
