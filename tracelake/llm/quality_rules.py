"""Quality rules: fixed base rules, and adaptive thresholds from mergeable quantile sketches.

``text_features`` counts per text; ``quantile_sketch`` adds up log-linear
histograms per language and source; ``thresholds`` reads quantiles off them;
``quality_rules`` joins the thresholds back and gives the verdicts. Everything
runs as DataFrame operations.

The sketch: a value below 256 is its own bin; a larger one is binned by its top
eight bits, so a bin's width is at most 1/128 of its values. Bins are integers and
counts add up, so sketches merge in any order to the same result. A language
and source that holds a third of all rows reaches a task only as one row for
each bin and map task.

Thresholds come from the data alone: a measure's fence is ``high + spread * (high -
low)`` of two quantiles of the texts that pass the base rules. A source with fewer
than LEAST_ROWS such texts takes the fence of its language's merged sketch. No fence
is above CAP times the source's own median or the median of the fences of the
language's larger sources, each of which counts once, whichever is more: a source
where less than half is junk can't raise its own. A text fails if
one of its measures lies above the fence and what it counts occurs at least
``evidence`` times, so that one mark in a short text decides nothing.

Defined cases: a null text has no words and fails the base; null languages and
sources form groups of their own; a group none of whose texts pass the base has no
fences; an empty table gives an empty result; rows that repeat are judged alike.
Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import WORD, let, stored

WINDOW = 5
#: The measures, integers per text (1000 times a ratio): hundredths of the low and the high quantile, spread, what is counted, evidence.
MEASURES = {
    "symbols": (50, 90, 4, "n_symbols", 3),  # of #*$%&|<> per word
    "bangs": (50, 90, 4, "n_bangs", 3),  # exclamation marks per word
    "word_length": (25, 75, 4, "n_words", 1),  # code points per word
    "repeats": (50, 95, 4, "n_repeat_words", 15),  # repeated words per word
    "dup_lines": (50, 97, 1, "n_dup_lines", 3),  # repeated lines per line with a word
}
#: Texts from which a source has fences of its own; bound of its fences, in hundredths of the medians.
LEAST_ROWS, CAP = 30, 150


def repeat_words(words: Column) -> Column:
    """Words in 5-word windows that occur twice or more in the list, the first included.

    Windows are told apart by a 64-bit digest of their words. Sorted by digest,
    equal windows are neighbours; the positions so found are sorted again and
    their overlaps taken off. No step is more than n log n.
    """

    def covered(starts: Column) -> Column:
        follow = F.zip_with(starts, F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(follow, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def repeated(digests: Column) -> Column:
        marked = let(
            F.array_sort(F.transform(digests, lambda d, i: F.struct(d.alias("d"), i.alias("i")))),
            lambda s: F.filter(
                F.transform(s, lambda x, i: F.when((x["d"] == F.get(s, i - 1)["d"]) | (x["d"] == F.get(s, i + 1)["d"]), x["i"])),
                lambda p: p.isNotNull(),
            ),
        )
        return F.when(F.size(digests) == F.size(F.array_distinct(digests)), F.lit(0).cast("long")).otherwise(let(F.sort_array(marked), covered))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    def counted(w: Column) -> Column:
        return F.when(F.size(w) <= WINDOW, F.lit(0).cast("long")).otherwise(let(windows(w), repeated))

    return let(words, counted)


def text_features(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_bangs and n_lines_worded (all long)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    worded = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    counts = let(
        words,
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words")),
    )
    lines = let(worded, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    return (
        docs.withColumns({"_counts": counts, "_lines": lines})
        .withColumns(
            {
                "n_words": F.col("_counts.n_words"),
                "word_chars": (F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long"),
                "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
                "n_dup_lines": F.col("_lines.dup"),
                "n_repeat_words": F.col("_counts.n_repeat_words"),
                "n_bangs": F.regexp_count(text, F.lit("!")).cast("long"),
                "n_lines_worded": F.col("_lines.n"),
            }
        )
        .drop("_counts", "_lines")
    )


def base_failed(features: DataFrame) -> DataFrame:
    return features.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def measures() -> dict[str, Column]:
    """The integer measures of a row of features."""

    def ratio(a: str, b: str) -> Column:
        return F.expr(f"coalesce(({a} * 1000) div nullif({b}, 0), 0L)")

    return {
        "symbols": ratio("n_symbols", "n_words"),
        "bangs": ratio("n_bangs", "n_words"),
        "word_length": ratio("word_chars", "n_words"),
        "repeats": ratio("n_repeat_words", "n_words"),
        "dup_lines": ratio("n_dup_lines", "n_lines_worded"),
    }


def bin_of(value: Column) -> Column:
    """Bin of a non-negative integer: itself below 256, then 128 bins for each power of two."""
    shift = F.length(F.bin(value)) - 8
    top = F.call_function("shiftright", value, shift)
    return F.when(value < 256, value).otherwise(shift * 256 + top).cast("long")


def bin_top(code: Column) -> Column:
    """The largest value of a bin."""
    shift = F.floor(code / 256).cast("int")
    return F.when(code < 256, code).otherwise(F.call_function("shiftleft", (code - shift * 256 + 1).cast("long"), shift) - 1)


def quantile_sketch(rows: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """(keys, measure, code, n): mergeable histograms; n adds up over any parts."""
    pairs = F.array(*[F.struct(F.lit(k).alias("measure"), bin_of(v).alias("code")) for k, v in values.items()])
    return rows.select(*keys, F.explode(pairs).alias("p")).groupBy(*keys, "p.measure", "p.code").agg(F.count(F.lit(1)).alias("n"))


def by_measure(field: int) -> Column:
    """A field of MEASURES for the row's measure."""
    return F.create_map(*[F.lit(x) for m, spec in MEASURES.items() for x in (m, spec[field])])[F.col("measure")]


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, n, middle, fence) from a sketch: n texts, their median, and the fence of their quantiles' bin tops."""
    by = Window.partitionBy(*keys, "measure")
    ranked = sketch.withColumns({"upto": F.sum("n").over(by.orderBy("code")), "total": F.sum("n").over(by)})
    at = lambda share: F.min(F.when(100 * F.col("upto") >= share * F.col("total"), F.col("code")))
    found = ranked.groupBy(*keys, "measure").agg(F.first("total").alias("n"), at(by_measure(0)).alias("low"), at(by_measure(1)).alias("high"), at(F.lit(50)).alias("middle"))
    low, high = bin_top(F.col("low")), bin_top(F.col("high"))
    return found.select(*keys, "measure", "n", bin_top(F.col("middle")).alias("middle"), (high + by_measure(2) * (high - low)).alias("fence"))


def thresholds(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fence_<measure>...): one row for each language and source with texts that pass the base."""
    sketch = stored(quantile_sketch(base_failed(rows).where("not base_failed"), keys, measures()), "sketch")
    above = keys[:-1]
    own, parent = fences(sketch, keys), fences(sketch.groupBy(*above, "measure", "code").agg(F.sum("n").alias("n")), above)
    # One value for each source; fences are bin tops and sums of two of them, so few are distinct.
    medians = own.where(F.col("n") >= LEAST_ROWS).groupBy(*above, "measure").agg(F.expr("percentile_disc(0.5) within group (order by fence)").alias("median"))
    beside = _beside(parent, medians, [*above, "measure"]).select(*above, "measure", F.col("fence").alias("merged"), F.col("median").cast("long").alias("median"))
    both = _beside(own, beside, [*above, "measure"])
    fence = F.least(F.when(F.col("n") >= LEAST_ROWS, F.col("fence")).otherwise(F.col("merged")), F.expr(f"{CAP}L * greatest(median, middle) div 100"))
    found = both.select(*keys, "measure", fence.alias("fence"))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("measure") == m, F.col("fence"))).alias(f"fence_{m}") for m in MEASURES])


def _beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of ``left`` with the columns of ``right`` that has equal keys; nulls are equal."""
    names = {k: f"_right_{k}" for k in keys}
    right = right.withColumnsRenamed(names)
    same = F.lit(True)
    for k, name in names.items():
        same = same & F.col(k).eqNullSafe(F.col(name))
    return left.join(right, same, "left").drop(*names.values())


def judge(rows: DataFrame, limits: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (features) with base_failed and kept."""
    joined = _beside(base_failed(rows), limits, keys)
    above = F.lit(False)
    for m, value in measures().items():
        above = above | F.coalesce((value > F.col(f"fence_{m}")) & (F.col(MEASURES[m][3]) >= MEASURES[m][4]), F.lit(False))
    # One predicate of both sides: a part that needs the left side only would be pushed below the join and count the words twice.
    kept = F.greatest(F.col("base_failed").cast("int"), above.cast("int")) == 0
    return joined.withColumn("kept", kept).drop(*[f"fence_{m}" for m in MEASURES])


def quality_features(docs: DataFrame, *, keys: tuple[str, ...] = ("lang", "source"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verdicts without texts: id, keys, the counts, base_failed, kept."""
    features = stored(text_features(docs.select(id_col, *keys, text_col), text_col=text_col).drop(text_col), "quality")
    return judge(features, thresholds(features, list(keys)), list(keys))


def quality_rules(docs: DataFrame, *, keys: tuple[str, ...] = ("lang", "source"), text_col: str = "text") -> DataFrame:
    """The documents that are kept, with the columns of ``docs``.

    Features are counted once and written beside their rows: the sketches then
    read the counts alone, and no text is shuffled to meet its verdict. Rows that
    repeat an id need no care.
    """
    # The row travels as one column, so that no name of its own meets one of the rules'.
    rows = docs.select(F.struct("*").alias("_row"), *keys, text_col)
    features = stored(text_features(rows, text_col=text_col).drop(text_col), "quality")
    limits = stored(thresholds(features, list(keys)), "fences")
    return judge(features, limits, list(keys)).where("kept").select("_row.*")
