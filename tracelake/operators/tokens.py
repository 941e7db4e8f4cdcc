"""Token tables: vocabularies, tokenising, time unwrapping, packing, collating, as-of lookups."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions.codecs import IMAGE, decode_event, encode_event, tokens, vocabulary
from tracelake.operators.ordered import NextFit, ordered_scan


def image_pattern(prefix: str, token: str, length: int, suffix: str) -> Column:
    return F.concat(F.lit(prefix), F.repeat(F.lit(token), length), F.lit(suffix))


def extend_vocabulary(base: dict[str, int], new: list[str]) -> dict[str, int]:
    """``base`` with the new tokens appended in sorted order; those that exist keep their ids."""
    missing = sorted(set(new) - set(base))
    first = max(base.values(), default=-1) + 1
    return base | {t: first + i for i, t in enumerate(missing)}


def require_tokens(vocab: dict[str, int], form: str) -> None:
    missing = [t for t in vocabulary(form) if t not in vocab]
    if missing:
        raise ValueError(f"{len(missing)} event tokens are not in the vocabulary, such as {missing[0]}")


def vocab_lookup(vocab: dict[str, int]) -> Callable[[Column], Column]:
    """token -> id: literal maps by the token's crc32, of two entries or so each, as Spark scans a map's keys one by one."""
    n = max(1, len(vocab) // 2)
    parts: list[dict[str, int]] = [{} for _ in range(n)]
    for token, i in vocab.items():
        parts[zlib.crc32(token.encode()) % n][token] = i
    none = F.create_map().cast("map<string,int>")
    table = F.array(*[F.create_map(*[F.lit(x) for kv in p.items() for x in kv]) if p else none for p in parts])
    return lambda token: F.get(table, (F.crc32(token) % n).cast("int"))[token]


def id_lookup(vocab: dict[str, int]) -> Callable[[Column], Column]:
    """id -> token: the places of a literal array from the smallest id on; ids of a vocabulary have few gaps."""
    low, high = min(vocab.values(), default=0), max(vocab.values(), default=-1)
    if high - low > 4 * len(vocab) + 1000:
        table = F.create_map(*[F.lit(x) for t, i in vocab.items() for x in (i, t)])
        return lambda i: table[i]
    places: list[str | None] = [None] * (high - low + 1)
    for token, i in vocab.items():
        places[i - low] = token
    table = F.array(*[F.lit(t) for t in places]).cast("array<string>")
    return lambda i: F.when(i >= low, F.get(table, i - low))


def token_ids(text: Column, vocab: dict[str, int]) -> Column:
    """Ids of a text's tokens; null for a token out of the vocabulary."""
    return F.transform(tokens(text), vocab_lookup(vocab))


def tokenize(events: DataFrame, vocab: dict[str, int], *, form: str = "compact", image: Column | None = None) -> DataFrame:
    """``events`` with text, token_ids, total_token_count, and valid: whether all tokens are in the vocabulary."""
    text = encode_event(F.col("topic"), F.col("ts_ns"), F.col("payload"), form)
    if image is not None:
        text = F.replace(text, F.lit(IMAGE), image)
    # A filter that needs a row's number stays above the text, which would else be made a second time below.
    rows = events.withColumns({"text": text, "_row": F.monotonically_increasing_id()}).where("text is not null and _row >= 0").drop("_row")
    rows = rows.withColumn("token_ids", token_ids(F.col("text"), vocab))
    return rows.withColumns({"total_token_count": F.size("token_ids"), "valid": F.forall("token_ids", lambda x: x.isNotNull())})


def detokenize(ids: Column, vocab: dict[str, int], image: str | None = None) -> Column:
    """Text of ids; the image pattern becomes the placeholder again."""
    text = F.array_join(F.transform(ids, id_lookup(vocab)), "")
    return text if image is None else F.replace(text, F.lit(image), F.lit(IMAGE))


def unwrap(rows: DataFrame, span: int, *, time: str = "t", keys: tuple[str, ...] = ("episode",), order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """``time`` made monotonic: each fall below the row before adds one ``span``."""
    by = Window.partitionBy(*keys).orderBy(*order)
    fell = F.coalesce((F.col(time) < F.lag(time).over(by)).cast("long"), F.lit(0))
    rows = rows.withColumn("_fell", fell)
    return rows.withColumn(time, F.col(time) + span * F.sum("_fell").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_fell")


def decode_episode(texts: DataFrame, *, form: str = "compact", span_ns: int = 10_000_000_000, text: str = "text") -> DataFrame:
    """Events of each episode's token text, what does not decode left out, times unwrapped."""
    found = F.regexp_extract_all(F.col(text), F.lit("(?s)<EVENT_START>.*?<EVENT_END>"), F.lit(0))
    rows = texts.select("episode", F.posexplode(found).alias("seq", "event")).withColumn("d", decode_event(F.col("event"), form)).where("d is not null")
    return unwrap(rows.select("episode", "seq", F.col("d.ts_ns").alias("t"), "d"), span_ns)


def pack(rows: DataFrame, capacity: int, *, length: str = "total_token_count", keys: tuple[str, ...] = ("episode",), order: tuple[str, ...] = ("ts_ns", "seq"), counters: Observation | None = None) -> DataFrame:
    """``rows`` with seq_no: sequences filled in order, never across episodes; rows longer than the capacity go.

    ``counters`` observe rows, skipped (too long) and tokens of what is packed, in the same pass.
    """
    placed = ordered_scan(rows, list(keys), list(order), [length], partial(NextFit, capacity), "seq_no", "int")
    if counters is not None:
        kept = F.col("seq_no").isNotNull()
        placed = placed.observe(counters, F.count(F.lit(1)).alias("rows"), F.count(F.when(~kept, 1)).alias("skipped"), F.coalesce(F.sum(F.when(kept, F.col(length).cast("bigint"))), F.lit(0).cast("bigint")).alias("tokens"))
    return placed.where("seq_no is not null")


def pad_id_of(vocab: dict[str, int], names: tuple[str, ...] = ("<pad>", "<eos>")) -> int:
    """The id that pads sequences: that of the first name that the vocabulary has; ValueError if it has none."""
    for name in names:
        if name in vocab:
            return vocab[name]
    raise ValueError(f"the vocabulary has none of {', '.join(names)}")


def pack_sequences(rows: DataFrame, capacity: int, pad_id: int, *, keys: tuple[str, ...] = ("episode",), order: tuple[str, ...] = ("ts_ns", "seq"), counters: Observation | None = None) -> DataFrame:
    """(episode, seq_no, input_ids, attention_mask, texts, n_events): ids joined and padded to ``capacity``."""
    packed = pack(rows, capacity, keys=keys, order=order, counters=counters)
    parts = F.sort_array(F.collect_list(F.struct(*order, "token_ids", "text")))
    out = packed.groupBy(*keys, "seq_no").agg(parts.alias("p")).withColumn("ids", F.flatten(F.transform("p", lambda x: x["token_ids"])))
    pad = lambda n: F.array_repeat(F.lit(n), F.lit(capacity) - F.size("ids"))
    return out.select(
        *keys,
        "seq_no",
        F.concat("ids", pad(pad_id)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.size("ids")), pad(0)).alias("attention_mask"),
        F.array_join(F.transform("p", lambda x: x["text"]), "").alias("texts"),
        F.size("p").alias("n_events"),
    )


def skip_actions(rows: DataFrame, is_action: Column, skip_ns: int, *, keys: tuple[str, ...] = ("episode", "seq_no")) -> DataFrame:
    """Action rows before the sequence's first other row plus ``skip_ns`` go."""
    whole = Window.partitionBy(*keys)
    first = F.min(F.when(~is_action, F.struct("ts_ns", "seq"))).over(whole)["ts_ns"]
    return rows.withColumn("_from", first + skip_ns).where(~is_action | F.col("_from").isNull() | (F.col("ts_ns") >= F.col("_from"))).drop("_from")


def shift_actions(rows: DataFrame, is_action: Column, shift_ns: int, *, keys: tuple[str, ...] = ("episode", "seq_no")) -> DataFrame:
    """Action times shifted, and ``place``: the stable order by the new times in each sequence. Texts stay."""
    order = Window.partitionBy(*keys)
    rows = rows.withColumn("_place", F.row_number().over(order.orderBy("ts_ns", "seq"))).withColumn("ts_ns", F.col("ts_ns") + F.when(is_action, shift_ns).otherwise(0))
    return rows.withColumn("place", F.row_number().over(order.orderBy("ts_ns", "_place"))).drop("_place")


def packing_counters(rows: DataFrame, capacity: int, length: str = "total_token_count") -> DataFrame:
    """Rows too long, tokens kept: for the report beside a packing."""
    return rows.agg(F.count(F.when(F.col(length) > capacity, 1)).alias("skipped"), F.sum(F.when(F.col(length) <= capacity, F.col(length))).cast("long").alias("tokens"))


def labels_of(ids: Column, ignored: list[int]) -> Column:
    """Training labels: ids, with -100 for padding and image tokens."""
    return F.transform(ids, lambda i: F.when(i.isin(ignored), -100).otherwise(i))


def collate(samples: DataFrame, batch_size: int, max_length: int, ignored: list[int], *, order: tuple[str, ...]) -> DataFrame:
    """Samples with labels, batch number and the batch's largest number of images; longer samples are an error.

    Batches are numbered inside blocks of rows that a hash of the order columns
    deals out, so numbering needs no single task; ``order`` must tell rows apart.
    """
    long = F.when(F.size("input_ids") > max_length, F.raise_error(F.lit("a sample is longer than the model allows")).cast("array<int>"))
    rows = samples.withColumn("input_ids", F.coalesce(long, F.col("input_ids"))).withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(64)))
    number = F.floor((F.row_number().over(Window.partitionBy("_block").orderBy(*order)) - 1) / batch_size)
    rows = rows.withColumn("batch", F.struct(F.col("_block"), number.cast("long").alias("number"))).drop("_block")
    return rows.withColumns({"labels": labels_of(F.col("input_ids"), ignored), "max_images": F.max(F.size("images")).over(Window.partitionBy("batch"))})


def mean_embeddings(members: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, place, value): element-wise means of vectors, for tokens described by others."""
    rows = members.select(group, F.posexplode(vector).alias("place", "x"))
    return rows.groupBy(group, "place").agg(F.avg("x").alias("value"))


def asof(queries: DataFrame, frames: DataFrame, *, forward: bool = True, keys: tuple[str, ...] = ("episode",), time: str = "ts_ns", value: str = "frame") -> DataFrame:
    """``queries`` with ``value`` of the first frame at or after their time (or the last at or before it); null without one."""
    both = queries.withColumns({"_q": F.lit(1), "_f": F.lit(None).cast(dict(frames.dtypes)[value])}).unionByName(
        frames.select(*keys, time, F.col(value).alias("_f")).withColumn("_q", F.lit(0)), allowMissingColumns=True
    )
    order = Window.partitionBy(*keys).orderBy(time, F.col("_q").desc() if forward else F.col("_q"))
    frame = order.rowsBetween(Window.currentRow, Window.unboundedFollowing) if forward else order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pick = F.first("_f", ignorenulls=True) if forward else F.last("_f", ignorenulls=True)
    return both.withColumn(value, pick.over(frame)).where("_q = 1").drop("_q", "_f")


def concat_shuffled(parts: list[DataFrame], seed: int, *, order: tuple[str, ...]) -> DataFrame:
    """Parts joined, with a reproducible shuffle key."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("shuffle_key", F.xxhash64(F.lit(seed), *order))


def vocabulary_frame(spark: SparkSession, form: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(vocabulary(form))), "id int, token string")
