"""Stage chain: events to intervals, resampled events, bins or tokens, packed sequences."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tracelake.functions.codecs import encode_event
from tracelake.operators import bins, intervals, resample, tokens
from tracelake.plans.extractors import Extractor, everything
from tracelake.schema import stage_of
from tracelake.sources.logs import save_settings


@dataclass(frozen=True)
class EventConfig:
    rates_hz: dict[str, float] = field(default_factory=dict)
    keep_topics: tuple[str, ...] | None = None
    extractor: Extractor = field(default_factory=everything)
    least_ns: int = 0


def event_stage(logs: DataFrame, config: EventConfig) -> DataFrame:
    """Events of the kept topics inside the extracted intervals, resampled anew in each interval."""
    wanted = intervals.longer_than(config.extractor(logs), config.least_ns)
    kept = logs if config.keep_topics is None else logs.where(F.col("topic").isin(list(config.keep_topics)))
    inside = intervals.inside(kept, wanted)
    return resample.resample(inside, config.rates_hz, keys=("episode", "start_ns")).drop("start_ns", "end_ns")


def binned_stage(events: DataFrame, fps: float, is_state: Column, is_action: Column, **options: object) -> DataFrame:
    return bins.time_bins(events, int(1e9 / fps), is_state, is_action, **options)


def tokenized_stage(events: DataFrame, vocab: dict[str, int], form: str = "compact", image: Column | None = None) -> DataFrame:
    tokens.require_tokens(vocab, form)
    return tokens.tokenize(events, vocab, form=form, image=image)


def packed_stage(tokenized: DataFrame, capacity: int, pad_id: int, *, with_images_only: bool = False) -> DataFrame:
    """Sequences of one episode each; those without a screen row go if ``with_images_only``."""
    rows = tokenized.where("valid")
    if with_images_only:
        packed = tokens.pack(rows, capacity)
        seen = packed.groupBy("episode", "seq_no").agg(F.max((F.col("topic") == "screen").cast("int")).alias("has")).where("has = 1").drop("has")
        return tokens.pack_sequences(rows, capacity, pad_id).join(seen, ["episode", "seq_no"], "left_semi")
    return tokens.pack_sequences(rows, capacity, pad_id)


def write_packed(tokenized: DataFrame, path: str, capacity: int, pad_id: int, *, split: str | None = None, settings: dict[str, object] | None = None) -> dict[str, int]:
    """Write packed sequences and what was counted while they were written, beside their settings; returns the counters.

    rows, skipped (longer than ``capacity``) and tokens come from the packing plan,
    sequences, events and padding from what is written: no second scan. With ``split``, a
    column that is one for all rows of an episode, each of its values gets a folder.
    """
    plan, out = Observation("packing"), Observation("sequences")
    rows = tokenized.where("valid")
    keys = ("episode",) if split is None else (split, "episode")
    packed = tokens.pack_sequences(rows, capacity, pad_id, keys=keys, counters=plan)
    padding = F.sum(F.size("attention_mask") - F.aggregate("attention_mask", F.lit(0), lambda n, m: n + m))
    packed = packed.observe(out, F.count(F.lit(1)).alias("sequences"), F.coalesce(F.sum("n_events"), F.lit(0)).alias("events"), F.coalesce(padding, F.lit(0)).cast("bigint").alias("padding"))
    (packed.write.partitionBy(split) if split else packed.write).parquet(f"{path}/data")
    counters = {k: int(v) for o in (plan, out) for k, v in o.get.items()}
    save_settings(tokenized.sparkSession, path, {"stage": "fsl", "capacity": capacity, "pad_id": pad_id} | (settings or {}) | counters)
    return counters


def transform(df: DataFrame, instruction: str = "", form: str = "compact") -> DataFrame:
    """The training view of a stage's table; ValueError for a table of no stage."""
    stage = stage_of(df.schema)
    if stage == "binned":
        return bins.binned_samples(df, instruction)
    if stage == "event":
        payload = F.get_json_object(F.col("mcap_message").cast("string"), "$.payload")
        coded = encode_event(F.col("topic"), F.col("timestamp_ns"), payload, form)
        images = F.when(F.col("topic") == "screen", F.array(payload)).otherwise(F.array().cast("array<string>"))
        return df.select(coded.alias("encoded_event"), images.alias("images"))
    if stage in ("tokenized", "fsl"):
        return df
    raise ValueError(f"the table is of stage {stage!r}")
