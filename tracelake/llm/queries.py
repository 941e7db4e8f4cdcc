"""Queries of this subpackage: opN_<name> over the whole tables, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.byte_bpe import decode_frame, encode_frame
from tracelake.llm.common import new_path, table
from tracelake.llm.id_files import read_ids, write_ids
from tracelake.llm.kd_shards import kd_shards
from tracelake.llm.line_dedup import line_dedup
from tracelake.llm.log_bilinear import lm_scores
from tracelake.llm.near_dedup import near_groups
from tracelake.llm.quality_rules import quality_features
from tracelake.llm.source_mixing import mix_sources
from tracelake.llm.syncmers import fingerprints
from tracelake.llm.token_alignment import align_tokens
from tracelake.llm.unit_dedup import repeated_units
from tracelake.llm.url_rules import Rule, judge_urls
from tracelake.llm.whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")


def op2_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_features(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op5_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_units(table(spark, sf_dir, "documents"))
    return out.select(F.col("doc").alias("doc_id"), "start", "end", F.col("first_doc").alias("first_doc_id"), "first_start")


#: The fixed rules of op6, from its contract.
URL_RULES = [
    Rule("org", "", "allow"),
    Rule("example.org", "es/", "block"),
    Rule("example.org", "en/1", "block"),
    Rule("com", "fr/", "allow"),
    Rule("com", "de/", "block"),
]


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are those of the document that has the page's id: bad if toxic or of low quality."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    return judge_urls(table(spark, sf_dir, "pages"), labels, URL_RULES)


def op7_id_coder(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    files = new_path(spark, "ids")
    write_ids(table(spark, sf_dir, "documents"), path or public_tokenizers.path("word_bpe_49k.json"), files)
    return read_ids(spark, files).withColumnRenamed("doc", "doc_id")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(table(spark, sf_dir, "documents"), words=3, threshold=85)
    return out.select(F.col("doc").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True)).alias("kept"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    ids = encode_frame(table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text")
    out = decode_frame(ids, path)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op11_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = kd_shards(docs, ["source", "lang", F.log2(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)], shards=40)
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op13_token_alignment(spark: SparkSession, sf_dir: str, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    a_path, b_path = a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")
    return align_tokens(table(spark, sf_dir, "documents"), a_path, b_path).withColumnRenamed("doc", "doc_id")


QUERIES: dict[str, Query] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_syncmers": op2_syncmers,
    "op3_quality_rules": op3_quality_rules,
    "op4_log_bilinear": op4_log_bilinear,
    "op5_unit_dedup": op5_unit_dedup,
    "op6_url_rules": op6_url_rules,
    "op7_id_coder": op7_id_coder,
    "op8_line_dedup": op8_line_dedup,
    "op9_near_dedup": op9_near_dedup,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_kd_shards": op11_kd_shards,
    "op12_whitening": op12_whitening,
    "op13_token_alignment": op13_token_alignment,
}
