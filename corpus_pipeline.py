"""Corpus pipeline over ``documents``: quality rules, line dedup, near-dedup, source mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. A caller writes a stage's result as Parquet and reads it again as the next
one's docs; ``run`` does so too. All stages but the last return the columns of
``documents``; where a stage changes texts, ``n_chars`` follows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.byte_bpe import decode_frame, encode_frame
from tracelake.llm.common import stored, table
from tracelake.llm.line_dedup import line_dedup
from tracelake.llm.near_dedup import near_dedup
from tracelake.llm.quality_rules import quality_rules
from tracelake.llm.source_mixing import mix_sources

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or their source's fences go."""
    return quality_rules(docs.select(*COLUMNS))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them."""
    out = line_dedup(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five words, similarity 0.8)."""
    return near_dedup(docs.select(*COLUMNS), words=5, threshold=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their target weights; a document of a repeated source has a row for each epoch."""
    return mix_sources(docs.select(*COLUMNS)).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to it."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("original"))
    ids = encode_frame(rows.withColumnRenamed("original", "text"), path)
    out = decode_frame(ids.withColumnRenamed("text", "original"), path)
    return out.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), (F.col("text") == F.col("original")).alias("round_trip"), "ids")


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near), ("source_mixing", mixing), ("byte_bpe", tokens)]

#: SQL can't express the near-duplicate stage's and the tokenizer's work; both are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
