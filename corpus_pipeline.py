"""A training corpus from raw documents: five stages, each a table.

Language identification, near-duplicate removal, removal of secrets, mixing of the
sources, packing. Every stage takes (spark, docs, sf_dir) and its result is written as
Parquet and read again as the next one's docs. Missing texts are dropped by the first
stage, since no language can be told; empty tables give empty tables; further columns
are passed on up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm import language_id, mixing, ngram_join, packing, secret_scan, tables

TOKENIZER = "word_bpe_49k.json"


def _aside(docs: DataFrame, added: set[str]) -> tuple[DataFrame, list]:
    """Own columns that a stage's columns would replace, out of the way, and the way back."""
    clashing = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c.lower() in added}
    back = [F.col(clashing.get(c, c)).alias(c) for c in docs.columns]
    return docs.withColumnsRenamed(clashing), back


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents too far from every known language go; a missing lang is filled in."""
    model = language_id.fit(docs.where(~language_id.held_out()))
    hidden, back = _aside(docs, {"lang_pred", "score", "rejected"})
    found = language_id.predict(hidden, model).where("NOT rejected")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(back)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id stays.

    Of rows that repeat a document's id and text one stays.
    """
    links = ngram_join.link(docs)
    gone = links.where("NOT doc_id <=> component_id").select("doc_id")
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, "doc_id", "left_anti").unionByName(once).select(docs.columns)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    hidden, back = _aside(docs, {"spans"})
    found = secret_scan.spans(hidden)
    text = secret_scan.redacted(F.col("text"), F.col("spans"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("bigint")).select(back)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mixture."""
    hidden, back = _aside(docs, {"block", "block_slot", "mix_position"})
    mixed = mixing.mix(hidden)
    count = tables.parallelism(docs)
    return mixed.repartitionByRange(count, "mix_position").sortWithinPartitions("mix_position").select(back)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences, with their token ids.

    sequence_id follows the mixture. Files read again come in the order of their sizes,
    so the places in the mixture are computed anew: they depend on the rows only.
    """
    mixed = mix_sources(spark, docs.select("doc_id", "source", "text"), sf_dir)
    return packing.pack(mixed, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", drop_near_copies),
    ("secret_scan", remove_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# the stages learn a classifier, test randomness and call a tokenizer
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, on the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = tables.settled(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
