"""One query per operator, on the whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tallywright.llm import (
    chunk_dedup,
    conversations,
    fingerprints,
    language_id,
    line_quality,
    lm_scoring,
    mixing,
    nearest,
    ngram_join,
    oracles,
    packing,
    phrases,
    secret_scan,
    suffix_dedup,
)

PACKING_TOKENIZER = "word_bpe_49k.json"
LM_VOCABULARY = "piece_bpe_32k.model"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path(PACKING_TOKENIZER))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.spans(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda x: x["kind"] != "random")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(secret_scan.listed(base), 256).alias("base_sha256"),
        secret_scan.listed(F.col("spans")).alias("spans"),
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents").select("doc_id", "source"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", language_id.held_out("doc_id", 7).alias("held_out"))
    return lm_scoring.score(docs, public_tokenizers.path(LM_VOCABULARY))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(_read(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    rank = fingerprints.rarity(docs)
    both = fingerprints.with_next(fingerprints.fingerprint(docs, rank), ["text", "fingerprint"], docs)
    both = both.select("doc_id", "text", "fingerprint", "next_fingerprint", fingerprints.edited().alias("edited"))
    both = both.select(
        "doc_id",
        F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "edited",
        "fingerprint",
        "next_fingerprint",
    )
    both = fingerprints.fingerprint(both, rank, "edited", "edited_fingerprint")
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        fingerprints.likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        fingerprints.likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(_read(spark, sf_dir, "documents"), width=3, percent=90).select(
        "doc_id", "n_shingles", "component_id"
    )


def op9_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.repeats(_read(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang", language_id.held_out().alias("held_out"))
    model = language_id.fit(docs.where("NOT held_out"))
    return language_id.predict(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversations.damaged(_read(spark, sf_dir, "conversations"))
    return conversations.summary(conversations.repair(damaged))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(_read(spark, sf_dir, "documents"))


def op13_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", language_id.held_out().alias("held_out"))
    labels = _read(spark, sf_dir, "labels").select("doc_id", "quality")
    model = line_quality.fit(docs.where("NOT held_out"), labels)
    return line_quality.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


ALL = {
    f.__name__: f
    for f in (
        op1_packing,
        op2_secret_scan,
        op3_mixing,
        op4_lm_scoring,
        op5_nearest,
        op6_suffix_dedup,
        op7_fingerprints,
        op8_ngram_join,
        op9_chunk_dedup,
        op10_language_id,
        op11_conversation_repair,
        op12_phrase_mining,
        op13_line_quality,
        pipeline,
    )
}
ORACLES: dict[str, str] = {
    "op11_conversation_repair": oracles.CONVERSATIONS,
    "op12_phrase_mining": oracles.PHRASES,
}
