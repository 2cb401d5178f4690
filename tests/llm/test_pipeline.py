"""The pipeline's stages on small tables."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from tallywright.llm import mixing, tables


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    whole = docs.count()
    languages = corpus_pipeline.identify_language(spark, docs, sf_dir)
    kept = corpus_pipeline.drop_near_copies(spark, languages, sf_dir)
    assert kept.count() <= docs.select("text").distinct().count() <= whole
    clean = corpus_pipeline.remove_secrets(spark, kept, sf_dir)
    mixed = corpus_pipeline.mix_sources(spark, clean, sf_dir)
    assert docs.columns == kept.columns == clean.columns == mixed.columns
    assert mixed.count() == kept.count()
    assert corpus_pipeline.pack_sequences(spark, mixed, sf_dir).select("doc_id").distinct().count() == kept.count()


def test_sequences_follow_the_mixture(spark, sf_dir):
    """Also over several files of unequal size, the last ones largest."""
    rows = [(i, f"word{i} " * (5 if i % 3 else 40), "hot" if i % 10 else "rare", "en", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, n_chars bigint")
    place = {r["doc_id"]: r["mix_position"] for r in mixing.mix(docs).collect()}
    files = tables.settled(
        corpus_pipeline.mix_sources(spark, docs, sf_dir).selectExpr(
            "doc_id", "IF(spark_partition_id() > 1, repeat(text, 20), text) AS text", "source", "lang", "n_chars"
        ),
        "mixed",
    )
    assert len(files.inputFiles()) > 2
    pieces = corpus_pipeline.pack_sequences(spark, files, sf_dir).orderBy("sequence_id", "offset").collect()
    order = list(dict.fromkeys(r["doc_id"] for r in pieces))
    assert order == sorted(place, key=place.get)


def test_own_columns_pass_and_repeated_rows_go(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    names = ["score", "Rejected", "lang_pred", "spans", "block", "block_slot", "mix_position", "turn", "slot", "count"]
    own = docs.selectExpr("*", *[f"concat('{n}', doc_id) AS {n}" for n in names])
    nameless = own.limit(3).withColumn("doc_id", F.lit(None).cast("bigint"))
    table = tables.settled(own.unionByName(own).unionByName(nameless), "own")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = tables.settled(stage(spark, table, sf_dir), name)
        assert table.columns == own.columns
    got = table.where("doc_id IS NOT NULL").collect()
    assert got and len({r["doc_id"] for r in got}) == len(got)
    assert all(r[n] == f"{n}{r['doc_id']}" for r in got for n in names)
    assert table.where("doc_id IS NULL").count() == 3


def test_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
