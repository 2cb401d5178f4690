"""Document tables: types, responses, chunks."""

from __future__ import annotations

from pathlib import PurePosixPath

import pytest

from tallywright.operators import documents

NAMES = [
    "a.pdf",
    "b.TXT",
    "c.tar.DOCX",
    "d.doc",
    "e",
    ".hidden",
    "f.xlsx",
    "dir.v1/g",
    "dir.v1/h.Pdf",
]


def test_doc_type_follows_the_suffix(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "name string")
    rows = {r["name"]: r for r in documents.doc_type(df, "name").collect()}
    labels = {".pdf": "pdf", ".txt": "txt", ".docx": "docx", ".doc": "docx"}
    for name in NAMES:
        ending = PurePosixPath(name).suffix
        assert rows[name]["suffix"] == ending.lower()
        assert rows[name]["extractor"] == labels.get(ending.lower())
        assert rows[name]["file_type"] == (ending.upper().replace(".", "") or "Unknown")


def test_strict_doc_type_refuses_unknown(spark):
    good = spark.createDataFrame([("a.pdf",)], "name string")
    assert documents.doc_type(good, "name", strict=True).count() == 1
    bad = spark.createDataFrame([("a.xyz",)], "name string")
    with pytest.raises(Exception, match="Unsupported file type: .xyz"):
        documents.doc_type(bad, "name", strict=True).collect()


def test_attach_responses(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id bigint")
    answers = spark.createDataFrame([(1, "yes"), (3, None)], "doc_id bigint, response string")
    got = {r[0]: r[1] for r in documents.attach_responses(docs, answers).collect()}
    assert got == {1: "yes", 2: documents.NO_INSIGHTS, 3: documents.NO_INSIGHTS}


def test_chunk_numbers(spark):
    df = spark.createDataFrame([(1, "abcdef"), (2, "")], "doc_id int, text string")
    rows = documents.chunk_text(df, width=4, overlap=2).collect()
    assert [tuple(r) for r in rows] == [(1, 0, "abcd"), (1, 1, "cdef"), (1, 2, "ef")]


def test_metrics_keep_columns(spark):
    df = spark.createDataFrame([(1, "a b\n c")], "doc_id int, text string")
    row = documents.text_metrics(df).first()
    assert (row["word_count"], row["char_count"]) == (3, 6)
