"""Documents out of pages and blocks."""

from __future__ import annotations

import pytest

from tallywright.operators import assemble


def texts(df):
    return {r[0]: r["text"] for r in df.collect()}


@pytest.mark.parametrize("segment", [None, 1, 2, 1000])
def test_pages_in_order(spark, segment):
    rows = [("d", 11, "k"), ("d", 2, "b"), ("d", 1, "a"), ("e", 1, None), ("d", 3, "")]
    df = spark.createDataFrame(rows, "doc string, page bigint, body string")
    got = texts(assemble.page_concat(df.repartition(3), "doc", "page", "body", segment))
    assert got == {
        "d": "\n--- Page 1 ---\na\n--- Page 2 ---\nb\n--- Page 3 ---\n"
        "\n--- Page 11 ---\nk",
        "e": "\n--- Page 1 ---\n",
    }


def test_one_document_with_most_pages(spark):
    pages = spark.range(1, 5001).selectExpr("'hot' AS doc", "id AS page", "'p' AS body")
    got = texts(assemble.page_concat(pages, "doc", "page", "body"))
    assert got["hot"] == "".join(f"\n--- Page {i} ---\np" for i in range(1, 5001))
    parts = assemble.page_parts(pages, "doc", "page", "body", 1000).collect()
    assert sorted(r["part"] for r in parts) == [0, 1, 2, 3, 4, 5]


BLOCKS = "doc_id string, kind string, block bigint, row bigint, cell bigint, text string"


@pytest.mark.parametrize("segment", [None, 1, 1000])
@pytest.mark.parametrize(
    ("blocks", "expected"),
    [
        # paragraphs first, untrimmed inside, then the rows of each table
        (
            [
                ("cell", 1, 0, 0, "second"),
                ("cell", 0, 1, 0, " r2 "),
                ("cell", 0, 0, 1, "b"),
                ("cell", 0, 0, 0, " a\n"),
                ("para", 1, None, None, "  two  "),
                ("para", 0, None, None, " one"),
                ("para", 2, None, None, " three"),
            ],
            "one\n  two  \n three\na | b\nr2\nsecond",
        ),
        # blank cells vanish, and rows without any cell
        (
            [
                ("cell", 0, 0, 0, "a"),
                ("cell", 0, 0, 1, "  "),
                ("cell", 0, 0, 2, "c"),
                ("cell", 0, 1, 0, ""),
                ("cell", 0, 1, 1, None),
                ("cell", 0, 2, 0, "d"),
            ],
            "a | c\nd",
        ),
        # nothing but white space: the raw paragraphs
        ([("para", 0, None, None, " "), ("para", 1, None, None, "\t")], "  \t"),
        # nothing at all: the fixed sentence
        ([("para", 0, None, None, "")], assemble.NO_TEXT),
        ([("cell", 0, 0, 0, " ")], assemble.NO_TEXT),
        # lines of ten and more keep their order
        (
            [("para", i, None, None, f"p{i}") for i in range(25)],
            "\n".join(f"p{i}" for i in range(25)),
        ),
    ],
)
def test_blocks(spark, segment, blocks, expected):
    df = spark.createDataFrame([("d", *b) for b in blocks], BLOCKS).repartition(3)
    assert texts(assemble.block_concat(df, segment=segment)) == {"d": expected}
