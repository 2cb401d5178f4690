"""Text columns against Python's own string methods."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallywright.functions import text

SAMPLES = [
    "",
    " ",
    "one",
    "  two words \n",
    "tab\tand\x0bfeed\x0cand\x1cunit\x1fend",
    " no break　wide line ",
    "zero​width is no space",
    "emoji 😀 and é́ \x85 next",
    "\n\n a \r\n b \r c",
]


def values(spark, samples, column):
    rows = spark.createDataFrame(list(enumerate(samples)), "i int, text string")
    return [r[0] for r in rows.orderBy("i").select(column).collect()]


def test_white_space_is_pythons():
    spaces = {chr(i) for i in range(0x110000) if chr(i).isspace()}
    assert set(text.WHITE_SPACE) == spaces


def test_strip(spark):
    assert values(spark, SAMPLES, text.strip("text")) == [s.strip() for s in SAMPLES]


def test_blank(spark):
    assert values(spark, SAMPLES, text.is_blank("text")) == [
        not s.strip() for s in SAMPLES
    ]


def test_word_and_char_counts(spark):
    assert values(spark, SAMPLES, text.word_count("text")) == [
        len(s.split()) for s in SAMPLES
    ]
    assert values(spark, SAMPLES, text.char_count("text")) == [len(s) for s in SAMPLES]


@pytest.mark.parametrize("count", [1, 2, 3, 100])
def test_lead_words(spark, count):
    assert values(spark, SAMPLES, text.lead_words("text", count)) == [
        " ".join(s.split()[:count]) for s in SAMPLES
    ]


def test_lead_words_of_a_long_text(spark):
    words = [f"w{i}" for i in range(5000)]
    [lead] = values(spark, ["  " + "  \n".join(words)], text.lead_words("text", 2000))
    assert lead == " ".join(words[:2000])


@pytest.mark.parametrize(
    ("length", "expected"),
    [
        (0, []),
        (1, [1]),
        (250, [250]),
        (251, [251, 1]),
        (300, [300, 50]),
        (301, [300, 51]),
        (550, [300, 300, 50]),
        (551, [300, 300, 51]),
    ],
)
def test_chunk_lengths(spark, length, expected):
    content = "".join(chr(97 + i % 26) for i in range(length))
    [chunks] = values(spark, [content], text.chunks("text"))
    assert [len(c) for c in chunks] == expected
    assert chunks == [content[i : i + 300] for i in range(0, length, 250)]


def test_chunks_count_code_points_and_keep_line_breaks(spark):
    content = "😀\n\r é" * 100
    [chunks] = values(spark, [content], text.chunks("text", 7, 5))
    assert chunks == [content[i : i + 7] for i in range(0, len(content), 2)]


def test_chunks_refuse_endless_overlap():
    with pytest.raises(ValueError):
        text.chunks("text", 10, 10)


def test_preview_and_truncate(spark):
    samples = ["x" * 999, "x" * 1000, "é" * 1001, "y" * 5000]
    assert values(spark, samples, text.preview("text")) == [
        s[:1000] + "..." if len(s) > 1000 else s for s in samples
    ]
    assert values(spark, samples, text.truncate("text")) == [s[:4000] for s in samples]


def test_budget(spark):
    labels = [*text.SUMMARY_WORDS, "anything else"]
    assert values(spark, labels, text.summary_budget("text")) == [500, 800, 2000, 2000]


def test_prompts(spark):
    [summary] = values(spark, ["z" * 4001], text.summary_prompt("text"))
    assert "in approximately 150 words." in summary
    assert summary.endswith("TEXT TO SUMMARIZE:\n" + "z" * 4000 + "\n\nSUMMARY:")
    [insight] = values(spark, ["z" * 1001], text.insight_prompt("text", "technical"))
    assert insight == (
        "\nBased on this document summary, provide technical analysis with key "
        "takeaways:\n\nSummary:\n" + "z" * 1000 + "\n\nProvide 3-5 key points in "
        "technical format.\n"
    )


@pytest.mark.parametrize(
    ("response", "expected"),
    [
        ("  plain text \n", "plain text"),
        ("```python\ndf.head(10)\n```", "df.head(10)"),
        ("```\ndf.head()\n```", "df.head()"),
        ("```sql\nselect 1\n```", "sql\nselect 1"),
        ("Sure:\n```python\na\n```\nand ```b```", "a"),
        ("``` python df```", "df"),
        ("```unclosed", "unclosed"),
        ("``````", ""),
        ("```pythonic```", "ic"),
        ("python df", "python df"),
    ],
)
def test_clean_response(spark, response, expected):
    assert values(spark, [response], text.clean_response("text")) == [expected]


def test_fixed_rounds_like_python(spark):
    numbers = [0.125, 2.675, -0.005, 1234567.891, 0.0, 1e15, 99.995, -1.5, 0.375]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double")
    shown = rows.orderBy("i").select(text.fixed("x", 2), text.thousands("x")).collect()
    assert [r[0] for r in shown] == [f"{x:.2f}" for x in numbers]
    assert shown[3][1] == "1,234,568"


def test_fixed_shows_missing_as_nan(spark):
    [row] = spark.range(1).select(text.fixed(F.lit(None).cast("double"), 2)).collect()
    assert row[0] == "nan"


def test_escape_html(spark):
    assert values(spark, ["a<b>&amp;"], text.escape_html("text")) == [
        "a&lt;b&gt;&amp;amp;"
    ]
