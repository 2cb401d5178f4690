"""Reports against texts written by hand and against pandas' table printing."""

from __future__ import annotations

from datetime import datetime

import pandas as pd
import pytest

from checks import queries
from tallywright.plans import reports

AT = datetime(2025, 3, 9, 8, 5, 7)
ROWS = [
    (i + 1, [1.5, None, -3.0, 10.25][i % 4], ["a", None, "long text", "b"][i % 4],
     datetime(2025, 1, 1 + i))
    for i in range(12)
]
FRAME = pd.DataFrame(ROWS, columns=["k", "x", "s", "t"])


@pytest.fixture(scope="module")
def frame(spark):
    schema = "k bigint, x double, s string, t timestamp_ntz"
    return spark.createDataFrame(ROWS, schema).repartition(3)


def content(df):
    [row] = df.collect()
    return row["content"]


def printed(n):
    return FRAME.head(n).to_string()


def test_executive(frame):
    got = content(
        reports.data_reports(frame, "executive", ["k"], AT, source="book.xlsx")
    )
    assert got == (
        "# 📊 Executive Summary Report\n\n"
        "**Generated:** March 09, 2025 at 08:05 AM  \n"
        "**Source File:** book.xlsx\n\n---\n\n"
        "## 🎯 Key Highlights\n\n"
        "Unable to generate AI insights: no response\n\n---\n\n"
        "## 📈 Data Overview\n\n"
        "| Metric | Value |\n|--------|-------|\n"
        "| Total Records | 12 |\n| Data Points | 4 |\n"
        "| Data Quality | 87.5% Complete |\n\n---\n\n"
        "## 🔍 Quick Statistics\n\n"
        "### Top Numeric Metrics\n\n"
        "**k:**\n- Average: 6.50\n- Range: 1.00 to 12.00\n\n"
        "**x:**\n- Average: 2.92\n- Range: -3.00 to 10.25\n\n"
        "\n---\n\n## 📋 Data Sample\n\n"
        f"{printed(5)}\n\n---\n\n*Report automatically generated*\n"
    )


def test_technical(frame):
    got = content(
        reports.data_reports(frame, "technical", ["k"], AT, source="book.xlsx")
    )
    assert "**Generated:** 2025-03-09 08:05:07  \n**Source:** book.xlsx  \n" in got
    assert (
        "## 📊 Dataset Specifications\n\n\n---\n\n## 🔍 AI-Powered Analysis\n\n"
    ) in got
    std = FRAME.x.std()
    assert (
        "### Numeric Columns (2)\n\n"
        "| Column | Mean | Median | Std Dev | Min | Max |\n"
        "|--------|------|--------|---------|-----|-----|\n"
        "| k | 6.50 | 6.50 | 3.61 | 1.00 | 12.00 |\n"
        f"| x | 2.92 | 1.50 | {std:.2f} | -3.00 | 10.25 |\n"
        "\n\n### Categorical Columns (1)\ns\n\n---\n\n"
        "## 🧹 Data Quality Assessment\n\n"
        "### Missing Values Detected\n\n"
        "- **x:** 3 (25.0%)\n- **s:** 3 (25.0%)\n\n\n---\n\n"
        f"## 📋 Data Preview\n\n{printed(10)}\n\n---\n\n"
    ) in got


def test_business_is_also_the_layout_of_unknown_types(frame):
    business = content(
        reports.data_reports(frame, "business", ["k"], AT, source="book.xlsx")
    )
    assert (
        "This report analyzes **12 records** across **4 key metrics** to provide "
        "actionable business insights."
    ) in business
    assert (
        "| Data Completeness | 87.5% |\n| Numeric Indicators | 2 |\n\n---\n\n"
        "## 📈 Performance Metrics\n\n### Key Performance Indicators\n\n"
        "**k:**\n- Avg Performance: 6.50\n- Best: 12.00 | Worst: 1.00\n"
        "- Variability: 3.61\n\n"
    ) in business
    assert f"\n---\n\n## 🔍 Data Snapshot\n\n{printed(5)}\n\n---\n\n## 📌" in business
    [other] = reports.data_reports(frame, "weekly", ["k"], AT, source="book.xlsx").collect()
    assert other["content"] == business
    assert other["report_name"] == "weekly_report_book.xlsx.md"


def test_empty_table(spark):
    empty = spark.createDataFrame([], "k int, s string")
    got = content(reports.data_reports(empty, "technical", ["k"], AT, source="e"))
    assert "| k | 0.00 | 0.00 | 0.00 | 0.00 | 0.00 |\n" in got
    assert "✅ No missing values detected\n" in got
    assert "Empty DataFrame\nColumns: [k, s]\nIndex: []" in got
    executive = content(reports.data_reports(empty, "executive", ["k"], AT, source="e"))
    assert "| Data Quality | 100.0% Complete |" in executive


def test_table_without_numbers(spark):
    df = spark.createDataFrame([("a",)], "s string")
    got = content(reports.data_reports(df, "executive", ["s"], AT, source="e"))
    assert "## 🔍 Quick Statistics\n\n\n---\n" in got


def test_single_row_prints_nan(spark):
    df = spark.createDataFrame([(2.0,)], "x double")
    got = content(reports.data_reports(df, "technical", ["x"], AT, source="e"))
    assert "| x | 2.00 | 2.00 | nan | 2.00 | 2.00 |" in got


def test_only_the_first_five_numeric_columns_are_shown(spark):
    df = spark.createDataFrame([tuple(range(7))], ", ".join(f"c{i} int" for i in range(7)))
    executive = content(reports.data_reports(df, "executive", ["c0"], AT, source="e"))
    assert "**c4:**" in executive and "**c5:**" not in executive
    technical = content(reports.data_reports(df, "technical", ["c0"], AT, source="e"))
    assert "| c6 |" in technical


def test_reports_by_group_with_insights(spark, frame):
    insights = spark.createDataFrame([("a", "rising")], "report_key string, response string")
    rows = {
        r["report_key"]: r["content"]
        for r in reports.data_reports(
            frame, "executive", ["k"], AT, by="s", insights=insights
        ).collect()
    }
    assert sorted(rows) == ["(missing)", "a", "b", "long text"]
    assert "## 🎯 Key Highlights\n\nrising\n" in rows["a"]
    assert reports.NO_DATA_INSIGHTS in rows["b"]
    group = FRAME[FRAME.s == "a"].reset_index(drop=True)
    assert group.to_string() in rows["a"]
    assert "| Total Records | 3 |" in rows["(missing)"]


def test_source_or_by(frame):
    with pytest.raises(ValueError):
        reports.data_reports(frame, "executive", ["k"], AT)
    with pytest.raises(ValueError):
        reports.data_reports(frame, "executive", ["k"], AT, source="a", by="s")


def test_document_report(spark):
    docs = spark.createDataFrame(
        [(1, "brd.pdf", "The summary."), (2, "x.docx", "Other")],
        "doc_id int, file_name string, summary string",
    )
    rows = {
        r["report_key"]: r for r in reports.document_reports(docs, "executive", AT).collect()
    }
    assert rows["1"]["report_name"] == "doc_executive_report_1.md"
    got = rows["1"]["content"]
    assert got.startswith(
        "# 📄 Document Analysis Report - Executive\n\n"
        "**Generated:** March 09, 2025 at 08:05 AM  \n"
        "**Document:** brd.pdf  \n"
        "**Report Type:** EXECUTIVE\n\n---\n\n"
        "## 📋 Document Summary\n\nThe summary.\n\n---\n\n"
        "## 💡 Key Insights & Analysis\n\n"
        "Unable to generate insights: no response\n\n---\n\n"
        "## 🎯 Analysis Methodology\n\n"
    )
    headings = [line for line in got.split("\n") if line.startswith("#")]
    assert headings[-1] == "## 📌 Key Takeaways"
    assert "tailored to executive perspective\n" in got
    assert got.endswith("*Report generated on March 09, 2025 at 08:05 AM*\n")


def test_html(spark):
    df = spark.createDataFrame([("a < b & c",)], "content string")
    [row] = reports.report_html(df).collect()
    assert "<pre>a &lt; b &amp; c</pre>" in row["html"]
    assert row["html"].startswith("<html>")


def test_missing_group_is_not_the_group_of_that_name(spark):
    rows = [(1, None, 1.0), (2, "(missing)", 2.0), (3, "(missing)", 4.0), (4, "(missing) (missing)", 8.0)]
    df = spark.createDataFrame(rows, "k int, s string, x double")
    got = {r["report_key"]: r["content"] for r in reports.data_reports(df, "executive", ["k"], AT, by="s").collect()}
    counts = {"(missing)": 1, "(missing) (missing)": 2, "(missing) (missing) (missing)": 1}
    assert set(got) == set(counts)
    assert all(f"| Total Records | {n} |" in got[k] for k, n in counts.items())


def test_caps_can_be_lifted(spark):
    wide = spark.range(12).selectExpr("id", *[f"id + {i} AS n{i}" for i in range(8)], *[f"'t' AS c{i}" for i in range(12)])
    cut, whole = (
        reports.data_reports(wide, kind, ["id"], AT, source="t", **more).first()["content"]
        for kind, more in (("business", {}), ("business", {"key_columns": None, "sample_rows": 12}))
    )
    assert "n7" not in cut.split("id  ")[0] and whole.count("n7") > cut.count("n7")
    assert whole.count("\n11") == 1 and cut.count("\n11") == 0
    few, all_ = (
        reports.data_reports(wide, "technical", ["id"], AT, source="t", listed_categories=n).first()["content"]
        for n in (10, None)
    )
    assert "c9, c10, c11" in all_ and "c9, c10, c11" not in few


@pytest.mark.parametrize("name", ["write_summaries", "write_reports", "report_document"])
def test_whole_texts_and_leading_words(spark, tmp_path, name):
    long = " ".join(f"word{i}" for i in range(2500))
    rows = [(1, long, "en"), (2, "a  b", "de"), (3, None, "fr")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    found = {int(r[0]): r for r in getattr(queries, name)(spark, str(tmp_path)).collect()}
    assert {k: r["lead"] for k, r in found.items()} == {1: " ".join(long.split()[:500]), 2: "a b", 3: None}
    assert long in (found[1]["summary"] if name == "write_summaries" else found[1]["content"])
