"""Reports: profiles and summaries rendered as Markdown, many in one job.

A data report covers a whole table, or one report is made per value of a
column. Either way the statistics come from the profile operators; rendering
only turns their small results (a few rows per report) into text.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions import cells, text
from tallywright.operators import profile
from tallywright.operators.documents import NO_INSIGHTS
from tallywright.session import ship, written_once

ship(__name__)

# --- fixed values -----------------------------------------------------------
REPORT_TYPES = ("executive", "technical", "business")
KEY_COLUMNS = 5
LISTED_CATEGORIES = 10
SAMPLE_ROWS = {"executive": 5, "technical": 10, "business": 5}
DATE_FORMATS = {
    "executive": "%B %d, %Y at %I:%M %p",
    "technical": "%Y-%m-%d %H:%M:%S",
    "business": "%B %d, %Y",
    "document": "%B %d, %Y at %I:%M %p",
}
NO_DATA_INSIGHTS = "Unable to generate AI insights: no response"
NONE_MISSING = "✅ No missing values detected\n"
SOME_MISSING = "### Missing Values Detected\n\n"
MISSING_LINE = "- **{column}:** {missing} ({percent}%)\n"

EXECUTIVE = """# 📊 Executive Summary Report

**Generated:** {date}  
**Source File:** {source}

---

## 🎯 Key Highlights

{insights}

---

## 📈 Data Overview

| Metric | Value |
|--------|-------|
| Total Records | {rows} |
| Data Points | {columns} |
| Data Quality | {complete}% Complete |

---

## 🔍 Quick Statistics

{numbers}
---

## 📋 Data Sample

{sample}

---

*Report automatically generated*
"""
EXECUTIVE_HEAD = "### Top Numeric Metrics\n\n"
EXECUTIVE_LINE = "**{column}:**\n- Average: {mean}\n- Range: {min} to {max}\n\n"

TECHNICAL = """# 🔬 Technical Analysis Report

**Generated:** {date}  
**Source:** {source}  
**Framework:** PySpark

---

## 📊 Dataset Specifications


---

## 🔍 AI-Powered Analysis

{insights}

---

## 📈 Column Analysis

### Numeric Columns ({numeric})
{numbers}

### Categorical Columns ({categorical})
{categories}

---

## 🧹 Data Quality Assessment

{missing}

---

## 📋 Data Preview

{sample}

---

*Technical report automatically generated*
"""
TECHNICAL_HEAD = (
    "\n| Column | Mean | Median | Std Dev | Min | Max |\n"
    "|--------|------|--------|---------|-----|-----|\n"
)
TECHNICAL_LINE = "| {column} | {mean} | {median} | {std} | {min} | {max} |\n"

BUSINESS = """# 💼 Business Intelligence Report

**Report Date:** {date}  
**Data Source:** {source}  
**Prepared By:** Automated reporting

---

## 🎯 Executive Summary

This report analyzes **{rows} records** across **{columns} key metrics** to provide actionable business insights.

---

## 💡 Key Business Insights

{insights}

---

## 📊 Business Metrics Dashboard

| KPI | Value |
|-----|-------|
| Total Data Records | {rows} |
| Metrics Tracked | {columns} |
| Data Completeness | {complete}% |
| Numeric Indicators | {numeric} |

---

## 📈 Performance Metrics

{numbers}
---

## 🔍 Data Snapshot

{sample}

---

## 📌 Recommendations

Based on the analysis:
1. Monitor key metrics with high variability
2. Investigate any data quality issues identified
3. Focus on columns showing significant trends
4. Consider deeper analysis on outlier values

---

*Business report automatically generated*
"""
BUSINESS_HEAD = "### Key Performance Indicators\n\n"
BUSINESS_LINE = (
    "**{column}:**\n- Avg Performance: {mean}\n- Best: {max} | Worst: {min}\n"
    "- Variability: {std}\n\n"
)

DOCUMENT = """# 📄 Document Analysis Report - {title}

**Generated:** {date}  
**Document:** {source}  
**Report Type:** {upper}

---

## 📋 Document Summary

{summary}

---

## 💡 Key Insights & Analysis

{insights}

---

## 🎯 Analysis Methodology

This report was generated using:
- **AI Model:** external language model
- **Technique:** summary of the document's leading text
- **Processing:** batch job
- **Report Format:** {title}

---

## 📌 Key Takeaways

Based on the document analysis, this report provides:
- Comprehensive summary of document content
- AI-powered insights and interpretations
- Actionable recommendations where applicable
- Context-aware analysis tailored to {type} perspective

---

*Document analysis automatically generated*  
*Report generated on {date}*
"""

HTML_PAGE = """<html>
<head>
<style>
body { font-family: Arial, sans-serif; padding: 20px; }
table { border-collapse: collapse; width: 100%; }
th, td { border: 1px solid #ddd; padding: 8px; text-align: left; }
th { background-color: #4CAF50; color: white; }
</style>
</head>
<body>
<pre>REPORT</pre>
</body>
</html>
"""
# --- end of fixed values ----------------------------------------------------

_LAYOUTS = {
    "executive": (EXECUTIVE, EXECUTIVE_HEAD, EXECUTIVE_LINE, KEY_COLUMNS),
    "technical": (TECHNICAL, TECHNICAL_HEAD, TECHNICAL_LINE, None),
    "business": (BUSINESS, BUSINESS_HEAD, BUSINESS_LINE, KEY_COLUMNS),
}
_KEY = "report_key"
_NO_GROUP = "(missing)"


def _numbers(stats: DataFrame, line: str) -> DataFrame:
    """(report_key, numbers): one line per column, in the table's order."""
    figures = {
        m: text.fixed(F.col(m), 2) for m in ("mean", "median", "min", "max", "std")
    }
    rendered = text.fill(line, column=F.col("column_name"), **figures)
    # as many lines per report as the table has numeric columns
    lines = F.array_sort(F.collect_list(F.struct("position", rendered.alias("line"))))
    return stats.groupBy(_KEY).agg(
        F.array_join(lines.getField("line"), "").alias("numbers")
    )


def _show(rows: pd.DataFrame) -> pd.DataFrame:
    """Print one report's sample rows as an aligned text table."""
    ordered = rows.sort_values("_place")
    table = ordered.drop(columns=[_KEY, "_place"]).reset_index(drop=True)
    return pd.DataFrame({_KEY: ordered[_KEY].iloc[:1], "sample": [table.to_string()]})


def _samples(df: DataFrame, by: str | None, order_by: Sequence[str], n: int):
    """(report_key, sample): each report's first rows by a unique order."""
    order = [cells.name(c) for c in order_by]
    if by is None:
        first = df.orderBy(*order).limit(n)
        place = F.row_number().over(Window.partitionBy(_KEY).orderBy(*order))
        placed = first.withColumn("_place", place)
    else:
        # the row_number limit also applies before the shuffle
        place = F.row_number().over(Window.partitionBy(_KEY).orderBy(*order))
        placed = df.withColumn("_place", place).filter(F.col("_place") <= n)
    return placed.groupBy(_KEY).applyInPandas(_show, f"{_KEY} string, sample string")


def _missing_section(columns: Sequence[str]) -> Column:
    lines = []
    for i, column in enumerate(columns):
        count = F.col(f"missing{i}")
        percent = text.fixed(count / F.nullif("total_rows", F.lit(0)) * 100.0, 1)
        line = text.fill(
            MISSING_LINE, column=F.lit(column), missing=count, percent=percent
        )
        lines.append(F.when(count > 0, line))
    listed = F.concat(F.lit(SOME_MISSING), F.array_join(F.array(*lines), ""))
    return F.when(F.col("missing_values") > 0, listed).otherwise(F.lit(NONE_MISSING))


def data_reports(
    df: DataFrame,
    report_type: str,
    order_by: Sequence[str],
    generated: datetime,
    source: str | None = None,
    by: str | None = None,
    insights: DataFrame | None = None,
    key_columns: int | None = KEY_COLUMNS,
    listed_categories: int | None = LISTED_CATEGORIES,
    sample_rows: int | None = None,
) -> DataFrame:
    """(report_key, report_type, report_name, content): reports on a table.

    Give ``source``, the table's name, for one report on the whole of it, or
    ``by``, a column, for one per value. ``insights`` (report_key, response)
    adds model output; where it has none a fixed sentence stands. A type other
    than executive or technical gets the business layout. The business layout shows
    the first ``key_columns`` numeric columns and lists the first
    ``listed_categories`` others (None for all); ``sample_rows`` replaces the
    layout's number of first rows. Rows without a value of ``by`` have a report of
    their own, whose key is ``(missing)``, or ``(missing) (missing)`` and so on
    where the column has such a value itself.
    """
    if (source is None) == (by is None):
        raise ValueError("give either source or by")
    layout = report_type if report_type in _LAYOUTS else "business"
    template, head, line, limited = _LAYOUTS[layout]
    limit = key_columns if limited else None
    columns = df.columns
    numeric, categorical = cells.numeric_columns(df), cells.categorical_columns(df)
    shown = numeric[:limit]

    if by is None:
        key = F.lit(source)
        # one row each; read back, their key is a column to join on, not a constant
        totals = written_once(profile.table_totals(df).withColumn(_KEY, key), "report-totals")
        stats = written_once(profile.numeric_stats(df, shown).withColumn(_KEY, key), "report-numbers")
        keyed = df.withColumn(_KEY, key)
    else:
        # no value of the column reads like the key of the missing ones
        own = cells.name(by).cast("string")
        taken = F.regexp_like(own, F.lit(rf"^\(missing\)( \(missing\))*$"))
        key = F.when(own.isNull(), F.lit(_NO_GROUP)).when(taken, F.concat(own, F.lit(f" {_NO_GROUP}"))).otherwise(own)
        keyed = df.withColumn(_KEY, key)
        totals, stats = profile.group_profile(keyed, _KEY, columns, shown)
    report = totals.join(
        _samples(keyed, by, order_by, sample_rows or SAMPLE_ROWS[layout]), _KEY, "left"
    )
    if shown:
        report = report.join(_numbers(stats, line), _KEY, "left")
        numbers = F.concat(F.lit(head), F.coalesce("numbers", F.lit("")))
    else:
        numbers = F.lit("")
    if insights is not None:
        report = report.join(
            insights.select(_KEY, F.col("response").cast("string")), _KEY, "left"
        )
        response = F.coalesce("response", F.lit(NO_DATA_INSIGHTS))
    else:
        response = F.lit(NO_DATA_INSIGHTS)
    empty = f"Empty DataFrame\nColumns: [{', '.join(columns)}]\nIndex: []"
    share = profile.completeness_of(
        F.col("missing_values"), F.col("total_rows") * F.col("total_columns")
    )
    content = text.fill(
        template,
        date=F.lit(generated.strftime(DATE_FORMATS[layout])),
        source=F.col(_KEY),
        insights=response,
        rows=text.thousands("total_rows"),
        columns=F.col("total_columns"),
        complete=text.fixed(share, 1),
        numeric=F.lit(len(numeric)),
        categorical=F.lit(len(categorical)),
        categories=F.lit(", ".join(categorical[:listed_categories])),
        numbers=numbers,
        missing=_missing_section(columns),
        sample=F.coalesce("sample", F.lit(empty)),
    )
    return report.select(
        _KEY,
        F.lit(report_type).alias("report_type"),
        F.concat(F.lit(f"{report_type}_report_"), _KEY, F.lit(".md")).alias(
            "report_name"
        ),
        content.alias("content"),
    )


def document_reports(
    docs: DataFrame,
    report_type: str,
    generated: datetime,
    doc: str = "doc_id",
    source: str = "file_name",
    summary: str = "summary",
    insights: str | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One report per document: its summary, insights and fixed notes.

    The columns of ``keep`` are passed on beside it.
    """
    response = (
        F.coalesce(cells.name(insights).cast("string"), F.lit(NO_INSIGHTS))
        if insights
        else F.lit(NO_INSIGHTS)
    )
    content = text.fill(
        DOCUMENT,
        title=F.lit(report_type.title()),
        upper=F.lit(report_type.upper()),
        type=F.lit(report_type),
        date=F.lit(generated.strftime(DATE_FORMATS["document"])),
        source=cells.name(source),
        summary=cells.name(summary),
        insights=response,
    )
    key = cells.name(doc).cast("string")
    return docs.select(
        key.alias(_KEY),
        F.lit(report_type).alias("report_type"),
        F.concat(F.lit(f"doc_{report_type}_report_"), key, F.lit(".md")).alias(
            "report_name"
        ),
        content.alias("content"),
        *[cells.name(c).alias(c) for c in keep],
    )


def report_html(reports: DataFrame, content: str = "content") -> DataFrame:
    """Add ``html``: the report's text, escaped, in a fixed page."""
    before, after = HTML_PAGE.split("REPORT")
    page = F.concat(
        F.lit(before), text.escape_html(cells.name(content)), F.lit(after)
    )
    return reports.select("*", page.alias("html"))
