"""One text per document out of its pages or blocks.

A document's text is one cell of the result, so its parts must meet in one
row. They do so in two steps: first each run of ``segment`` parts is joined,
then the runs. A document holding most of the pages is thus sorted and joined
by many tasks, and only its runs meet. ``segment=None`` joins in one step, for
data whose longest document is known to be short.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions import cells, text

# --- fixed values -----------------------------------------------------------
PAGE_MARK = "\n--- Page {page} ---\n"
CELL_SEPARATOR = " | "
LINE_SEPARATOR = "\n"
NO_TEXT = "No readable text found in the Word document."
# --- end of fixed values ----------------------------------------------------

SEGMENT = 1000


def _joined(order: Sequence[Column], part: Column, separator: str) -> Column:
    """Join a group's parts in order; NULL when none of them is present."""
    entries = F.collect_list(
        F.when(
            part.isNotNull(),
            F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], part.alias("p")),
        )
    )
    ordered = F.array_sort(entries)
    return F.when(
        F.size(entries) > 0, F.array_join(ordered.getField("p"), separator)
    )


def page_parts(
    pages: DataFrame, doc: str, page: str, content: str, segment: int = SEGMENT
) -> DataFrame:
    """Runs of pages (doc, part, text): the whole text in bounded rows.

    For documents too long for a single cell; ``page_concat`` joins the runs.
    """
    marked = text.fill(text_mark(), page=cells.name(page), text=_text(content))
    return (
        pages.select(
            cells.name(doc).alias(doc),
            cells.name(page).alias("_page"),
            marked.alias("_text"),
        )
        .groupBy(doc, F.floor(F.col("_page") / segment).alias("part"))
        .agg(_joined([F.col("_page")], F.col("_text"), "").alias("text"))
    )


def text_mark() -> str:
    return PAGE_MARK + "{text}"


def _text(content: str) -> Column:
    return F.coalesce(cells.name(content), F.lit(""))


def page_concat(
    pages: DataFrame,
    doc: str,
    page: str,
    content: str,
    segment: int | None = SEGMENT,
) -> DataFrame:
    """(doc, text): every page, in order, behind a line with its number."""
    if segment is None:
        marked = text.fill(text_mark(), page=cells.name(page), text=_text(content))
        return pages.groupBy(cells.name(doc)).agg(
            _joined([cells.name(page)], marked, "").alias("text")
        )
    parts = page_parts(pages, doc, page, content, segment)
    return parts.groupBy(doc).agg(
        _joined([F.col("part")], F.col("text"), "").alias("text")
    )


def block_concat(
    blocks: DataFrame, doc: str = "doc_id", segment: int | None = SEGMENT
) -> DataFrame:
    """(doc, text): paragraphs that are not blank, then table rows.

    ``blocks`` has ``kind`` (``para`` or ``cell``), ``block`` (number of the
    paragraph or of the table), ``row``, ``cell`` and ``text``. Cells are
    stripped, blank ones dropped and the rest joined within their row. A
    document without any text falls back to its raw paragraphs, then to a fixed
    sentence.
    """
    is_para = F.col("kind") == "para"
    raw = F.coalesce(F.col("text"), F.lit(""))
    stripped = text.strip(raw)
    line = F.when(is_para, F.col("block")).otherwise(F.col("row"))
    # paragraphs are numbered by block, table rows by table and row
    placed = blocks.select(
        cells.name(doc).alias(doc),
        F.when(is_para, F.lit(0)).otherwise(F.lit(1)).alias("_kind"),
        F.when(is_para, F.lit(0).cast("bigint"))
        .otherwise(F.col("block"))
        .alias("_table"),
        (F.floor(line / segment) if segment else F.lit(0)).alias("_run"),
        line.alias("_line"),
        F.col("cell").alias("_cell"),
        F.when(
            stripped != "", F.when(is_para, raw).otherwise(stripped)
        ).alias("_text"),
        F.when(is_para & (stripped == ""), raw).alias("_blank"),
    )
    # one shuffle serves both the lines and the runs they form
    run = [doc, "_kind", "_table", "_run"] if segment else [doc]
    order = [doc, "_kind", "_table", "_run"]
    lines = (
        placed.repartition(*run)
        .groupBy(*order, "_line")
        .agg(
            _joined([F.col("_cell")], F.col("_text"), CELL_SEPARATOR).alias("_text"),
            F.max("_blank").alias("_blank"),
        )
    )
    runs = lines.groupBy(*order).agg(
        _joined([F.col("_line")], F.col("_text"), LINE_SEPARATOR).alias("_text"),
        _joined([F.col("_line")], F.col("_blank"), " ").alias("_blank"),
    )
    places = [F.col(c) for c in ("_kind", "_table", "_run")]
    whole = runs.groupBy(doc).agg(
        text.strip(_joined(places, F.col("_text"), LINE_SEPARATOR)).alias("_text"),
        _joined(places, F.col("_blank"), " ").alias("_blank"),
    )
    return whole.select(
        doc,
        F.coalesce(
            F.nullif(F.col("_text"), F.lit("")),
            F.nullif(F.col("_blank"), F.lit("")),
            F.lit(NO_TEXT),
        ).alias("text"),
    )
