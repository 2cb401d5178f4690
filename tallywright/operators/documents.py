"""Document tables: measuring, budgets, prompts, chunks, responses, types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions import cells, text

# --- fixed values -----------------------------------------------------------
EXTRACTORS = {".pdf": "pdf", ".txt": "txt", ".docx": "docx", ".doc": "docx"}
UNKNOWN_TYPE = "Unknown"
NO_INSIGHTS = "Unable to generate insights: no response"
# --- end of fixed values ----------------------------------------------------


def suffix(file_name: Column) -> Column:
    """Last extension with its dot, in its own case; '' when there is none."""
    return F.regexp_extract(file_name, r"[^/](\.[^./]+)$", 1)


def doc_type(df: DataFrame, file_name: str, strict: bool = False) -> DataFrame:
    """Add ``suffix``, ``extractor`` and ``file_type`` columns.

    An unknown extension gets no extractor, or fails the job when ``strict``.
    """
    ending = F.col("_suffix")
    extractor = F
    for known, label in EXTRACTORS.items():
        extractor = extractor.when(F.lower(ending) == known, F.lit(label))
    if strict:
        refusal = F.concat(F.lit("Unsupported file type: "), ending)
        extractor = extractor.otherwise(F.raise_error(refusal).cast("string"))
    shown = F.replace(F.upper(ending), F.lit("."), F.lit(""))
    return df.select("*", suffix(cells.name(file_name)).alias("_suffix")).select(
        *[cells.name(c) for c in df.columns],
        F.lower(ending).alias("suffix"),
        extractor.alias("extractor"),
        F.coalesce(F.nullif(shown, F.lit("")), F.lit(UNKNOWN_TYPE)).alias("file_type"),
    )


def text_metrics(df: DataFrame, content: str = "text") -> DataFrame:
    """Add word and character counts."""
    return df.select(
        "*",
        text.word_count(cells.name(content)).alias("word_count"),
        text.char_count(cells.name(content)).alias("char_count"),
    )


def text_preview(df: DataFrame, content: str = "text") -> DataFrame:
    return df.select("*", text.preview(cells.name(content)).alias("preview"))


def truncate_input(
    df: DataFrame, content: str = "text", chars: int | None = text.INPUT_CHARS
) -> DataFrame:
    return df.withColumn(content, text.truncate(cells.name(content), chars))


def summary_budget(df: DataFrame, label: str) -> DataFrame:
    return df.select("*", text.summary_budget(cells.name(label)).alias("max_words"))


def summary_prompts(
    df: DataFrame,
    doc: str = "doc_id",
    content: str = "text",
    words: Column | int = text.SUMMARY_WORDS_DEFAULT,
    chars: int | None = text.INPUT_CHARS,
) -> DataFrame:
    """(doc, prompt): the input table of a batch inference job.

    A prompt holds the first ``chars`` characters, or the whole text for None.
    """
    prompt = text.summary_prompt(cells.name(content), words, chars)
    return df.select(cells.name(doc), prompt.alias("prompt"))


def insight_prompts(
    df: DataFrame,
    report_type: Column | str,
    doc: str = "doc_id",
    summary: str = "summary",
    chars: int | None = text.INSIGHT_CHARS,
) -> DataFrame:
    """(doc, prompt), with the first ``chars`` characters of the summary or, for None, all."""
    prompt = text.insight_prompt(cells.name(summary), report_type, chars)
    return df.select(cells.name(doc), prompt.alias("prompt"))


def clean_response(df: DataFrame, response: str = "response") -> DataFrame:
    return df.withColumn(response, text.clean_response(cells.name(response)))


def lead_summary(
    df: DataFrame, words: Column | int, content: str = "text"
) -> DataFrame:
    """Add ``summary``: the document's first words.

    A repeatable stand-in where no model output is at hand, not a summary.
    """
    lead = text.lead_words(cells.name(content), words)
    return df.select("*", lead.alias("summary"))


def chunk_text(
    df: DataFrame,
    doc: str = "doc_id",
    content: str = "text",
    width: int = text.CHUNK_WIDTH,
    overlap: int = text.CHUNK_OVERLAP,
) -> DataFrame:
    """(doc, chunk_no, chunk): overlapping slices; an empty text has none."""
    pieces = text.chunks(cells.name(content), width, overlap)
    return df.select(
        cells.name(doc), F.posexplode(pieces).alias("chunk_no", "chunk")
    )


def attach_responses(
    docs: DataFrame,
    responses: DataFrame,
    doc: str = "doc_id",
    response: str = "response",
    fallback: str = NO_INSIGHTS,
) -> DataFrame:
    """Left join model output to its document; the fallback text if there is none.

    Of several responses to a document the last in the order of their text is taken,
    so documents are never multiplied.
    """
    answers = responses.groupBy(cells.name(doc).alias(doc)).agg(
        F.max(cells.name(response).cast("string")).alias("_response")
    )
    return (
        docs.join(answers, doc, "left")
        .withColumn(response, F.coalesce("_response", F.lit(fallback)))
        .drop("_response")
    )
