"""Files and their sidecar metadata: texts, listings, manifests, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.functions import cells
from tallywright.operators.documents import suffix
from tallywright.sources import folders

# --- fixed values -----------------------------------------------------------
SIDECAR_ENDING = ".meta.json"
SIDECAR_SCHEMA = (
    "filename string, size_bytes bigint, uploaded_at string, "
    "file_type string, file_path string"
)
ACCESS_SCHEMA = (
    "path string, sheet_name string, last_accessed string, file_type string"
)
EXCEL_SUFFIXES = (".xlsx", ".xls")
SUMMARY_ENDING = "_summary.txt"
# --- end of fixed values ----------------------------------------------------
CORRUPT = "corrupt"


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, file_name, text): whole files at any depth, UTF-8 or else Latin-1.

    A file with any invalid UTF-8 sequence is read as Latin-1 altogether. Line
    ends become ``\\n``, as Python's text mode makes them. A file without bytes is
    an empty text, and names that Spark's readers pass over are read as well.
    """
    files = folders.read_files(folders.list_files(spark, path))
    as_utf8 = F.col("content").cast("string")
    content = F.when(F.is_valid_utf8(as_utf8), as_utf8).otherwise(
        F.decode("content", "ISO-8859-1")
    )
    return files.select(
        "path",
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"),
        F.regexp_replace(content, r"\r\n?", "\n").alias("text"),
    )


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, path, size_bytes, modified_at) of every file, none left out."""
    return folders.list_files(spark, path)


def read_metadata_json(
    spark: SparkSession, path: str, schema: T.StructType | str = SIDECAR_SCHEMA
) -> DataFrame:
    """Sidecar files, one row each: their fields, ``name``, ``path`` and ``corrupt``.

    ``name`` is the file that the sidecar belongs to. A file that is not JSON of
    these fields has them missing and its whole text in ``corrupt``.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    wide = T.StructType([*fields.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    text = read_text_files(spark, path).withColumn("parsed", F.from_json("text", wide, options))
    # an empty file and a bare null parse to nothing at all
    broken = F.when(F.col("parsed").isNull(), F.col("text")).otherwise(F.col(f"parsed.{CORRUPT}"))
    return text.select(
        *[F.col("parsed").getField(f.name).alias(f.name) for f in fields],
        F.regexp_replace("file_name", r"\.meta\.json$", "").alias("name"),
        "path",
        broken.alias(CORRUPT),
    )


def read_access_map(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, path, sheet_name, last_accessed, file_type) of keyed map files.

    A corrupt map counts as empty.
    """
    whole = spark.read.text(path, wholetext=True)
    return parse_metadata(
        whole, "value", f"map<string, struct<{_as_struct(ACCESS_SCHEMA)}>>"
    ).select(F.explode("metadata").alias("file_name", "entry")).select(
        "file_name", "entry.*"
    )


def _as_struct(columns: str) -> str:
    return ", ".join(c.strip().replace(" ", ": ", 1) for c in columns.split(","))


def parse_metadata(
    df: DataFrame, column: str, schema: T.StructType | str
) -> DataFrame:
    """Add ``metadata``, the column's JSON text read with the schema."""
    parsed = F.from_json(cells.name(column), schema, {"mode": "PERMISSIVE"})
    return df.select("*", parsed.alias("metadata"))


def file_catalog(
    files: DataFrame,
    sidecars: DataFrame,
    suffixes: Sequence[str] | None = EXCEL_SUFFIXES,
) -> DataFrame:
    """Files with their sidecar fields, newest upload first, undated ones last.

    ``files`` has ``file_name``; ``sidecars`` has ``name`` and ``uploaded_at``.
    JSON files are sidecars themselves and never listed. ``suffixes`` (compared
    in their own case) narrows the listing; None lists every file. A sidecar's
    column that the files have too is called ``sidecar_...``.
    """
    sidecars = sidecars.withColumnsRenamed(
        {c: f"sidecar_{c}" for c in sidecars.columns if c in files.columns}
    )
    ending = suffix(F.col("file_name"))
    kept = files.filter(ending != ".json")
    if suffixes is not None:
        kept = kept.filter(ending.isin(list(suffixes)))
    return (
        kept.join(sidecars, F.col("file_name") == F.col("name"), "left")
        .drop("name")
        .orderBy(F.desc_nulls_last("uploaded_at"), "file_name")
    )


def ingest_manifest(spark: SparkSession, path: str, file_type: str) -> DataFrame:
    """One manifest row per file, in the shape of a sidecar."""
    return list_files(spark, path).select(
        F.col("file_name").alias("filename"),
        "size_bytes",
        F.date_format("modified_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(
            "uploaded_at"
        ),
        F.lit(file_type).alias("file_type"),
        F.col("path").alias("file_path"),
    )


def write_manifest(manifest: DataFrame, path: str, mode: str = "errorifexists") -> None:
    manifest.write.mode(mode).json(path)


def summary_records(
    summaries: DataFrame, created_at: str, original_file: str = "original_file"
) -> DataFrame:
    """Add what is stored next to a summary: its file name, length and date."""
    stem = F.regexp_replace(cells.name(original_file), r"([^./])\.[^./]+$", "$1")
    base = F.regexp_extract(stem, r"([^/]*)$", 1)
    return summaries.select(
        "*",
        F.concat(base, F.lit(SUMMARY_ENDING)).alias("summary_file"),
        F.length("summary").alias("summary_length"),
        F.lit(created_at).alias("created_at"),
    )


def write_summaries(
    summaries: DataFrame, path: str, created_at: str, mode: str = "errorifexists"
) -> None:
    """Store summaries with their metadata as Parquet."""
    summary_records(summaries, created_at).write.mode(mode).parquet(path)


def write_reports(
    reports: DataFrame, path: str, mode: str = "errorifexists", as_text: bool = False
) -> None:
    """Store reports (report_key, report_type, content), partitioned by type.

    ``as_text`` writes one Markdown text per report in a folder of its own;
    that suits a handful of reports, not millions.
    """
    if as_text:
        reports = reports.select("content", "report_type", "report_key")
        reports.write.mode(mode).partitionBy("report_type", "report_key").text(path)
    else:
        reports.write.mode(mode).partitionBy("report_type").parquet(path)


def write_summary_files(
    summaries: DataFrame, path: str, created_at: str, mode: str = "errorifexists"
) -> None:
    """Store each summary as a text file of its own, under its ``summary_file`` name."""
    named = summary_records(summaries, created_at)
    folders.write_files(
        named.select(F.col("summary_file").alias("file_name"), F.col("summary").alias("content")), path, mode
    )


def write_report_files(reports: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store each report as a Markdown file of its own, under its ``report_name``."""
    folders.write_files(
        reports.select(F.col("report_name").alias("file_name"), "content"), path, mode
    )
