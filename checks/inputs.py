"""Inputs derived from the given tables, worded once for Spark and DuckDB."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

REPORT_TIME = datetime(2025, 1, 31, 15, 4, 5)
CREATED_AT = "2025-01-31T15:04:05"

_INTEGER = "CAST(l_linenumber AS {text})"
_DECIMAL = "concat(CAST(l_linenumber AS {text}), '.5')"

_SUPPLIER_FILE = (
    "concat(CASE s_suppkey % 3 WHEN 0 THEN '_' WHEN 1 THEN '.' ELSE '' END,"
    " 'supplier ', CAST(s_suppkey AS {text}), '.xlsx')"
)

# Per view: its source table and its columns; {text} is the engine's text type.
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    # events with missing cells
    "events_missing": (
        "events",
        (
            "event_id",
            "ts",
            "user_id",
            "nullif(event_type, 'error') AS event_type",
            "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value",
            "props",
        ),
    ),
    # text columns whose cells differ in kind
    "lineitem_text": (
        "lineitem",
        (
            "l_orderkey",
            "l_quantity",
            f"CASE WHEN l_linenumber = 1 THEN NULL"
            f" WHEN l_linenumber IN (2, 3) THEN {_INTEGER}"
            f" WHEN l_linenumber IN (4, 5) THEN {_DECIMAL}"
            f" ELSE l_returnflag END AS t_any",
            f"CASE WHEN l_linenumber = 1 THEN NULL"
            f" WHEN l_linenumber IN (4, 5) THEN {_DECIMAL}"
            f" ELSE l_returnflag END AS t_mixed",
            f"CASE WHEN l_linenumber = 1 THEN NULL"
            f" WHEN l_linenumber IN (2, 3) THEN {_INTEGER}"
            f" ELSE {_DECIMAL} END AS t_numbers",
            "CASE WHEN l_linestatus = 'O' THEN 'true' ELSE 'False' END AS t_flag",
            "CAST(CAST(l_shipdate AS date) AS {text}) AS t_day",
            "l_returnflag",
            "l_shipdate",
        ),
    ),
    # documents as uploaded files, with the summary length asked for
    "documents_named": (
        "documents",
        (
            "doc_id",
            "concat('doc_', CAST(doc_id AS {text}), CASE lang WHEN 'en' THEN '.pdf'"
            " WHEN 'de' THEN '.DOCX' WHEN 'fr' THEN '.md' ELSE '' END) AS file_name",
            "CASE lang WHEN 'en' THEN 'Short (500 words)'"
            " WHEN 'de' THEN 'Medium (800 words)'"
            " WHEN 'fr' THEN 'Long (2000 words)' ELSE 'Other' END AS length_label",
            "text",
        ),
    ),
    # spreadsheets, other files and sidecars, and the upload dates of some
    "catalog_files": (
        "documents",
        (
            "concat('doc_', CAST(doc_id AS {text}), CASE lang WHEN 'en' THEN '.xlsx'"
            " WHEN 'de' THEN '.xls' WHEN 'fr' THEN '.XLS' ELSE '.json' END)"
            " AS file_name",
            "n_chars AS size_bytes",
        ),
    ),
    "catalog_sidecars": (
        "labels",
        (
            "concat('doc_', CAST(doc_id AS {text}), '.xlsx') AS name",
            "concat('2025-01-0', CAST(1 + quality AS {text}), 'T0',"
            " CAST(toxic AS {text}), ':00:00') AS uploaded_at",
        ),
    ),
    # documents as files to be written
    "document_files": (
        "documents",
        ("concat('doc_', CAST(doc_id AS {text}), '.txt') AS file_name", "text AS content"),
    ),
    # a sidecar per supplier: some broken, some with a name that Spark passes over
    "supplier_sidecars": (
        "supplier",
        (
            f"concat({_SUPPLIER_FILE}, '.meta.json') AS file_name",
            f"CASE WHEN s_suppkey % 10 = 3 THEN concat('{{{{\"filename\": \"', {_SUPPLIER_FILE})"
            f" ELSE concat('{{{{\"filename\": \"', {_SUPPLIER_FILE}, '\", \"size_bytes\": ',"
            f" CAST(s_suppkey * 1000 AS {{text}}), ', \"uploaded_at\": \"2025-01-0',"
            f" CAST(1 + s_suppkey % 9 AS {{text}}), '\", \"file_type\": \"',"
            f" CASE WHEN s_suppkey % 2 = 0 THEN 'xlsx' ELSE 'csv' END, '\"}}}}') END AS content",
        ),
    ),
    # responses of a model for some of the documents
    "label_responses": (
        "labels",
        (
            "doc_id",
            "concat('quality ', CAST(quality AS {text}), ', toxic ',"
            " CAST(toxic AS {text})) AS response",
        ),
    ),
    # conversations as pages, and as responses with and without fences
    "conversation_pages": (
        "conversations",
        ("conv_id", "turn + 1 AS page", "text"),
    ),
    "conversation_responses": (
        "conversations",
        (
            "conv_id",
            "turn",
            "CASE turn % 4"
            " WHEN 0 THEN concat('Here: ```python\n', text, '\n``` done')"
            " WHEN 1 THEN concat(' ```sql\n', text, '```')"
            " WHEN 2 THEN concat('```', text)"
            " ELSE concat('  ', text, ' \n') END AS response",
        ),
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = VIEWS[name]
    return table(spark, sf_dir, source).selectExpr(
        *[c.format(text="string") for c in columns]
    )


def with_views(*names: str) -> str:
    """A SQL WITH clause defining the views for DuckDB."""
    parts = [
        f"{n} AS (SELECT {', '.join(VIEWS[n][1]).format(text='varchar')}"
        f" FROM {VIEWS[n][0]})"
        for n in names
    ]
    return "WITH " + ", ".join(parts)
