"""One query per operator: (spark, folder of the tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.inputs import CREATED_AT, REPORT_TIME, table, view
from tallywright.operators import assemble, documents, profile, retrieval, shapes
from tallywright.plans import reports
from tallywright.session import shared_folder
from tallywright.sources import files, folders, keyed, tables

Query = Callable[[SparkSession, str], DataFrame]


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in columns})


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid4().hex}"


# --- sources ------------------------------------------------------------------


def load_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load_table(spark, sf_dir, "orders")


def read_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark texts, written as one file each and read back."""
    folder = _fresh(spark, "text-files")
    items = table(spark, sf_dir, "benchmark")
    items.write.partitionBy("item_id").text(folder)
    item = F.regexp_extract("path", r"item_id=([0-9]+)/", 1).cast("bigint")
    # without the writer's own marker and checksums
    read = files.read_text_files(spark, folder).where("file_name LIKE 'part-%'")
    return read.select(item.alias("item_id"), "text")


def page_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = view(spark, sf_dir, "conversation_pages")
    return assemble.page_concat(pages, "conv_id", "page", "text")


def block_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a table: a row per turn, cells role and text."""
    cell = F.posexplode(F.array("role", "text")).alias("cell", "text")
    blocks = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"),
        F.lit("cell").alias("kind"),
        F.lit(0).cast("bigint").alias("block"),
        F.col("turn").alias("row"),
        cell,
    )
    return assemble.block_concat(blocks)


def doc_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = view(spark, sf_dir, "documents_named").select("doc_id", "file_name")
    return documents.doc_type(named, "file_name")


def file_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.file_catalog(
        view(spark, sf_dir, "catalog_files"), view(spark, sf_dir, "catalog_sidecars")
    )


def read_metadata_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sidecar file per supplier, some broken, some under a name Spark passes over."""
    folder = _fresh(spark, "sidecars")
    folders.write_files(view(spark, sf_dir, "supplier_sidecars"), folder)
    read = files.read_metadata_json(spark, f"{folder}/*.meta.json")
    size = F.col("size_bytes").cast("double").alias("size_bytes")
    return read.select("name", "filename", size, "uploaded_at", "file_type", "corrupt")


def parse_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "props")
    return files.parse_metadata(events, "props", "k bigint").select(
        "event_id", F.col("metadata.k").alias("k")
    )


# --- sinks --------------------------------------------------------------------


def write_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _fresh(spark, "csv")
    source = table(spark, sf_dir, "conversations")
    tables.write_csv(source, f"{folder}/conversations.csv")
    return tables.load_table(
        spark, folder, "conversations", fmt="csv", schema=source.schema
    )


def load_csv_with_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in quotes, each with a line break behind, through CSV files."""
    folder = _fresh(spark, "csv")
    quoted = F.concat(F.lit('"'), "text", F.lit('"\n'), "lang")
    source = table(spark, sf_dir, "documents").select("doc_id", quoted.alias("quoted"), "n_chars")
    tables.write_csv(source, f"{folder}/documents.csv")
    return tables.load_table(spark, folder, "documents", fmt="csv", schema=source.schema)


def write_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _fresh(spark, "reports")
    files.write_reports(report_document(spark, sf_dir), folder)
    return spark.read.parquet(folder).select(
        F.col("report_key").cast("bigint").alias("doc_id"),
        "report_type",
        "report_name",
        "content",
        "lead",
    )


def write_report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown file per document's report, read back under its own name."""
    folder = _fresh(spark, "report-files")
    files.write_report_files(report_document(spark, sf_dir), folder)
    read = folders.read_files(files.list_files(spark, folder))
    return read.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("report_name"),
        F.col("content").cast("string").alias("content"),
    )


def report_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return reports.report_html(docs, "text").select("doc_id", "html")


def write_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _fresh(spark, "summaries")
    summaries = _whole(spark, sf_dir).select(
        "doc_id", F.col("file_name").alias("original_file"), "summary", "lead"
    )
    files.write_summaries(summaries, folder, CREATED_AT)
    return spark.read.parquet(folder)


def ingest_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of every document's text as a file of its own."""
    folder = _fresh(spark, "ingested")
    folders.write_files(view(spark, sf_dir, "document_files"), folder)
    manifest = files.ingest_manifest(spark, folder, "document")
    # the dates are those of the files just written
    return manifest.where("uploaded_at IS NOT NULL").select(
        "filename",
        "size_bytes",
        "file_type",
        F.regexp_extract("file_path", r"([^/]+)$", 1).alias("file_name"),
    )


# --- projections and filters ----------------------------------------------------


def filter_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.filter_gt(table(spark, sf_dir, "events"), "value", 100.0)


def coerce_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = view(spark, sf_dir, "lineitem_text")
    return profile.coerce_mixed(typed, null_token="nan")


def select_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.select_roles(table(spark, sf_dir, "part"), "numeric")


# --- profiling ------------------------------------------------------------------


def infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.infer_types(view(spark, sf_dir, "lineitem_text"))


def mixed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.mixed_columns(view(spark, sf_dir, "lineitem_text"))


def shape_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.shape_metrics(view(spark, sf_dir, "events_missing"))


def missing_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = profile.missing_by_column(view(spark, sf_dir, "events_missing"))
    return _rounded(missing, "missing_pct")


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = profile.completeness(view(spark, sf_dir, "events_missing"))
    return _rounded(share, "completeness_pct")


def schema_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = profile.schema_description(
        table(spark, sf_dir, "customer"), ["c_custkey"]
    )
    return described.select(
        "row_count",
        "column_count",
        F.array_join("column_names", ", ").alias("column_names"),
        F.array_join("column_types", ", ").alias("column_types"),
        F.array_join("sample_data", "\n").alias("sample_data"),
    )


_STATISTICS = ("mean", "median", "min", "max", "std")


def numeric_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = profile.numeric_stats(table(spark, sf_dir, "lineitem"))
    return _rounded(stats, *_STATISTICS)


def numeric_stats_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With missing cells, and a column that has no value at all."""
    events = view(spark, sf_dir, "events_missing").withColumn(
        "nothing", F.expr("CASE WHEN value < 0 THEN value END")
    )
    return _rounded(profile.numeric_stats(events), *_STATISTICS)


def profile_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = profile.profile_by_group(
        table(spark, sf_dir, "lineitem"), ["l_returnflag"]
    )
    return _rounded(stats, *_STATISTICS)


def profile_by_many_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group per customer.

    Means over few prices often end in a 5 at the fifth place, hence six places.
    """
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    stats = profile.profile_by_group(orders, ["o_custkey"])
    return _rounded(stats, *_STATISTICS[1:]).withColumn("mean", F.round("mean", 6))


def _with_totals(stats: DataFrame) -> DataFrame:
    """A sum in place of the mean: many a mean ends in a 5, whatever place it is cut at."""
    total = F.round(F.col("mean") * F.col("n"), 4)
    return _rounded(stats.withColumn("total", total), *_STATISTICS[1:]).drop("mean")


def profile_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    columns = ["l_quantity", "l_extendedprice", "l_discount"]
    return _with_totals(profile.profile_by_group(items, ["l_suppkey"], columns))


def profile_by_event_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a group of rows that have no type."""
    events = view(spark, sf_dir, "events_missing")
    return _with_totals(profile.profile_by_group(events, ["event_type"]))


# --- documented question shapes ---------------------------------------------------


def head_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.head_n(table(spark, sf_dir, "orders"), 10, ["o_orderkey"])


def column_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    average = shapes.column_average(table(spark, sf_dir, "orders"), "o_totalprice")
    return _rounded(average, "average")


def count_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.count_unique(table(spark, sf_dir, "events"), "user_id")


def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.value_counts(view(spark, sf_dir, "events_missing"), "event_type")


def frequent_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of props that more than a hundredth of the events have."""
    return shapes.frequent_values(table(spark, sf_dir, "events"), "props", 0.01)


def summary_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = profile.summary_statistics(view(spark, sf_dir, "events_missing"))
    return _rounded(summary, "mean", "std", "min", "p25", "p50", "p75", "max")


def top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return shapes.top_n(orders, 10, "o_totalprice", ["o_orderkey"])


def latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return shapes.latest_by_key(events, ["user_id"], ["ts", "event_id"])


def upsert_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event per user: the events of each day's second half come in first."""
    events = table(spark, sf_dir, "events")
    path = _fresh(spark, "keyed")
    keyed.create(spark, path, events._jdf.schema().toDDL(), ["user_id"], ["ts", "event_id"])
    first = F.coalesce(F.hour("ts") >= 12, F.lit(False))
    for batch, part in [("second", first), ("first", ~first), ("second", first)]:
        keyed.upsert(spark, path, events.where(part), batch)
    keyed.compact(spark, path)
    return keyed.read(spark, path)


def last_accessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.last_accessed(table(spark, sf_dir, "events"), "ts", ["event_id"])


# --- joins ------------------------------------------------------------------------


def attach_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return documents.attach_responses(docs, view(spark, sf_dir, "label_responses"))


# --- text and document preparation --------------------------------------------------


def text_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return documents.text_metrics(docs).drop("text")


def text_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return documents.text_preview(docs).drop("text")


def truncate_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return documents.truncate_input(docs)


def summary_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = view(spark, sf_dir, "documents_named").select("doc_id", "length_label")
    return documents.summary_budget(docs, "length_label")


def summary_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents.summary_budget(
        view(spark, sf_dir, "documents_named"), "length_label"
    )
    return documents.summary_prompts(docs, words=F.col("max_words"))


def insight_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return documents.insight_prompts(docs, "executive", summary="text")


def clean_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.clean_response(view(spark, sf_dir, "conversation_responses"))


def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.chunk_text(table(spark, sf_dir, "documents"))


def _summarised(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents.summary_budget(
        view(spark, sf_dir, "documents_named"), "length_label"
    )
    return documents.lead_summary(docs, F.col("max_words"))


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their whole text in place of a summary, and the leading words beside it."""
    led = _summarised(spark, sf_dir).withColumnRenamed("summary", "lead")
    return led.withColumn("summary", F.col("text"))


def lead_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summarised(spark, sf_dir).select("doc_id", "max_words", "summary")


# --- retrieval ----------------------------------------------------------------------


def topk_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the mean vector of every label, the three nearest of all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    means = (
        vectors.select("label", F.posexplode("embedding").alias("place", "x"))
        .groupBy("label", "place")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy("label")
        .agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("parts"))
        .select("label", F.col("parts.x").alias("mean"))
    )
    found = retrieval.topk_similar(
        means, vectors, "label", "mean", "vec_id", "embedding"
    )
    return found.withColumn("score", F.round("score", 6))


def topk_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every vector the three nearest of all, with blocks of few queries."""
    vectors = table(spark, sf_dir, "embeddings")
    found = retrieval.topk_pruned(
        vectors, vectors, "vec_id", "embedding", "vec_id", "embedding", max_queries=512
    )
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


# --- reports --------------------------------------------------------------------------


def _data_report(report_type: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return reports.data_reports(
            table(spark, sf_dir, "customer"),
            report_type,
            order_by=["c_custkey"],
            generated=REPORT_TIME,
            by="c_mktsegment",
        )

    return query


def report_whole_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.data_reports(
        table(spark, sf_dir, "customer"),
        "executive",
        order_by=["c_custkey"],
        generated=REPORT_TIME,
        source="customers",
    )


def report_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    answered = documents.attach_responses(
        _whole(spark, sf_dir), view(spark, sf_dir, "label_responses")
    )
    return reports.document_reports(
        answered, "executive", generated=REPORT_TIME, insights="response", keep=["lead"]
    )


ALL: dict[str, Query] = {
    q.__name__: q
    for q in (
        load_table,
        read_text_files,
        page_concat,
        block_concat,
        doc_type,
        file_catalog,
        read_metadata_json,
        parse_metadata,
        write_csv,
        load_csv_with_breaks,
        write_reports,
        write_report_files,
        report_html,
        write_summaries,
        ingest_manifest,
        filter_gt,
        coerce_mixed,
        select_roles,
        infer_types,
        mixed_columns,
        shape_metrics,
        missing_by_column,
        completeness,
        schema_description,
        numeric_stats,
        numeric_stats_missing,
        profile_by_group,
        profile_by_many_groups,
        profile_by_supplier,
        profile_by_event_type,
        head_n,
        column_average,
        count_unique,
        value_counts,
        frequent_values,
        summary_statistics,
        top_n,
        latest_by_key,
        upsert_by_key,
        last_accessed,
        attach_responses,
        text_metrics,
        text_preview,
        truncate_input,
        summary_budget,
        summary_prompts,
        insight_prompts,
        clean_response,
        chunk_text,
        lead_summary,
        topk_similar,
        topk_pruned,
        report_document,
        report_whole_table,
    )
}
ALL |= {f"report_{t}": _data_report(t) for t in reports.REPORT_TYPES}
