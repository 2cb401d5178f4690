"""Plans: what reaches the reader, what is shuffled, what stays in the JVM."""

from __future__ import annotations

import contextlib
import io

import pytest

from checks import queries
from tallywright.operators import assemble

PYTHON_BY_NATURE = {
    "topk_similar",  # matrix products
    "report_executive",  # a sample of at most ten rows printed as a text table
    "report_technical",
    "report_business",
    "report_whole_table",
    "read_text_files",  # files are opened in tasks
    "read_metadata_json",
    "write_report_files",
    "ingest_manifest",
}


def plan(df) -> str:
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        df.explain("formatted")
    return shown.getvalue()


@pytest.mark.parametrize("name", sorted(set(queries.ALL) - PYTHON_BY_NATURE))
def test_stays_in_the_jvm(spark, sf_dir, name):
    shown = plan(queries.ALL[name](spark, sf_dir))
    for python in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "InPandas"):
        assert python not in shown
    assert "CartesianProduct" not in shown
    assert "BroadcastNestedLoopJoin" not in shown


@pytest.mark.parametrize("name", sorted(PYTHON_BY_NATURE))
def test_no_cross_joins(spark, sf_dir, name):
    shown = plan(queries.ALL[name](spark, sf_dir))
    assert "CartesianProduct" not in shown
    assert "BroadcastNestedLoopJoin" not in shown


def test_filter_reaches_the_reader(spark, sf_dir):
    assert "GreaterThan(value,100.0)" in plan(queries.filter_gt(spark, sf_dir))


@pytest.mark.parametrize("name", ["head_n", "top_n", "last_accessed"])
def test_first_rows_need_no_global_sort(spark, sf_dir, name):
    shown = plan(queries.ALL[name](spark, sf_dir))
    assert "TakeOrderedAndProject" in shown
    assert "rangepartitioning" not in shown


def test_columns_are_pruned(spark, sf_dir):
    assert "ReadSchema: struct<o_totalprice:double>" in plan(
        queries.column_average(spark, sf_dir)
    )
    shown = plan(queries.numeric_stats(spark, sf_dir))
    assert "l_returnflag" not in shown and "l_shipdate" not in shown


@pytest.mark.parametrize(
    "name",
    ["text_metrics", "summary_prompts", "chunk_text", "clean_response", "doc_type",
     "report_html", "lead_summary", "coerce_mixed"],
)
def test_row_wise_work_is_not_shuffled(spark, sf_dir, name):
    assert "Exchange" not in plan(queries.ALL[name](spark, sf_dir))


def test_exact_statistics_hold_no_value_maps(spark, sf_dir):
    for name in ("numeric_stats", "profile_by_group", "summary_statistics"):
        shown = plan(queries.ALL[name](spark, sf_dir))
        assert "ObjectHashAggregate" not in shown
        assert "SortAggregate" not in shown
        assert "percentile" not in shown


def test_only_bounded_sides_are_broadcast_by_hint(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan(queries.numeric_stats(spark, sf_dir))
        for name in ("attach_responses", "file_catalog", "profile_by_group", "profile_by_supplier"):
            assert "BroadcastHashJoin" not in plan(queries.ALL[name](spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_samples_are_cut_before_the_shuffle(spark, sf_dir):
    assert "WindowGroupLimit" in plan(queries.ALL["report_business"](spark, sf_dir))


def test_blocks_are_shuffled_once_per_level(spark):
    blocks = spark.createDataFrame(
        [("d", "cell", 0, 0, 0, "a")],
        "doc_id string, kind string, block bigint, row bigint, cell bigint, text string",
    )
    for segment, shuffles in ((1000, 2), (None, 1)):
        shown = assemble.block_concat(blocks, segment=segment)
        physical = shown._jdf.queryExecution().executedPlan().toString()
        assert physical.count("Exchange hashpartitioning") == shuffles
