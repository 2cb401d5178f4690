"""Files and tables that earlier versions lost or failed on."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywright.operators import documents, profile
from tallywright.sources import files


def test_no_file_is_lost(spark, tmp_path):
    names = ["a b.txt", "a..xlsx", "empty.txt", "zero.xlsx", "c+d.txt", "x.csv"]
    for n in names:
        (tmp_path / n).write_text("" if n in ("empty.txt", "zero.xlsx") else "text")
    texts = {r["file_name"]: r["text"] for r in files.read_text_files(spark, str(tmp_path)).collect()}
    assert sorted(texts) == sorted(names) and texts["empty.txt"] == "" and texts["a b.txt"] == "text"
    (tmp_path / "_budget.txt").write_text("1")
    (tmp_path / ".hidden.txt").write_text("2")
    listed = {r["file_name"] for r in files.list_files(spark, str(tmp_path)).collect()}
    assert listed == {*names, "_budget.txt", ".hidden.txt"}
    assert files.ingest_manifest(spark, str(tmp_path), "txt").count() == len(names) + 2
    texts = {r["file_name"]: r["text"] for r in files.read_text_files(spark, str(tmp_path)).collect()}
    assert texts["_budget.txt"] == "1" and texts[".hidden.txt"] == "2"
    (tmp_path / "a b.txt.meta.json").write_text('{"filename": "a b.txt"}')
    side = files.read_metadata_json(spark, str(tmp_path / "*.meta.json")).collect()
    assert [r["name"] for r in side] == ["a b.txt"]


def test_double_dot_has_a_suffix(spark):
    row = spark.range(1).select(documents.suffix(F.lit("a..xlsx")).alias("s")).first()
    assert row["s"] == ".xlsx"


def test_wide_table(spark):
    wide = spark.range(1).select(*[F.lit(i).alias(f"c{i}") for i in range(1500)])
    assert profile.infer_types(wide).count() == 1500
    assert profile.shape_metrics(wide).first()["total_columns"] == 1500


def test_no_numeric_column(spark):
    table = spark.createDataFrame([("a", "b")], "k string, v string")
    assert profile.summary_statistics(table).count() == 0
    assert profile.profile_by_group(table, ["k"]).count() == 0


def test_responses_do_not_multiply(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id int")
    responses = spark.createDataFrame([(1, "a"), (1, "b")], "doc_id int, response string")
    got = {r["doc_id"]: r["response"] for r in documents.attach_responses(docs, responses).collect()}
    assert len(got) == 2 and got[1] == "b"


def test_prompts_hold_whole_texts(spark):
    docs = spark.createDataFrame([(1, "x" * 9000, "x" * 9000)], "doc_id int, text string, summary string")
    count = lambda df: df.first()["prompt"].count("x" * 100)
    assert count(documents.summary_prompts(docs)) == 40
    assert count(documents.summary_prompts(docs, chars=None)) == 90
    assert count(documents.insight_prompts(docs, "executive")) == 10
    assert count(documents.insight_prompts(docs, "executive", chars=None)) == 90
