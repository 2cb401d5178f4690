"""Folders listed and read in tasks, and sets of named files written at once."""

from __future__ import annotations

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallywright.sources import files, folders

NAMES = ["a b.txt", "zero", "_x.txt", ".y", "deep/_in/.most/z+1.txt", "deep/empty", "deep/100%.txt"]


@pytest.fixture
def tree(tmp_path):
    for i, name in enumerate(NAMES):
        path = tmp_path / "tree" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"" if "empty" in name or name == "zero" else b"text" * i)
    (tmp_path / "tree" / "bare" / "folder").mkdir(parents=True)
    os.symlink(tmp_path / "tree", tmp_path / "tree" / "deep" / "loop")
    return str(tmp_path / "tree")


def test_every_file_at_any_depth(spark, tree):
    listed = {r["path"]: r for r in folders.list_files(spark, tree).collect()}
    assert set(listed) == {f"{tree}/{n}" for n in NAMES}
    for path, row in listed.items():
        assert row["size_bytes"] == os.path.getsize(path) and row["file_name"] == os.path.basename(path)
        assert abs(row["modified_at"].timestamp() - os.path.getmtime(path)) < 1
    texts = {r["path"]: r["text"] for r in files.read_text_files(spark, tree).collect()}
    assert texts == {f"{tree}/{n}": open(f"{tree}/{n}").read() for n in NAMES}


@pytest.mark.parametrize(
    "pattern, wanted",
    [
        ("/*.txt", ["a b.txt", "_x.txt"]),
        ("/{zero,a*}", ["a b.txt", "zero"]),
        ("/de?p", [n for n in NAMES if n.startswith("deep/")]),
        ("/*/*.txt", ["deep/100%.txt"]),
        ("/[_.]*", ["_x.txt", ".y"]),
        ("/deep/empty", ["deep/empty"]),
        ("/none*", []),
        ("/absent", []),
    ],
)
def test_patterns(spark, tree, pattern, wanted):
    found = folders.list_files(spark, tree + pattern).collect()
    assert {r["path"] for r in found} == {f"{tree}/{n}" for n in wanted}


def test_the_driver_holds_no_list(spark, tmp_path):
    (tmp_path / "many").mkdir()
    for i in range(5000):
        (tmp_path / "many" / f"{i}").write_text(str(i))
    read = folders.read_files(folders.list_files(spark, str(tmp_path / "many")))
    listed = folders.list_files(spark, str(tmp_path / "many"))
    assert "parquet" in listed._jdf.queryExecution().optimizedPlan().toString()
    assert read.select(F.sum(F.col("content").cast("string").cast("int"))).first()[0] == sum(range(5000))
    assert read.rdd.getNumPartitions() > 1


def test_named_files_round_trip(spark, tmp_path):
    rows = [("a b.md", "é\r\nx"), ("_hidden", ""), (".dot", None), ("100%+.txt", "y" * 100_000)]
    df = spark.createDataFrame([(n, c, i) for i, (n, c) in enumerate(rows)], "file_name string, content string, i int")
    target = tmp_path / "set"
    folders.write_files(df.repartition(3), str(target))
    assert {p.name: p.read_bytes() for p in target.iterdir()} == {n: (c or "").encode() for n, c in rows}
    assert [p.name for p in tmp_path.iterdir()] == ["set"]
    with pytest.raises(FileExistsError):
        folders.write_files(df, str(target))
    folders.write_files(df.limit(1), str(target), mode="overwrite")
    assert [p.name for p in target.iterdir()] == ["a b.md"] and [p.name for p in tmp_path.iterdir()] == ["set"]
    folders.write_files(df.select("file_name", F.col("content").cast("binary").alias("content")).limit(0), str(target), "overwrite")
    assert list(target.iterdir()) == []


def test_a_failed_task_leaves_no_half_set(spark, tmp_path):
    (tmp_path / "set").mkdir()
    (tmp_path / "set" / "old").write_text("kept")
    rows = spark.range(200).select(
        F.col("id").cast("string").alias("file_name"),
        F.when(F.col("id") == 150, F.raise_error(F.lit("no"))).otherwise("x").cast("string").alias("content"),
    )
    with pytest.raises(PySparkException):
        folders.write_files(rows.repartition(4, "file_name"), str(tmp_path / "set"), mode="overwrite")
    assert [p.name for p in tmp_path.iterdir()] == ["set"]
    assert [p.read_text() for p in (tmp_path / "set").iterdir()] == ["kept"]


@pytest.mark.parametrize("names", [["a", "a"], ["a/b"], [""], [None], [".."]])
def test_names_that_are_refused(spark, tmp_path, names):
    df = spark.createDataFrame([(n, "x") for n in names], "file_name string, content string")
    with pytest.raises((ValueError, PySparkException)):
        folders.write_files(df, str(tmp_path / "set"))
    assert list(tmp_path.iterdir()) == []


def test_corrupt_sidecars_keep_their_text(spark, tmp_path):
    texts = {"a.meta.json": '{"filename": "a", "size_bytes": 3}', "b.meta.json": "{oops", "_c.meta.json": "", "d.meta.json": "[1"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    rows = {r["name"]: r for r in files.read_metadata_json(spark, str(tmp_path / "*.meta.json")).collect()}
    assert (rows["a"]["filename"], rows["a"]["size_bytes"], rows["a"]["corrupt"]) == ("a", 3, None)
    assert {n: rows[n]["corrupt"] for n in ("b", "_c", "d")} == {"b": "{oops", "_c": "", "d": "[1"}
    assert rows["b"]["filename"] is None


def test_catalog_has_no_column_twice(spark, tmp_path):
    (tmp_path / "a.xlsx").write_text("12345")
    (tmp_path / "a.xlsx.meta.json").write_text('{"filename": "a.xlsx", "size_bytes": 4}')
    sidecars = files.read_metadata_json(spark, str(tmp_path / "*.meta.json"))
    catalog = files.file_catalog(files.list_files(spark, str(tmp_path)), sidecars)
    assert len(set(catalog.columns)) == len(catalog.columns)
    catalog.write.parquet(str(tmp_path / "out"))
    row = catalog.first()
    assert (row["size_bytes"], row["sidecar_size_bytes"]) == (5, 4)


def test_summaries_and_reports_as_files(spark, tmp_path):
    summaries = spark.createDataFrame([("a.b.pdf", "néw"), ("plain", None)], "original_file string, summary string")
    files.write_summary_files(summaries, str(tmp_path / "s"), "2025")
    assert {p.name: p.read_text() for p in (tmp_path / "s").iterdir()} == {"a.b_summary.txt": "néw", "plain_summary.txt": ""}
    reports = spark.createDataFrame([("k", "x_k.md", "# one\ntwo")], "report_key string, report_name string, content string")
    files.write_report_files(reports, str(tmp_path / "r"))
    assert (tmp_path / "r" / "x_k.md").read_text() == "# one\ntwo"


def test_contents_are_written_without_python_copies(tmp_path):
    import tracemalloc

    import pyarrow as pa

    texts = pa.array([f"📄{i}" + "x" * 20_000 for i in range(500)])
    batch = pa.RecordBatch.from_arrays([pa.array([f"{i}.md" for i in range(500)]), texts], ["file_name", "content"])
    writer = folders._NamedFilesWriter(str(tmp_path), str(tmp_path), ["file_name", "content"])
    tracemalloc.start()
    assert writer.write(iter([batch])).files == 500
    assert tracemalloc.get_traced_memory()[1] < 1 << 20
    tracemalloc.stop()
    assert (tmp_path / "7.md").read_text() == "📄7" + "x" * 20_000


def test_batches_of_long_contents_are_bounded(spark, tmp_path, monkeypatch):
    class Noted(folders._NamedFilesWriter):
        def write(self, iterator):
            def bounded():
                for batch in iterator:
                    if batch.nbytes > 40 << 20:
                        raise ValueError(f"{batch.nbytes} bytes at once")
                    yield batch

            return super().write(bounded())

    monkeypatch.setattr(folders, "_NamedFilesWriter", Noted)
    long = spark.range(0, 100, 1, 1).select(
        F.concat("id", F.lit(".md")).alias("file_name"), F.repeat(F.lit("text"), 250_000).alias("content")
    )
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    folders.write_files(long, str(tmp_path / "set"))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == before
    assert sum(p.stat().st_size for p in (tmp_path / "set").iterdir()) == 100_000_000
