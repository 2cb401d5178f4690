"""Files, sidecars and sinks, written to a temporary folder and read back."""

from __future__ import annotations

import json

from tallywright.session import shared_folder
from tallywright.sources import files, tables


def test_text_files_utf8_or_latin1(spark, tmp_path):
    (tmp_path / "u.txt").write_bytes("é😀\r\nline\rend".encode())
    (tmp_path / "l.txt").write_bytes("caf\xe9 \x80".encode("latin-1"))
    rows = files.read_text_files(spark, str(tmp_path)).collect()
    assert {r["file_name"]: r["text"] for r in rows} == {
        "u.txt": "é😀\nline\nend",
        "l.txt": "caf\xe9 \x80",
    }


def write_sidecar(folder, name, **fields):
    (folder / f"{name}.meta.json").write_text(json.dumps(fields, indent=2))


def test_catalog(spark, tmp_path):
    for name in ("old.xlsx", "new.xls", "bare.xlsx", "broken.xlsx", "UP.XLSX", "n.pdf"):
        (tmp_path / name).write_bytes(b"12345")
    write_sidecar(tmp_path, "old.xlsx", filename="old.xlsx", uploaded_at="2025-01-01T00:00")
    write_sidecar(tmp_path, "new.xls", filename="new.xls", uploaded_at="2025-02-01T00:00")
    write_sidecar(tmp_path, "n.pdf", filename="n.pdf", uploaded_at="2025-03-01T00:00")
    (tmp_path / "broken.xlsx.meta.json").write_text("{not json")
    listed = files.list_files(spark, str(tmp_path))
    sidecars = files.read_metadata_json(spark, str(tmp_path / "*.meta.json"))
    excel = files.file_catalog(listed, sidecars).collect()
    assert [r["file_name"] for r in excel] == [
        "new.xls",
        "old.xlsx",
        "bare.xlsx",
        "broken.xlsx",
    ]
    assert [r["filename"] for r in excel] == ["new.xls", "old.xlsx", None, None]
    every = files.file_catalog(listed, sidecars, suffixes=None).collect()
    assert [r["file_name"] for r in every][:2] == ["n.pdf", "new.xls"]
    assert len(every) == 6


def test_access_map(spark, tmp_path):
    entry = {"path": "/x/a.xlsx", "sheet_name": None, "last_accessed": "2025", "file_type": ".xlsx"}
    (tmp_path / "good.json").write_text(json.dumps({"a.xlsx": entry}, indent=2))
    (tmp_path / "bad.json").write_text("{oops")
    rows = files.read_access_map(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in rows] == [("a.xlsx", "/x/a.xlsx", None, "2025", ".xlsx")]


def test_manifest_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"123")
    manifest = files.ingest_manifest(spark, str(tmp_path / "in"), "document")
    files.write_manifest(manifest, str(tmp_path / "out"))
    [row] = spark.read.schema(files.SIDECAR_SCHEMA).json(str(tmp_path / "out")).collect()
    assert (row["filename"], row["size_bytes"], row["file_type"]) == ("a.pdf", 3, "document")
    assert row["file_path"].endswith("/in/a.pdf")
    assert row["uploaded_at"].startswith("20")


def test_csv_round_trip_keeps_text_whole(spark, tmp_path):
    rows = [(1, ' "quoted", and\nbroken '), (2, ""), (3, None), (4, "a,b\\"), (5, "x\r\ny")]
    df = spark.createDataFrame(rows, "k int, s string")
    tables.write_csv(df, str(tmp_path / "t.csv"))
    back = tables.load_table(spark, str(tmp_path), "t", "csv", schema=df.schema)
    # an empty text reads back as missing, in pandas too
    assert sorted(map(tuple, back.collect())) == [rows[0], (2, None), *rows[2:]]
    inferred = tables.load_table(spark, str(tmp_path), "t", "csv")
    assert dict(inferred.dtypes) == {"k": "int", "s": "string"}
    first = next((tmp_path / "t.csv").glob("*.csv")).read_text(encoding="utf-8")
    assert first.startswith("k,s\n")


def test_json_table(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"a": 1}\n{"a": 2}\n')
    df = tables.load_table(spark, str(tmp_path), "t", "json")
    assert sorted(r["a"] for r in df.collect()) == [1, 2]


def test_summaries_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [("a.b.pdf", "néw"), ("plain", "")], "original_file string, summary string"
    )
    files.write_summaries(df, str(tmp_path / "s"), "2025-01-31T00:00:00")
    rows = {r["original_file"]: r for r in spark.read.parquet(str(tmp_path / "s")).collect()}
    assert rows["a.b.pdf"]["summary_file"] == "a.b_summary.txt"
    assert rows["plain"]["summary_file"] == "plain_summary.txt"
    assert (rows["a.b.pdf"]["summary_length"], rows["plain"]["summary_length"]) == (3, 0)


def test_reports_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [("k", "executive", "n", "# one\ntwo\n"), ("l", "business", "m", "x")],
        "report_key string, report_type string, report_name string, content string",
    )
    files.write_reports(df, str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p")).select(*df.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert (tmp_path / "p" / "report_type=executive").is_dir()
    files.write_reports(df.drop("report_name"), str(tmp_path / "t"), as_text=True)
    folder = tmp_path / "t" / "report_type=executive" / "report_key=k"
    assert next(folder.glob("*.txt")).read_text() == "# one\ntwo\n\n"


def test_shared_folder_is_the_clusters(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
