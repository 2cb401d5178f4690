"""CSV files with line breaks in cells, cut into records by many tasks."""

from __future__ import annotations

import csv
import random

import pytest

from tallywright.sources import csv_records, tables

SCHEMA = "id int, note string, value double"


@pytest.fixture
def tiny_splits(spark):
    """Splits of a few hundred bytes, so that cells cross them."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "300")
    spark.conf.set(names[1], "1")
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def cell(r: random.Random) -> str:
    kinds = ["plain", 'a "quoted" word', "two\nlines", "x\r\ny", ',;"\n"', '"', '\n\n', "ü 漢\n字", "b\\", 'c\\"']
    return r.choice([*kinds, "long " * 200 + "\n" + "z\n" * 200, "no break " * 100])


def rows_of(spark, folder, **more):
    return sorted((r["id"], r["note"], r["value"]) for r in tables.load_table(spark, folder, "t", "csv", **more).collect())


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_many_tasks_read_what_python_wrote(spark, tmp_path, tiny_splits, ending):
    wanted = []
    (tmp_path / "t.csv").mkdir()
    for part in range(3):
        r = random.Random(part)
        rows = [(part * 1000 + i, cell(r), i / 2) for i in range(20)]
        wanted += rows
        with open(tmp_path / "t.csv" / f"{part}.csv", "w", newline="", encoding="utf-8") as file:
            writer = csv.writer(file, lineterminator=ending)
            writer.writerows([("id", "note", "value"), *rows])
    found = csv_records.read_records(spark, str(tmp_path / "t.csv"))
    assert found.count() == 63 and found.where("first").count() == 3
    assert found.rdd.getNumPartitions() > 10
    assert rows_of(spark, str(tmp_path), schema=SCHEMA) == sorted(wanted)
    assert rows_of(spark, str(tmp_path)) == sorted(wanted)


def test_a_header_with_breaks_and_blank_lines(spark, tmp_path, tiny_splits):
    name = "a\nname" + "\n" * 700
    text = f'\n\r\n"{name}",b\n\n1,"x\n"\n \n"",2\n3,"last\n4'
    (tmp_path / "t.csv").write_bytes(text.encode())
    table = tables.load_table(spark, str(tmp_path), "t", "csv", schema="`x y` string, b string")
    assert {tuple(r) for r in table.collect()} >= {("1", "x\n"), (None, "2"), (" ", None)}
    inferred = tables.load_table(spark, str(tmp_path), "t", "csv")
    assert inferred.columns == [name, "b"]


def test_files_without_records(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes(b"id,note,value\n")
    assert rows_of(spark, str(tmp_path), schema=SCHEMA) == []
    inferred = tables.load_table(spark, str(tmp_path), "t", "csv")
    assert inferred.columns == ["id", "note", "value"] and inferred.collect() == []


def test_loose_quotes_are_left_to_one_task(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes(b'id,note,value\n1,5" pipe,2\n2,"a\nb",3\n')
    assert rows_of(spark, str(tmp_path), loose_quotes=True) == [(1, '5" pipe', 2), (2, "a\nb", 3)]


def test_a_split_of_another_scan_is_refused(spark, tmp_path, tiny_splits):
    (tmp_path / "t.csv").write_text("id,note,value\n" + "1,x,2\n" * 400)
    records = csv_records.read_records(spark, str(tmp_path / "t.csv"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "450")
    with pytest.raises(Exception, match="split anew"):
        records.count()
