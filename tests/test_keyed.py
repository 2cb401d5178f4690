"""Upserts into a stored table: replayed, interrupted, concurrent, compacted."""

from __future__ import annotations

import pytest

from tallywright.sources import keyed

COLUMNS = "name string, at int, note string, _key string, `o'dd row` map<string,int>"


@pytest.fixture
def path(spark, tmp_path):
    place = str(tmp_path / "it's here")
    keyed.create(spark, place, COLUMNS, ["name"], ["at"], buckets=3)
    return place


def batch(spark, *rows):
    return spark.createDataFrame([(*r, "k", {"m": 1}) for r in rows], COLUMNS).repartition(3)


def stored(spark, path, version=None):
    return sorted((r["name"] or "", r["at"], r["note"]) for r in keyed.read(spark, path, version).collect())


def test_later_rows_replace_earlier_ones(spark, path):
    assert stored(spark, path) == []
    first = batch(spark, ("f", 1, "old"), ("f", 3, "new"), (None, 1, "nameless"), ("g", None, "early"))
    assert keyed.upsert(spark, path, first, "b1") == 1
    second = batch(spark, ("f", 2, "late to come"), ("g", 0, "g0"), ("h", 1, "h1"), (None, 2, "still"))
    assert keyed.upsert(spark, path, second, "b2") == 2
    after = [("", 2, "still"), ("f", 3, "new"), ("g", 0, "g0"), ("h", 1, "h1")]
    assert stored(spark, path) == after
    assert stored(spark, path, 1) == [("", 1, "nameless"), ("f", 3, "new"), ("g", None, "early")]
    whole = keyed.read(spark, path)
    assert whole.columns == ["name", "at", "note", "_key", "o'dd row"]
    assert whole.first()["o'dd row"] == {"m": 1}


def test_a_replayed_batch_changes_nothing(spark, path):
    rows = batch(spark, ("f", 1, "a"))
    assert keyed.upsert(spark, path, rows, "b1") == 1
    assert keyed.upsert(spark, path, batch(spark, ("f", 2, "b")), "b2") == 2
    assert keyed.upsert(spark, path, rows, "b1") == 1
    assert keyed.upsert(spark, path, batch(spark, ("f", 2, "other")), "b3") == 3
    assert stored(spark, path) == [("f", 2, "b")]


def test_an_interrupted_upsert_is_not_seen(spark, path, monkeypatch):
    keyed.upsert(spark, path, batch(spark, ("f", 1, "a")), "b1")
    rows = batch(spark, ("f", 2, "b"), ("g", 1, "c"))
    with monkeypatch.context() as broken:
        def lost(*_):
            raise RuntimeError("lost")

        broken.setattr(keyed, "_commit", lost)
        with pytest.raises(RuntimeError):
            keyed.upsert(spark, path, rows, "b2")
    assert stored(spark, path) == [("f", 1, "a")]
    assert keyed.upsert(spark, path, rows, "b2") == 2
    assert stored(spark, path) == [("f", 2, "b"), ("g", 1, "c")]


def test_an_upsert_that_comes_second_is_listed_after_the_first(spark, path, monkeypatch):
    plain = keyed._write_part

    def overtaken(*args, **kwargs):
        monkeypatch.setattr(keyed, "_write_part", plain)
        read_before = keyed._state(spark, path)["version"]
        keyed.upsert(spark, path, batch(spark, ("f", 5, "first")), "other")
        assert keyed._state(spark, path)["version"] == read_before + 1
        plain(*args, **kwargs)

    monkeypatch.setattr(keyed, "_write_part", overtaken)
    assert keyed.upsert(spark, path, batch(spark, ("f", 4, "second"), ("g", 1, "g")), "mine") == 2
    assert stored(spark, path) == [("f", 5, "first"), ("g", 1, "g")]


def test_a_version_is_never_replaced(spark, path):
    state = keyed._state(spark, path)
    assert not keyed._commit(spark, path, state)
    with pytest.raises(ValueError):
        keyed.create(spark, path, COLUMNS, ["name"], ["at"])
    with pytest.raises(ValueError):
        keyed.read(spark, path, 7)


def test_compaction_keeps_the_rows_and_old_versions(spark, path):
    for n in range(4):
        rows = batch(spark, ("f", 4 - n, f"f{n}"), (f"g{n}", n, "x"))
        keyed.upsert(spark, path, rows, f"b{n}", max_parts=3)
    state = keyed._state(spark, path)
    assert (state["version"], len(state["parts"])) == (5, 1)
    assert stored(spark, path) == stored(spark, path, 4)
    assert stored(spark, path)[0] == ("f", 4, "f0")
    assert keyed.upsert(spark, path, batch(spark, ("f", 4, "no")), "b0") == 1
    assert keyed.upsert(spark, path, batch(spark, ("f", 9, "yes")), "b9") == 6
    assert stored(spark, path)[0] == ("f", 9, "yes")


def test_only_new_records_are_shuffled(spark, path):
    for n in range(2):
        keyed.upsert(spark, path, batch(spark, ("f", n, "x")), f"b{n}")
    plan = keyed.read(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Exchange" not in plan
