"""The documented question shapes on small frames."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from tallywright.operators import shapes

NAN = float("nan")


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(
        [(1, 5.0, "a"), (2, NAN, "b"), (3, None, "a"), (4, 150.0, None), (5, 150.0, "a")],
        "k int, x double, s string",
    ).repartition(3)


def keys(df):
    return [r["k"] for r in df.collect()]


def test_head_needs_an_order(frame):
    assert keys(shapes.head_n(frame, 2, ["k"])) == [1, 2]
    with pytest.raises(ValueError):
        shapes.head_n(frame, 2, [])


def test_top_puts_missing_last_and_breaks_ties(frame):
    assert keys(shapes.top_n(frame, 5, "x", ["k"])) == [4, 5, 1, 2, 3]


def test_filter_never_matches_missing(frame):
    assert sorted(keys(shapes.filter_gt(frame, "x", 100))) == [4, 5]


def test_average_and_distinct_skip_missing(frame):
    assert shapes.column_average(frame, "x").first()[0] == pytest.approx(305 / 3)
    assert shapes.count_unique(frame, "x").first()[0] == 2
    assert shapes.count_unique(frame, "s").first()[0] == 2
    assert shapes.count_unique(frame, "s", approx=True).first()[0] == 2


def test_value_counts(frame):
    rows = [tuple(r) for r in shapes.value_counts(frame, "s").collect()]
    assert rows == [("a", 3), ("b", 1)]
    assert [tuple(r) for r in shapes.value_counts(frame, "x").collect()] == [
        (150.0, 2),
        (5.0, 1),
    ]


def test_latest_by_key_keeps_the_last_written_row(spark):
    rows = [("f", 1, "old"), ("f", 3, "new"), ("f", 2, "mid"), ("g", None, "only")]
    df = spark.createDataFrame(rows, "name string, at int, note string").repartition(3)
    latest = shapes.latest_by_key(df, ["name"], ["at"])
    assert latest.columns == df.columns
    assert sorted(tuple(r) for r in latest.collect()) == [
        ("f", 3, "new"),
        ("g", None, "only"),
    ]


def test_latest_by_key_with_missing_keys_ties_and_odd_names(spark):
    rows = [
        (None, 1.0, 7, "a"),
        (None, NAN, 1, "b"),
        ("x", None, None, "c"),
        ("y", 0.0, 1, "d"),
        ("y", -0.0, 2, "e"),
        ("z", 1.0, 1, "f"),
        ("z", 1.0, 1, "f"),
    ]
    df = spark.createDataFrame(rows, "`the key` string, `a.b` double, _order0 int, _row string")
    latest = shapes.latest_by_key(df.repartition(3), ["the key"], ["a.b", "_order0"])
    assert latest.columns == df.columns
    assert sorted(r["_row"] for r in latest.collect()) == ["b", "c", "e", "f"]
    assert shapes.latest_by_key(df.limit(0), ["the key"], ["a.b"]).collect() == []


def test_latest_by_key_finds_the_winners_in_a_narrow_scan(spark, tmp_path):
    columns = ["id % 50 AS k", "id AS at", "repeat('x', 100) AS note", "map('a', id) AS m"]
    spark.range(1000).selectExpr(*columns).write.parquet(str(tmp_path / "t"))
    latest = shapes.latest_by_key(spark.read.parquet(str(tmp_path / "t")), ["k"], ["at"])
    assert sorted(r["at"] for r in latest.collect()) == list(range(950, 1000))
    plan = latest._jdf.queryExecution().executedPlan().toString()
    initial = plan[plan.index("Initial Plan") :]
    narrow = initial[initial.index("BroadcastExchange") :]
    assert "note" not in narrow and "Sort" not in narrow
    joined = initial[initial.index("BroadcastHashJoin") : initial.index("BroadcastExchange")]
    assert "LeftSemi" in joined and "Sort" not in joined and "Exchange" not in joined


def test_last_accessed(spark):
    rows = [("f", None), ("g", "2025-01-02"), ("h", "2025-01-02"), ("i", "2025-01-01")]
    df = spark.createDataFrame(rows, "name string, at string")
    assert [r["name"] for r in shapes.last_accessed(df, "at", ["name"]).collect()] == ["g"]
    assert shapes.last_accessed(df.limit(0), "at", ["name"]).collect() == []


@pytest.mark.parametrize("share", [0.003, 0.01, 0.2])
def test_frequent_values_are_all_there(spark, share):
    """Rare values come first, in between and last, many more than a sketch holds."""
    rng = random.Random(5)
    values = [f"rare{i}" for i in range(20_000)] + [f"v{i}" for i in range(40) for _ in range(30 * i)]
    values += ["hot"] * 15_000
    rng.shuffle(values)
    rows = [(v,) for v in values] + [(None,)] * 500
    df = spark.createDataFrame(rows, "`a.b` string").repartition(7)
    got = [tuple(r) for r in shapes.frequent_values(df, "a.b", share).collect()]
    counts = Counter(values)
    want = [(v, n) for v, n in counts.items() if n > share * len(values)]
    assert got == sorted(want, key=lambda x: (-x[1], x[0])) and got


def test_frequent_numbers(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, -0.0, 1.5, float("nan"), None, 2.5, 1.5, 0.0)], "x double")
    assert [tuple(r) for r in shapes.frequent_values(df, "x", 0.2).collect()] == [(0.0, 3), (1.5, 2)]
    assert shapes.frequent_values(df.limit(0), "x", 0.2).count() == 0
    with pytest.raises(ValueError, match="share"):
        shapes.frequent_values(df, "x", 0.0)
