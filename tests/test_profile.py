"""Profiling: types, missing values, statistics, many groups."""

from __future__ import annotations

import math
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallywright.functions import cells
from tallywright.operators import profile, ranks

NAN = float("nan")


def one(frame):
    rows = frame.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def by_column(frame):
    return {r["column_name"]: r.asDict() for r in frame.collect()}


# --- types ----------------------------------------------------------------------


@pytest.mark.parametrize(
    ("column", "kind"),
    [
        (["1", "-2", "+3", None], "integer"),
        (["1.5", ".5", "-2.0e10", "1.2e-5"], "floating"),
        (["true", "False", "TRUE"], "boolean"),
        (["2020-01-31", "2020-01-31 10:00", "2020-01-31T10:00:00.5"], "datetime"),
        (["a", "", " ", "12 ", "1d", "NaN", "1\n", "tru", "-", "1e5"], "string"),
        ([None, None], "empty"),
        (["1", "1.5"], "mixed-integer-float"),
        (["1", "a"], "mixed-integer"),
        (["1", "true"], "mixed-integer"),
        (["1", "2020-01-31"], "mixed-integer"),
        (["1", "1.5", "a"], "mixed-integer"),
        (["a", "1.5"], "mixed"),
        (["a", "true"], "mixed"),
        (["a", "2020-01-31"], "mixed"),
        (["2020-13", "2020-01-31x"], "string"),
    ],
)
def test_kind_of_text(spark, column, kind):
    df = spark.createDataFrame([(c,) for c in column], "c string")
    assert one(profile.infer_types(df))["inferred_type"] == kind


def test_kind_of_typed_columns_needs_no_scan(spark):
    df = spark.range(3).select(
        F.col("id"),
        F.lit(1.0).alias("d"),
        F.lit(True).alias("b"),
        F.lit("2020-01-01").cast("timestamp_ntz").alias("t"),
        F.lit("2020-01-01").cast("date").alias("day"),
        F.lit(1).cast("decimal(10,2)").alias("dec"),
        F.array(F.lit(1)).alias("list"),
    )
    kinds = by_column(profile.infer_types(df))
    assert [kinds[c]["inferred_type"] for c in df.columns] == [
        "integer",
        "floating",
        "boolean",
        "datetime64",
        "date",
        "decimal",
        "mixed",
    ]


def test_mixed_columns_and_repair(spark):
    df = spark.createDataFrame(
        [("a", "1", 1.0), ("1.5", "b", NAN), (None, None, None)],
        "m string, mi string, x double",
    )
    assert [r["column_name"] for r in profile.mixed_columns(df).collect()] == ["m"]
    loose = profile.mixed_columns(df, strict=False).collect()
    assert sorted(r["column_name"] for r in loose) == ["m", "mi"]
    repaired = profile.coerce_mixed(df, null_token="nan").collect()
    assert [r["m"] for r in repaired] == ["a", "1.5", "nan"]
    assert [r["mi"] for r in repaired] == ["1", "b", None]
    kept = profile.coerce_mixed(df, ["x"])
    assert dict(kept.dtypes)["x"] == "string"
    assert [r["x"] for r in kept.collect()] == ["1.0", "NaN", None]
    named = profile.coerce_mixed(df, ["x"], null_token="nan").collect()
    assert [r["x"] for r in named] == ["1.0", "nan", "nan"]


def test_repair_changes_missing_counts_only_with_a_token(spark):
    df = spark.createDataFrame([("a",), ("1.5",), (None,)], "m string")
    plain = one(profile.shape_metrics(profile.coerce_mixed(df)))
    token = one(profile.shape_metrics(profile.coerce_mixed(df, null_token="nan")))
    assert (plain["missing_values"], token["missing_values"]) == (1, 0)


def test_roles(spark):
    df = spark.createDataFrame([(1, 1.0, True, "s")], "i int, d double, b boolean, s string")
    assert profile.select_roles(df, "numeric").columns == ["i", "d"]
    assert profile.select_roles(df, "categorical").columns == ["s"]
    with pytest.raises(ValueError):
        profile.select_roles(df, "other")


# --- missing values ---------------------------------------------------------------


def test_missing_counts_null_and_nan(spark):
    df = spark.createDataFrame(
        [(1.0, "a"), (NAN, None), (None, "b"), (2.0, "c")], "x double, s string"
    )
    assert one(profile.shape_metrics(df)) == {
        "total_rows": 4,
        "total_columns": 2,
        "missing_values": 3,
    }
    assert one(profile.completeness(df))["completeness_pct"] == 62.5
    missing = by_column(profile.missing_by_column(df))
    assert (missing["x"]["missing_count"], missing["x"]["missing_pct"]) == (2, 50.0)
    assert (missing["s"]["missing_count"], missing["s"]["missing_pct"]) == (1, 25.0)


def test_missing_of_odd_column_names(spark):
    df = spark.createDataFrame([(1.0, None)], "`a.b` double, `c d``e` string")
    assert {r["column_name"] for r in profile.missing_by_column(df, True).collect()} == {
        "c d`e"
    }
    assert by_column(profile.numeric_stats(df))["a.b"]["mean"] == 1.0


def test_empty_table(spark):
    df = spark.createDataFrame([], "x double, s string")
    assert profile.shape_metrics(df).count() == 0
    assert one(profile.completeness(df))["completeness_pct"] == 100.0
    assert by_column(profile.missing_by_column(df))["x"]["missing_pct"] == 0.0
    stats = by_column(profile.numeric_stats(df))["x"]
    assert [stats[m] for m in ("mean", "median", "min", "max", "std")] == [0.0] * 5
    assert one(profile.summary_statistics(df))["mean"] is None
    assert one(profile.schema_description(df, ["x"]))["sample_data"] == []


def test_table_without_numeric_columns(spark):
    df = spark.createDataFrame([("a",)], "s string")
    assert profile.numeric_stats(df).count() == 0


def test_schema_description(spark):
    df = spark.createDataFrame([(i, None) for i in (5, 3, 1, 4)], "k int, s string")
    described = one(profile.schema_description(df, ["k"]))
    assert described["row_count"] == 4
    assert described["column_names"] == ["k", "s"]
    assert described["column_types"] == ["int", "string"]
    assert described["sample_data"] == [f'{{"k":{k},"s":null}}' for k in (1, 3, 4)]


# --- statistics -------------------------------------------------------------------

HARD = {
    "uniform": [random.Random(1).uniform(-1e6, 1e6) for _ in range(501)],
    "even": [1.0, 2.0, 3.0, 10.0],
    "one": [4.25],
    "ties": [7.0] * 100 + [8.0] * 3 + [1.0],
    "signs": [-0.0, 0.0, -1.5, 1.5, -1e-300, 1e-300, 5e-324, -5e-324],
    "spread": [10.0**e for e in range(-300, 300, 7)],
    "huge": [1.7e308, 1.6e308, -1.7e308, 3e307, 1e300, 2.0**900, 2.0**900 * 1.0001],
    "narrow": [1e9 + i * 1e-6 for i in range(999)],
    "next": [1.0, math.nextafter(1.0, 2), math.nextafter(1.0, 0), 1.0 + 1e-12],
    "hot": [5.0] * 2000 + [random.Random(2).gauss(5, 1e-9) for _ in range(1000)],
    "infinite": [float("inf"), 1.0, 2.0, 3.0, float("-inf")],
}


@pytest.mark.parametrize("name", HARD)
def test_exact_quantiles(spark, name):
    numbers = list(HARD[name])
    random.Random(3).shuffle(numbers)
    df = spark.createDataFrame(
        [(x,) for x in [*numbers, NAN, None]], "x double"
    ).repartition(5)
    ordered = sorted(numbers)
    stats = by_column(profile.numeric_stats(df))["x"]
    assert stats["n"] == len(numbers)
    # the mean of the middle two, which overflows for neither here nor there
    assert stats["median"] == statistics.median(ordered)
    assert (stats["min"], stats["max"]) == (ordered[0], ordered[-1])
    summary = one(profile.summary_statistics(df))
    for q, got in ((0.25, summary["p25"]), (0.75, summary["p75"])):
        place = q * (len(ordered) - 1)
        low, high = ordered[math.floor(place)], ordered[math.ceil(place)]
        share = place - math.floor(place)
        expected = low if low == high else low + (high - low) * share
        assert got == pytest.approx(expected, rel=1e-12, abs=0)


@pytest.mark.parametrize("few_rows", [0, 3, 100])
@pytest.mark.parametrize("few_groups", [True, False])
def test_every_pass_is_exact(spark, few_rows, few_groups):
    """All of HARD as groups of one table, most buckets too large for two passes."""
    rows = [(name, x) for name, numbers in HARD.items() for x in numbers]
    rows += [("nothing", None), (None, 1.0), (None, 2.0), ("hot", None)]
    random.Random(6).shuffle(rows)
    long = spark.createDataFrame(rows, "g string, value double").repartition(5)
    found = ranks.quantiles(long, ["g"], [0.0, 0.5, 1.0], few_groups, few_rows)
    got = {r["g"]: r for r in found.collect()}
    assert set(got) == {*HARD, "nothing", None}
    for name, numbers in HARD.items():
        row = got[name]
        assert row["n"] == len(numbers)
        assert row["q0"] == row["min"] == min(numbers)
        assert row["q1"] == statistics.median(numbers)
        assert row["q2"] == row["max"] == max(numbers)
    assert (got["nothing"]["n"], got["nothing"]["q1"]) == (0, None)
    assert (got[None]["n"], got[None]["q1"]) == (2, 1.5)


def test_third_pass_reads_nothing_where_buckets_are_small(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    stats = profile.numeric_stats(df)
    assert stats.count() == 8
    stats.collect()
    done = stats._jdf.queryExecution().executedPlan().toString()
    assert done.split("== Initial Plan ==")[0].count("FileScan") == 2


def test_leading_bits_keep_the_order(spark):
    rng = random.Random(4)
    numbers = [rng.uniform(-1, 1) * 10.0 ** rng.randint(-320, 307) for _ in range(20000)]
    numbers += [2.0**k * (1 + rng.random()) for k in range(895, 905)]
    numbers += [1.7976931348623157e308, -1.7976931348623157e308, 5e-324]
    df = spark.createDataFrame([(x,) for x in numbers], "value double")
    for bits in (ranks.COARSE_BITS, ranks.FINE_BITS):
        rows = df.selectExpr("value", ranks.leading_bits("value", bits) + " AS b")
        rounded = [r["b"] for r in rows.collect()]
        order = np.argsort(numbers, kind="stable")
        buckets = np.array(rounded)[order]
        assert (buckets[1:] >= buckets[:-1]).all()
        assert len(set(rounded)) <= len(set(numbers))


def test_moments_of_groups(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame(
        {
            "g": np.where(rng.random(3000) < 0.6, "hot", rng.integers(0, 40, 3000)),
            "x": rng.normal(1e6, 1, 3000),
            "k": rng.integers(-5, 5, 3000),
        }
    )
    frame.loc[::17, "x"] = np.nan
    df = spark.createDataFrame(frame)
    expected = frame.groupby("g").agg(["mean", "median", "min", "max", "std", "count"])
    together = profile.profile_by_group(df, ["g"]).toPandas()
    # nothing small enough for a broadcast
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    shuffled = profile.profile_by_group(df, ["g"]).toPandas()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for got in (together, shuffled):
        assert len(got) == 2 * len(expected)
        for row in got.itertuples():
            want = expected.loc[row.g, row.column_name]
            assert row.n == want["count"]
            for m in ("mean", "median", "min", "max", "std"):
                assert getattr(row, m) == pytest.approx(want[m], rel=1e-9, nan_ok=True)


def test_group_keys_may_be_missing(spark):
    df = spark.createDataFrame(
        [(None, 1.0), (None, 3.0), ("a", None)], "g string, x double"
    )
    rows = {r["g"]: r for r in profile.profile_by_group(df, ["g"]).collect()}
    assert rows[None]["median"] == 2.0
    assert (rows["a"]["n"], rows["a"]["median"], rows["a"]["std"]) == (0, 0.0, 0.0)


def test_all_missing_column_is_zero_and_single_value_has_no_std(spark):
    df = spark.createDataFrame([(NAN, 2.0, None)], "a double, b double, c int")
    stats = by_column(profile.numeric_stats(df))
    for column in ("a", "c"):
        assert [stats[column][m] for m in ("mean", "median", "min", "max", "std")] == [
            0.0
        ] * 5
    assert stats["b"]["std"] is None
    assert stats["b"]["median"] == 2.0


def test_decimals_and_integers_count_as_numbers(spark):
    df = spark.range(1, 5).select(
        F.col("id").cast("tinyint").alias("t"), F.col("id").cast("decimal(20,3)").alias("d")
    )
    stats = by_column(profile.numeric_stats(df))
    assert stats["t"]["median"] == stats["d"]["median"] == 2.5


def test_approximate_median_is_near(spark):
    df = spark.range(100001).select(F.col("id").cast("double").alias("x"))
    stats = by_column(profile.numeric_stats(df, approx=True))["x"]
    assert abs(stats["median"] - 50000) < 100
    assert stats["mean"] == 50000.0


def test_a_groups_figures_do_not_depend_on_others(spark):
    rng = np.random.default_rng(8)
    own = pd.DataFrame({"g": "own", "x": rng.normal(3, 1e-3, 5000)})
    rest = pd.DataFrame({"g": rng.integers(0, 900, 20000).astype(str), "x": rng.normal(0, 9, 20000)})
    alone = spark.createDataFrame(own).coalesce(1)
    beside = alone.union(spark.createDataFrame(rest))
    figures = [
        profile.profile_by_group(df, ["g"]).where("g = 'own'").collect() for df in (alone, beside)
    ]
    assert figures[0] == figures[1]


def test_key_with_the_name_of_a_result(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0)], "n int, x double")
    stats = profile.profile_by_group(df, ["n"])
    assert len(set(stats.columns)) == len(stats.columns)
    assert stats.first()["key_n"] == 1 and stats.first()["median"] == 3.0


def test_group_profile_counts_missing_cells(spark):
    rows = [("a", None, 1.0), ("a", "x", NAN), (None, "y", 2.0), (None, None, None), (None, None, 4.0)]
    df = spark.createDataFrame(rows, "g string, s string, x double")
    totals, stats = profile.group_profile(df, "g", df.columns, ["x"])
    got = {r["g"]: r for r in totals.collect()}
    wanted = {r["g"]: r for r in profile.table_totals(df, ["g"], df.columns).collect()}
    assert {k: v.asDict() for k, v in got.items()} == {k: v.asDict() for k, v in wanted.items()}
    assert {r["g"]: (r["n"], r["median"]) for r in stats.collect()} == {"a": (1, 1.0), None: (2, 3.0)}
    totals, stats = profile.group_profile(df.select("g", "s"), "g", ["g", "s"], [])
    assert {r["g"]: r["missing1"] for r in totals.collect()} == {"a": 1, None: 2} and stats.count() == 0


def test_cell_class_names(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "c string")
    classes = df.select(cells.cell_class(F.col("c"))).collect()
    assert [r[0] for r in classes] == ["integer", "string", None]
