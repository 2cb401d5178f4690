"""The documented question shapes: first rows, filter, average, counts, top N."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.functions import cells

_SKETCH_ITEMS = 1_000_000  # fixed value: as many items as a sketch may track


def _required(order_by: Sequence[str]) -> list[Column]:
    if not order_by:
        raise ValueError("rows have no order of their own: order_by is required")
    return [cells.name(c) for c in order_by]


def head_n(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """The first ``n`` rows by a unique order."""
    return df.orderBy(*_required(order_by)).limit(n)


def top_n(df: DataFrame, n: int, column: str, tie_break: Sequence[str]) -> DataFrame:
    """The ``n`` rows with the highest values; missing values come last."""
    value = cells.present(df, column)
    return df.orderBy(F.desc_nulls_last(value), *_required(tie_break)).limit(n)


def filter_gt(df: DataFrame, column: str, threshold: float) -> DataFrame:
    """Rows whose value exceeds the threshold; a missing value never does.

    NaN compares above every number in Spark, hence the second condition. The
    plain comparison still reaches the Parquet reader.
    """
    kept = df.filter(cells.name(column) > F.lit(threshold))
    return kept.filter(~cells.is_missing(df, column))


def column_average(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.avg(cells.present(df, column)).alias("average"))


def count_unique(df: DataFrame, column: str, approx: bool = False) -> DataFrame:
    """Number of distinct non-missing values."""
    value = cells.present(df, column)
    count = F.approx_count_distinct(value) if approx else F.countDistinct(value)
    return df.agg(count.alias("unique_count"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per distinct non-missing value, largest first."""
    return (
        df.filter(~cells.is_missing(df, column))
        .groupBy(cells.name(column))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), cells.name(column))
    )


def frequent_values(df: DataFrame, column: str, share: float) -> DataFrame:
    """Exact counts of all values that make up more than ``share`` of the present ones.

    Where a column has too many values to count them all. The first scan keeps a
    frequent-items sketch of 8 / share values per task; sketches merge, and none with
    more than the share of the rows can be missing from the merged one, whose error is
    below 3 / 8 of the share. The second scan counts its candidates, at most 2 / share,
    so that is all that is broadcast and shuffled. Largest first.
    """
    if not 8 / _SKETCH_ITEMS <= share < 1:
        raise ValueError(f"share must lie between {8 / _SKETCH_ITEMS} and 1")
    values = df.filter(~cells.is_missing(df, column)).select(cells.name(column).alias("_v"))
    if isinstance(values.schema["_v"].dataType, (T.FloatType, T.DoubleType)):
        # minus zero is the same value
        values = values.select((F.col("_v") + F.lit(0).cast(values.schema["_v"].dataType)).alias("_v"))
    sketch = F.expr(f"approx_top_k(_v, {ceil(2 / share)}, {ceil(8 / share)})")
    candidates = values.agg(sketch.alias("top"), F.count("_v").alias("_n"))
    listed = candidates.select("_n", F.explode("top.item").alias("_v"))
    return (
        values.join(F.broadcast(listed), "_v")
        .groupBy("_v", "_n")
        .agg(F.count(F.lit(1)).alias("count"))
        .filter(F.col("count") > F.lit(share) * F.col("_n"))
        .select(F.col("_v").alias(column), "count")
        .orderBy(F.desc("count"), F.col(f"`{column.replace('`', '``')}`"))
    )


def latest_by_key(
    df: DataFrame, key: Sequence[str], order_by: Sequence[str]
) -> DataFrame:
    """One row per key, the last written one, as an upsert leaves it.

    The first scan reads key and order only and finds each key's last order value; the
    second joins the table with these and so meets the other columns of the winning
    rows alone. The join is on key *and* order: a key with most of the rows is spread
    by its order values, and where the winners are few the planner broadcasts them, so
    no row of the table is sorted or sent. A missing order value sorts first. Of rows
    equal in key and order one stays.
    """
    keys = {f"_key{i}": cells.name(k) for i, k in enumerate(key)}
    orders = {f"_order{i}": cells.name(c) for i, c in enumerate(order_by)}
    sought = [c.alias(n) for n, c in (keys | orders).items()]
    narrow = df.select(*sought)
    if len(orders) == 1:
        last = narrow.groupBy(*keys).agg(F.max("_order0").alias("_order0"))
    else:
        top = F.max(F.struct(*orders)).alias("_top")
        last = narrow.groupBy(*keys).agg(top).select(*keys, "_top.*")
    rows = df.select(F.struct(*[cells.name(c) for c in df.columns]).alias("_row"), *sought)
    rows, last = rows.alias("rows"), last.alias("last")
    same = [F.col(f"rows.{n}").eqNullSafe(F.col(f"last.{n}")) for n in keys | orders]
    winners = rows.join(last, reduce(and_, same), "left_semi")
    return winners.groupBy(*keys).agg(F.first("_row").alias("_row")).select("_row.*")


def last_accessed(df: DataFrame, column: str, tie_break: Sequence[str]) -> DataFrame:
    """The single most recent record; a missing time counts as the oldest."""
    return top_n(df, 1, column, tie_break)
