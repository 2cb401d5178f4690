"""Profiling: shape, missing values, types, numeric statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions import cells
from tallywright.operators import ranks
from tallywright.session import written_once

QUARTILES = (0.25, 0.5, 0.75)


def _column_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row (position, column_name) per named column; sized by the schema."""
    names = F.array(*[F.lit(c) for c in columns]).cast("array<string>")
    return df.sparkSession.range(1).select(
        F.posexplode(names).alias("position", "column_name")
    )


def _numeric_cells(df: DataFrame, keys: Sequence[str], columns: Sequence[str]):
    """Long table (keys, position, value) of the numeric cells as doubles.

    Positions rather than names, since grouping by a number is cheaper.
    """
    clean = df.select(
        *[cells.name(k).alias(f"key{i}") for i, k in enumerate(keys)],
        *[cells.present(df, c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)],
    )
    if not columns:
        return clean.where("false").select(
            "*", F.lit(0).alias("position"), F.lit(0.0).alias("value")
        )
    entries = ", ".join(f"{i}, v{i}" for i in range(len(columns)))
    return clean.selectExpr(
        *[f"key{i}" for i in range(len(keys))],
        f"stack({len(columns)}, {entries}) AS (position, value)",
    )


def _missing_counts(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    return [
        F.count_if(cells.is_missing(df, c)).alias(f"missing{i}")
        for i, c in enumerate(columns)
    ]


def _sum(columns: Sequence[Column]) -> Column:
    # one expression for any number of columns: a chain of additions nests too deep
    zero = F.lit(0).cast("bigint")
    return F.aggregate(F.array(*columns), zero, lambda a, x: a + x) if columns else zero


def completeness_of(missing: Column, cells_total: Column) -> Column:
    """Share of present cells in percent; 100 for a table without cells."""
    share = F.lit(100.0) - missing / F.nullif(cells_total, F.lit(0)) * 100.0
    return F.coalesce(share, F.lit(100.0))


def table_totals(
    df: DataFrame, keys: Sequence[str] = (), columns: Sequence[str] | None = None
) -> DataFrame:
    """Rows, columns, missing cells per key, and ``missing0, missing1, ...``."""
    columns = df.columns if columns is None else list(columns)
    counts = df.groupBy(*[cells.name(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("total_rows"), *_missing_counts(df, columns)
    )
    each = [F.col(f"missing{i}") for i in range(len(columns))]
    return counts.withColumn(
        "total_columns", F.lit(len(columns)).cast("bigint")
    ).withColumn("missing_values", _sum(each))


def shape_metrics(df: DataFrame) -> DataFrame:
    """One row of total rows, columns and missing cells; none for an empty table."""
    return (
        table_totals(df)
        .select("total_rows", "total_columns", "missing_values")
        .filter("total_rows > 0")
    )


def completeness(df: DataFrame) -> DataFrame:
    """One row: the percentage of cells that hold a value."""
    total = F.col("total_rows") * F.col("total_columns")
    return table_totals(df).select(
        completeness_of(F.col("missing_values"), total).alias("completeness_pct")
    )


def missing_by_column(df: DataFrame, only_missing: bool = False) -> DataFrame:
    """Missing count and share per column, from one pass over the table."""
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(c).alias("column_name"),
                F.col(f"missing{i}").alias("missing_count"),
            )
            for i, c in enumerate(df.columns)
        ]
    )
    listed = (
        table_totals(df)
        .select("total_rows", F.explode(entries).alias("entry"))
        .select(
            "entry.*",
            F.coalesce(
                F.col("entry.missing_count")
                / F.nullif("total_rows", F.lit(0))
                * 100.0,
                F.lit(0.0),
            ).alias("missing_pct"),
        )
    )
    return listed.filter("missing_count > 0") if only_missing else listed


def infer_types(df: DataFrame) -> DataFrame:
    """Kind of every column: from the schema, or from the cells of text columns.

    All text columns are read in one pass that keeps, per column, which classes
    of cells occur; a table without text columns is not read at all.
    """
    text = cells.categorical_columns(df)
    kinds = [cells.declared_kind(f.dataType) for f in df.schema]
    table = F.arrays_zip(
        F.array(*[F.lit(c) for c in df.columns]).cast("array<string>").alias("name"),
        F.array(*[F.lit(k) for k in kinds]).cast("array<string>").alias("kind"),
    )
    names = df.sparkSession.range(1).select(F.posexplode(table).alias("position", "x"))
    names = names.select("position", F.col("x.name").alias("column_name"), F.col("x.kind").alias("declared"))
    declared = F.col("declared")
    if not text:
        return names.select("position", "column_name", declared.alias("inferred_type"))
    found = df.agg(
        *[
            F.bit_or(cells.cell_class_bit(cells.name(c))).alias(f"classes{i}")
            for i, c in enumerate(text)
        ]
    )
    read = found.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("text_column"),
                        cells.kind_of_classes(F.col(f"classes{i}")).alias("kind"),
                    )
                    for i, c in enumerate(text)
                ]
            )
        ).alias("entry")
    ).select("entry.*")
    # both sides have one row per column of the schema
    return names.join(
        F.broadcast(read), F.col("column_name") == F.col("text_column"), "left"
    ).select(
        "position", "column_name", F.coalesce("kind", declared).alias("inferred_type")
    )


def mixed_columns(df: DataFrame, strict: bool = True) -> DataFrame:
    """Columns of kind ``mixed``; ``strict=False`` adds ``mixed-integer``."""
    kinds = ["mixed"] if strict else ["mixed", "mixed-integer"]
    return infer_types(df).filter(F.col("inferred_type").isin(kinds))


def coerce_mixed(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    null_token: str | None = None,
) -> DataFrame:
    """Turn mixed columns into text.

    Without ``columns`` the mixed ones are looked up first, which reads the
    table once (the answer has at most one row per column). A missing cell
    stays missing unless ``null_token`` names the text to put there, such as
    ``"nan"``.
    """
    if columns is None:
        columns = [r["column_name"] for r in mixed_columns(df).collect()]
    chosen = set(columns)

    def as_text(column: str) -> Column:
        text = cells.name(column).cast("string")
        if null_token is not None:
            text = F.when(cells.is_missing(df, column), F.lit(null_token)).otherwise(
                text
            )
        return text.alias(column)

    return df.select(
        *[as_text(c) if c in chosen else cells.name(c) for c in df.columns]
    )


def select_roles(df: DataFrame, role: str) -> DataFrame:
    """Only the ``numeric`` or only the ``categorical`` columns."""
    if role == "numeric":
        columns = cells.numeric_columns(df)
    elif role == "categorical":
        columns = cells.categorical_columns(df)
    else:
        raise ValueError(f"unknown role: {role}")
    return df.select(*[cells.name(c) for c in columns])


def schema_description(
    df: DataFrame, order_by: Sequence[str], rows: int = 3
) -> DataFrame:
    """One row: row and column counts, names, types and the first records as JSON."""
    sample = (
        df.orderBy(*[cells.name(c) for c in order_by])
        .limit(rows)
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        *[cells.name(c).alias(f"o{i}") for i, c in enumerate(order_by)],
                        F.to_json(
                            F.struct(*[cells.name(c) for c in df.columns]),
                            {"ignoreNullFields": "false"},
                        ).alias("record"),
                    )
                )
            ).alias("records")
        )
        .select(F.col("records.record").alias("sample_data"))
    )
    counted = df.agg(F.count(F.lit(1)).alias("row_count"))
    types = [f.dataType.simpleString() for f in df.schema]
    # both have one row, each holding one half of the answer
    halves = counted.unionByName(sample, allowMissingColumns=True)
    return halves.agg(
        F.first("row_count", ignorenulls=True).alias("row_count"),
        F.first("sample_data", ignorenulls=True).alias("sample_data"),
    ).select(
        "row_count",
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.array(*[F.lit(c) for c in df.columns]).alias("column_names"),
        F.array(*[F.lit(t) for t in types]).alias("column_types"),
        "sample_data",
    )


def _zero_if_all_missing(column: str) -> Column:
    return F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.col(column)).alias(column)


def _statistics(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    approx: bool,
) -> DataFrame:
    long = _numeric_cells(df, (), columns)
    if approx:
        return ranks.approximate_quantiles(long, ["position"], probabilities)
    # the groups are the schema's columns, always few
    return ranks.quantiles(long, ["position"], probabilities, few_groups=True)


def profile_by_group(
    df: DataFrame,
    by: Sequence[str],
    columns: Sequence[str] | None = None,
    approx: bool = False,
) -> DataFrame:
    """Numeric statistics of every column within every group.

    Any number of groups of any size takes the same plan: one scan counts values by
    their leading bits, a second one counts exactly inside the bucket that holds the
    median, and only where such a bucket has over a million rows a third one splits
    it. So a group's figures don't depend on what else is in the table. A missing
    group is a group. The columns ``position``, ``column_name``, ``n``, ``mean``,
    ``median``, ``min``, ``max``, ``std`` are the result's; a key of such a name is
    called ``key_...``.
    """
    by = list(by)
    if columns is None:
        columns = [c for c in cells.numeric_columns(df) if c not in by]
    group = [*[f"key{i}" for i in range(len(by))], "position"]
    long = _numeric_cells(df, by, columns)
    if approx:
        stats = ranks.approximate_quantiles(long, group, (0.5,))
    else:
        stats = ranks.quantiles(long, group, (0.5,), few_groups=False)
    return _group_rows(stats, by, columns)


_RESULTS = ("position", "column_name", "n", "mean", "median", "min", "max", "std")


def _group_rows(stats: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    names = F.array(*[F.lit(c) for c in columns])
    return stats.select(
        *[F.col(f"key{i}").alias(f"key_{k}" if k in _RESULTS else k) for i, k in enumerate(by)],
        "position",
        F.get(names, F.col("position")).alias("column_name"),
        "n",
        _zero_if_all_missing("mean"),
        _zero_if_all_missing("q0").alias("median"),
        _zero_if_all_missing("min"),
        _zero_if_all_missing("max"),
        _zero_if_all_missing("std"),
    )


def group_profile(
    df: DataFrame, key: str, columns: Sequence[str], numeric: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Totals and numeric statistics per value of ``key``, both from one first scan.

    That scan counts, per group and column, rows, values and moments by leading bits
    (a column that isn't numeric only has present and missing cells); the counts are
    stored. Totals (as ``table_totals``) and the buckets of the medians are read from
    them, and only the medians take a second scan.
    """
    listed = [*numeric, *[c for c in columns if c not in numeric]]
    entries = [cells.present(df, c).cast("double") for c in numeric]
    entries += [F.when(~cells.is_missing(df, c), F.lit(0.0)) for c in listed[len(numeric) :]]
    clean = df.select(cells.name(key).alias("key0"), *[e.alias(f"v{i}") for i, e in enumerate(entries)])
    pairs = ", ".join(f"{i}, v{i}" for i in range(len(listed)))
    long = clean.selectExpr("key0", f"stack({len(listed)}, {pairs}) AS (position, value)")
    group = ["key0", "position"]
    counts = written_once(ranks.coarse_counts(long, group), "group-counts")
    each = [
        F.sum(F.when(F.col("position") == listed.index(c), F.col("rows") - F.col("cnt")).otherwise(0)).alias(f"missing{i}")
        for i, c in enumerate(columns)
    ]
    totals = (
        counts.groupBy(F.col("key0").alias(key))
        .agg(F.sum(F.when(F.col("position") == 0, F.col("rows"))).alias("total_rows"), *each)
        .withColumn("total_columns", F.lit(len(columns)).cast("bigint"))
        .withColumn("missing_values", _sum([F.col(f"missing{i}") for i in range(len(columns))]))
    )
    few = f"position < {len(numeric)}"
    stats = ranks.quantiles(
        _numeric_cells(df, [key], numeric), group, (0.5,), few_groups=False, buckets=counts.where(few)
    )
    return totals, _group_rows(stats, [key], numeric)


def numeric_stats(
    df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False
) -> DataFrame:
    """Mean, median, min, max and sample std of every numeric column.

    A column without any value gets five zeros, also in an empty table. The std
    of a single value is NULL. ``approx`` trades the exact median for one pass.
    """
    columns = cells.numeric_columns(df) if columns is None else list(columns)
    names = _column_table(df, columns)
    if not columns:
        return _with_defaults(names.limit(0), None)
    stats = _statistics(df, columns, (0.5,), approx)
    return _with_defaults(names, stats.withColumnRenamed("q0", "median"))


def _with_defaults(names: DataFrame, stats: DataFrame | None) -> DataFrame:
    measures = ["mean", "median", "min", "max", "std"]
    if stats is None:
        joined = names.select(
            "*",
            F.lit(0).cast("bigint").alias("n"),
            *[F.lit(0.0).alias(m) for m in measures],
        )
    else:
        joined = names.join(F.broadcast(stats), "position", "left").withColumn(
            "n", F.coalesce("n", F.lit(0).cast("bigint"))
        )
    return joined.select(
        "position",
        "column_name",
        "n",
        *[_zero_if_all_missing(m) for m in measures],
    )


def summary_statistics(
    df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False
) -> DataFrame:
    """count, mean, std, min, quartiles and max of every numeric column.

    Unlike ``numeric_stats`` a column without values keeps NULLs.
    """
    columns = cells.numeric_columns(df) if columns is None else list(columns)
    names = _column_table(df, columns)
    stats = _statistics(df, columns, QUARTILES, approx)
    return names.join(F.broadcast(stats), "position", "left").select(
        "position",
        "column_name",
        F.coalesce("n", F.lit(0).cast("bigint")).alias("count"),
        "mean",
        "std",
        "min",
        F.col("q0").alias("p25"),
        F.col("q1").alias("p50"),
        F.col("q2").alias("p75"),
        "max",
    )
