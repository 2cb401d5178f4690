"""Moments and exact quantiles of many columns and groups at once.

Spark's own exact percentile keeps every distinct value of a group in one
task. Here the value at a rank is found by counting instead, in passes that
hold at most a few million counters per group, however many rows it has:

1. count values by their leading 9 significant bits and pick the buckets the
   wanted ranks fall into (the same pass yields the moments);
2. within those buckets, count by value where a bucket holds few rows, else by
   the leading 30 bits, and pick again;
3. within what was counted by 30 bits, count by value. Where nothing was, which
   shows at run time, this pass does not read the table.

Rounding to fewer bits keeps the order of values, so counting buckets from the
smallest gives exact ranks. Rows are combined before each shuffle and spread
by bucket, so a group holding most of the rows costs no more than the others.
Only the picked buckets travel from one pass to the next. Where the number of
groups has no bound they are stored in between: the next pass joins the table with
a side of known size, broadcast where it is small, else by group *and* bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.session import written_once

SIGNIFICAND_BITS = 53
COARSE_BITS = 9
FINE_BITS = 30
FEW_ROWS = 1_000_000
_MOMENTS = ("n", "mean", "m2", "min", "max")


def leading_bits(value: str, bits: int) -> str:
    """SQL: a double rounded to its leading significant bits, NaN if missing.

    Subtracting a large multiple of the value and adding it back drops the
    trailing bits; huge values are scaled so that the multiple stays finite.
    """
    factor = f"{2 ** (SIGNIFICAND_BITS - bits) + 1}D"
    down, up = repr(2.0**-100) + "D", repr(2.0**100) + "D"
    scaled = f"({value} * {down})"
    return (
        f"CASE WHEN abs({value}) < {2.0**900!r}D"
        f" THEN {value} * {factor} - ({value} * {factor} - {value})"
        f" WHEN abs({value}) < double('Infinity')"
        f" THEN ({scaled} * {factor} - ({scaled} * {factor} - {scaled})) * {up}"
        f" ELSE coalesce({value}, double('NaN')) END"
    )


def _ranks(probabilities: Sequence[float]) -> list[tuple[str, str]]:
    """SQL: the zero-based ranks on both sides of each probability."""
    return [
        (f"floor({float(p)}D * (n - 1))", f"ceil({float(p)}D * (n - 1))")
        for p in probabilities
    ]


def _holds(rank: str) -> str:
    return f"({rank} >= below AND {rank} < below + cnt)"


def _picked(probabilities: Sequence[float]) -> str:
    """SQL: the bucket holds a wanted rank, or its key has no values at all."""
    ranks = {rank for pair in _ranks(probabilities) for rank in pair}
    return " OR ".join(["n = 0", *map(_holds, sorted(ranks))])


def _before(keys: Sequence[str], label: str) -> str:
    """SQL: how many values lie in the key's smaller buckets."""
    return (
        f"sum(cnt) OVER (PARTITION BY {', '.join(keys)} ORDER BY {label}"
        " ROWS UNBOUNDED PRECEDING) - cnt"
    )


def coarse_counts(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first pass: rows, values and moments per key and leading 9 bits."""
    coarse = leading_bits("value", COARSE_BITS) + " AS coarse"
    return long.selectExpr(*keys, "value", coarse).groupBy(*keys, "coarse").agg(
        F.expr("count(1) AS rows"),
        F.expr("count(value) AS cnt"),
        F.expr("avg(value) AS b_mean"),
        F.expr("var_pop(value) AS b_var"),
        F.expr("min(value) AS b_min"),
        F.expr("max(value) AS b_max"),
    )


def quantiles(
    long: DataFrame,
    keys: Sequence[str],
    probabilities: Sequence[float],
    few_groups: bool,
    few_rows: int = FEW_ROWS,
    buckets: DataFrame | None = None,
) -> DataFrame:
    """Per key: n, mean, std, min, max and ``q0, q1, ...`` for the probabilities.

    ``long`` has the keys and a double column ``value``, NULL where missing. A
    key whose values are all missing stays, with n = 0 and NULL statistics.
    Quantiles interpolate linearly. ``few_groups`` says the schema bounds the
    number of keys, so the picked buckets (two per key and probability at most)
    are broadcast; otherwise they are stored, and joined by key and bucket unless
    the stored size allows a broadcast. Buckets of up to ``few_rows`` rows are
    counted by value at once. ``buckets`` are the table's ``coarse_counts``, if
    the caller has them already.
    """
    keys = list(keys)
    group = ", ".join(keys)
    coarse = leading_bits("value", COARSE_BITS) + " AS coarse"
    over_key = f"OVER (PARTITION BY {group})"

    rows = long.selectExpr(*keys, "value", coarse)
    if buckets is None:
        buckets = coarse_counts(long, keys)
    picked = (
        buckets.selectExpr(
            "*",
            f"sum(cnt) {over_key} AS n",
            f"sum(b_mean * cnt) {over_key} / nullif(sum(cnt) {over_key}, 0) AS mean",
            f"min(b_min) {over_key} AS min",
            f"max(b_max) {over_key} AS max",
            f"{_before(keys, 'coarse')} AS below",
        )
        .selectExpr(
            "*",
            "sum(cnt * (b_var + (b_mean - mean) * (b_mean - mean)))"
            f" {over_key} AS m2",
        )
        .filter(_picked(probabilities))
        .selectExpr(*keys, "coarse", "below", "cnt AS held", *_MOMENTS)
    )
    if not few_groups:
        picked = written_once(picked, "picked-buckets")
    exact = "coalesce(value, double('NaN'))"
    fine = leading_bits("value", FINE_BITS)
    picked = _recount(
        rows,
        picked,
        [*keys, "coarse"],
        f"CASE WHEN held <= {few_rows} THEN {exact} ELSE {fine} END AS fine",
        probabilities,
        few_groups,
    )
    result = [*keys, "below", "cnt", *_MOMENTS]
    found = picked.filter(f"held <= {few_rows}").selectExpr(*result, "fine AS found")
    rest = _recount(
        rows.selectExpr("*", f"{fine} AS fine"),
        picked.filter(f"held > {few_rows}").drop("cnt", "held"),
        [*keys, "coarse", "fine"],
        f"{exact} AS found",
        probabilities,
        few_groups,
    ).selectExpr(*result, "found")
    return _interpolate(found.unionByName(rest), keys, probabilities)


def _recount(
    rows: DataFrame,
    picked: DataFrame,
    on: list[str],
    label: str,
    probabilities: Sequence[float],
    few_groups: bool,
) -> DataFrame:
    """Count the rows of the picked buckets by a finer label and pick again."""
    carried = [c for c in picked.columns if c not in on]
    right = picked.selectExpr(*[f"{c} AS p_{c}" for c in on], *carried)
    if few_groups:
        right = F.broadcast(right)
    # bucket labels are never NULL; the caller's keys may be
    match = " AND ".join(
        f"{c} = p_{c}" if c in ("coarse", "fine") else f"{c} <=> p_{c}" for c in on
    )
    labelled = rows.join(right, F.expr(match)).selectExpr(*on, *carried, label, "value")
    name = labelled.columns[-2]
    counted = labelled.groupBy(*on, *carried, name).agg(
        F.expr("count(value) AS cnt")
    )
    place = [c for c in counted.columns if c != "below"]
    return counted.selectExpr(
        *place, f"below + {_before(on, name)} AS below"
    ).filter(_picked(probabilities))


def _interpolate(
    found: DataFrame, keys: list[str], probabilities: Sequence[float]
) -> DataFrame:
    ends, results = [], []
    for i, (low, high) in enumerate(_ranks(probabilities)):
        for side, rank in (("lo", low), ("hi", high)):
            ends.append(f"max(CASE WHEN {_holds(rank)} THEN found END) AS {side}{i}")
        p = float(probabilities[i])
        between = (
            f"(lo{i} + hi{i}) / 2"
            if p == 0.5
            else f"lo{i} + (hi{i} - lo{i}) * ({p}D * (n - 1) - floor({p}D * (n - 1)))"
        )
        results.append(f"CASE WHEN lo{i} = hi{i} THEN lo{i} ELSE {between} END AS q{i}")
    # n and the moments are the same on all of a key's rows
    grouped = found.groupBy(*keys).agg(
        *[F.expr(f"max({m}) AS {m}") for m in _MOMENTS], *map(F.expr, ends)
    )
    std = "CASE WHEN n > 1 THEN sqrt(m2 / (n - 1)) END AS std"
    return grouped.selectExpr(*keys, "n", "mean", std, "min", "max", *results)


def _one_pass(
    long: DataFrame, keys: Sequence[str], several: str, count: int
) -> DataFrame:
    """The same columns from one aggregation; ``several`` gives the quantiles."""
    grouped = long.groupBy(*keys).agg(
        F.expr("count(value) AS n"),
        F.expr("avg(value) AS mean"),
        F.expr("stddev_samp(value) AS std"),
        F.expr("min(value) AS min"),
        F.expr("max(value) AS max"),
        F.expr(f"{several} AS several"),
    )
    picks = [f"get(several, {i}) AS q{i}" for i in range(count)]
    return grouped.selectExpr(*keys, "n", "mean", "std", "min", "max", *picks)


def _listed(probabilities: Sequence[float]) -> str:
    return ", ".join(f"{float(p)}D" for p in probabilities)


def approximate_quantiles(
    long: DataFrame, keys: Sequence[str], probabilities: Sequence[float]
) -> DataFrame:
    """Quantiles from a bounded sketch, for groups of any size, in one pass."""
    several = f"percentile_approx(value, array({_listed(probabilities)}), 10000)"
    return _one_pass(long, keys, several, len(probabilities))
