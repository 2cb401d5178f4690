"""Compare every query with its SQL: python -m checks.compare FOLDER [NAME...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from checks import oracles, queries


_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "timestamp_ntz": "TIMESTAMP",
}


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    """An in-process database with a view per table."""
    connection = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(
            f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')"
        )
    return connection


def rows(frame: pd.DataFrame) -> list[str]:
    """Rows as sorted texts, columns in name order."""

    def shown(value: object) -> str:
        if value is None or value is pd.NaT or value != value:
            return "NULL"
        if isinstance(value, float):
            return repr(float(value) + 0.0)
        if hasattr(value, "item"):
            value = value.item()
        if isinstance(value, int) and not isinstance(value, bool):
            return repr(float(value))
        return str(value)

    ordered = frame[sorted(frame.columns)]
    return sorted(
        "\x1f".join(map(shown, row)) for row in ordered.itertuples(index=False)
    )


def difference(spark: SparkSession, connection, name: str, sf_dir: str) -> str | None:
    """None where both agree, else what differs first."""
    result = queries.ALL[name](spark, sf_dir)
    ours = result.toPandas()
    if name not in oracles.ALL:
        return None if len(ours) else "no rows"
    described = connection.execute(f"DESCRIBE {oracles.ALL[name]}").fetchall()
    expected = {row[0]: row[1] for row in described}
    got = {c: _TYPES.get(t, t) for c, t in result.dtypes}
    if got != expected:
        return f"types {got} != {expected}"
    theirs = connection.execute(oracles.ALL[name]).df()
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    for a, b in zip(rows(ours), rows(theirs)):
        if a != b:
            return f"\n  spark  {a!r}\n  duckdb {b!r}"
    return None


def main() -> int:
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(queries.ALL)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, failed = database(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            found = difference(spark, connection, name, sf_dir)
        except Exception as error:  # noqa: BLE001 - report and go on
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += found is not None
        print(f"{name:24s} {time.time() - start:6.2f}s {found or 'ok'}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return failed


if __name__ == "__main__":
    sys.exit(main())
