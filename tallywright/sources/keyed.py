"""A stored table with one row per key, changed by upserts.

A folder holds `data`, with a part per upsert, and `versions`, with a small file per
version that lists the parts it is made of. Every part is cut into the same buckets by
the key, so an upsert shuffles its own records only, and a reader finds the latest row of
every key bucket by bucket, without any shuffle. A version comes into being with the
renaming of its file: a reader sees all of an upsert or nothing, and a part that no version
lists, as an interrupted upsert leaves it, is never read.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from hashlib import sha256
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.functions import cells
from tallywright.operators import shapes

MAX_PARTS = 16
_VERSION = (
    "version bigint, batch string, parts array<struct<upsert: bigint, folder: string>>, "
    "key array<string>, order_by array<string>, buckets int, columns string"
)


def create(
    spark: SparkSession,
    path: str,
    columns: str,
    key: Sequence[str],
    order_by: Sequence[str],
    buckets: int | None = None,
) -> None:
    """An empty table: version 0 in a folder without one.

    `columns` is a schema as in DDL. A row is told by its `key` columns, whose values
    may be missing; of two rows of a key the one with the higher `order_by` counts (a
    missing value is the lowest), and of equal ones the one stored first. Without a number
    of buckets there are as many as the session gives partitions to a shuffle.
    """
    if not key or not order_by:
        raise ValueError("a keyed table needs a key and an order")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = {
        "version": 0, "batch": None, "parts": [], "key": list(key),
        "order_by": list(order_by), "buckets": buckets, "columns": columns,
    }
    if not _commit(spark, path, first):
        raise ValueError(f"{path} holds a keyed table already")


def upsert(
    spark: SparkSession, path: str, records: DataFrame, batch: str, max_parts: int = MAX_PARTS
) -> int:
    """Store the records as the batch of that name; the version that has it.

    A batch that some version has already is not stored again, so a job may repeat it
    after a failure. Columns are taken by name. Where another upsert came first, only the
    version file is written anew. Beyond `max_parts` parts the table is compacted.
    """
    done = _having(spark, path, batch)
    if done is not None:
        return done
    state = _state(spark, path)
    folder = f"{path}/data/{uuid4().hex}"
    _write_part(spark, _reduced(spark, records, state), folder, state["buckets"])
    while True:
        state = _state(spark, path)
        following = state["version"] + 1
        parts = [*state["parts"], {"upsert": following, "folder": folder}]
        if _commit(spark, path, state | {"version": following, "batch": batch, "parts": parts}):
            break
        done = _having(spark, path, batch)
        if done is not None:
            return done
    if len(parts) > max_parts:
        compact(spark, path)
    return following


def compact(spark: SparkSession, path: str) -> int:
    """Join the parts into one, as a new version; the current version.

    Parts are read and written in their buckets, without a shuffle. Where an upsert came
    first, its part is listed beside the joined one.
    """
    seen = _state(spark, path)
    if len(seen["parts"]) < 2:
        return seen["version"]
    folder = f"{path}/data/{uuid4().hex}"
    _write_part(spark, _latest(spark, path, seen), folder, seen["buckets"], placed=True)
    joined = {"upsert": seen["parts"][-1]["upsert"], "folder": folder}
    while True:
        state = _state(spark, path)
        if state["parts"][: len(seen["parts"])] != seen["parts"]:
            return state["version"]
        parts = [joined, *state["parts"][len(seen["parts"]) :]]
        new = state | {"version": state["version"] + 1, "batch": None, "parts": parts}
        if _commit(spark, path, new):
            return new["version"]


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, by default the current one."""
    state = _state(spark, path, version)
    return _latest(spark, path, state).select("row.*")


def _reduced(spark: SparkSession, records: DataFrame, state: dict) -> DataFrame:
    """The last record of every key: its key as text, and the row."""
    wanted = spark.createDataFrame([], state["columns"]).schema
    rows = records.select(*[cells.name(f.name).cast(f.dataType).alias(f.name) for f in wanted])
    last = shapes.latest_by_key(rows, state["key"], state["order_by"])
    key = F.to_json(F.struct(*[cells.name(k) for k in state["key"]]))
    row = F.struct(*[cells.name(f.name) for f in wanted])
    return last.select(key.alias("_key"), row.alias("row"))


def _write_part(
    spark: SparkSession, rows: DataFrame, folder: str, buckets: int, placed: bool = False
) -> None:
    name = f"keyed_part_{uuid4().hex}"
    rows = rows if placed else rows.repartition(buckets, "_key")
    writer = rows.write.bucketBy(buckets, "_key").sortBy("_key").option("path", folder)
    try:
        writer.saveAsTable(name)
    finally:
        # the files stay: the name only served to write buckets
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _latest(spark: SparkSession, path: str, state: dict) -> DataFrame:
    """The latest row of every key, from the session's name for this version's parts."""
    told = json.dumps([path, state["parts"]])
    name = f"keyed_{sha256(told.encode()).hexdigest()[:32]}"
    if not spark.catalog.tableExists(name):
        spark.sql(
            f"CREATE TABLE {name} (_key string, row struct<{_nested(spark, state['columns'])}>,"
            f" _upsert bigint) USING parquet PARTITIONED BY (_upsert)"
            f" CLUSTERED BY (_key) INTO {state['buckets']} BUCKETS"
            f" LOCATION '{_quoted(path)}/data'"
        )
        for part in state["parts"]:
            spark.sql(
                f"ALTER TABLE {name} ADD PARTITION (_upsert = {part['upsert']})"
                f" LOCATION '{_quoted(part['folder'])}'"
            )
    order = [F.col("row").getField(c) for c in state["order_by"]]
    newest = F.max_by("row", F.struct(*order, -F.col("_upsert")))
    return spark.table(name).groupBy("_key").agg(newest.alias("row"))


def _nested(spark: SparkSession, columns: str) -> str:
    schema = spark.createDataFrame([], columns).schema
    return ", ".join(f"`{f.name.replace('`', '``')}`: {f.dataType.simpleString()}" for f in schema)


def _quoted(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


# --- versions ---------------------------------------------------------------------


def _versions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_VERSION).json(f"{path}/versions")


def _state(spark: SparkSession, path: str, version: int | None = None) -> dict:
    found = _versions(spark, path)
    if version is not None:
        found = found.where(F.col("version") == version)
    row = found.orderBy(F.desc("version")).first()
    if row is None:
        raise ValueError(f"{path} has no version {version}")
    return row.asDict(recursive=True)


def _having(spark: SparkSession, path: str, batch: str) -> int | None:
    row = _versions(spark, path).where(F.col("batch") == batch).first()
    return None if row is None else row["version"]


def _commit(spark: SparkSession, path: str, state: dict) -> bool:
    """Write a version's file under a hidden name, then rename it; False if it exists.

    The renaming replaces no file: of two upserts at once the later one is refused.
    """
    jvm, context = spark._jvm, spark.sparkContext
    hadoop = jvm.org.apache.hadoop.fs
    final = hadoop.Path(f"{path}/versions/{state['version']:012d}.json")
    hidden = hadoop.Path(f"{path}/versions/.{uuid4().hex}")
    system = final.getFileSystem(context._jsc.hadoopConfiguration())
    out = system.create(hidden, False)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    files = hadoop.FileContext.getFileContext(final.toUri(), context._jsc.hadoopConfiguration())
    kinds = context._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    try:
        files.rename(system.makeQualified(hidden), system.makeQualified(final), kinds)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" not in error.java_exception.getClass().getName():
            raise
        system.delete(hidden, False)
        return False
    return True
