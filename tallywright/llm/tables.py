"""Intermediate tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from tallywright.session import shared_folder

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def settled(frame: DataFrame, name: str, batch: str | None = None) -> DataFrame:
    """The rows, written once as Parquet and read again.

    What follows doesn't compute them anew, also after an executor is lost. The shuffle
    files behind them have served their purpose and go with the write. `batch` bounds
    the bytes of an Arrow batch meanwhile.
    """
    return settled_in_turns([frame], name, batch)


def settled_in_turns(frames: list[DataFrame], name: str, batch: str | None = None) -> DataFrame:
    """The rows of all frames as one settled table.

    One frame is written after the other, so only the shuffle files of one at a time
    are on disk.
    """
    spark = frames[0].sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    parts = [f"{path}/{i}" for i in range(len(frames))] if len(frames) > 1 else [path]
    wanted = {_CLEANUP: "true"} | ({_BATCH: batch} if batch else {})
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        for frame, part in zip(frames, parts):
            frame.write.parquet(part)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    table = spark.read.schema(frames[0].schema).parquet(*parts)
    table.settled_at = path
    return table


def dropped(*settled_tables: DataFrame) -> None:
    """Delete settled tables that no later job reads; what was read of them is settled too."""
    for table in settled_tables:
        context = table.sparkSession.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(table.settled_at)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def parallelism(frame: DataFrame) -> int:
    """As many partitions as the session gives to a shuffle."""
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
