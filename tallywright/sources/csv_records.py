"""Records of CSV files whose cells hold line breaks, read by many tasks per file.

A line break ends a record if the quotes before it, from the beginning of the file, are even
in number. A first scan counts the quotes of every split of a file; their sums tell which
splits begin inside a cell. So each task cuts its own split into records. Only a record that
crosses a split's edge is put together from the pieces of several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywright.session import ship, written_once

ship(__name__)

_SPLIT = ["file", "start", "length"]
_PIECES = "file string, start bigint, tail boolean, first boolean, text string"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, first, text): the records as they stand, `first` for each file's first.

    Records end at a line feed, with or without a carriage return before it; blank ones
    are left out. Quotes must be doubled inside cells and stand nowhere in cells without
    quotes around them. A cell may be longer than a split, up to Spark's 2 GB.
    """
    lines = (
        spark.read.option("lineSep", "\n").text(path)
        .select("value", *[F.col(f"_metadata.{m}").alias(a) for m, a in (
            ("file_path", "file"), ("file_block_start", "start"), ("file_block_length", "length"))])
    )
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counted = lines.groupBy(*_SPLIT).agg(F.sum(quotes).alias("quotes"))
    along = Window.partitionBy("file").orderBy("start")
    parity = F.pmod(F.sum("quotes").over(along), F.lit(2)) == 1
    edges = counted.select(*_SPLIT, parity.alias("left_open"))
    opened = F.lag("left_open", 1, False).over(along)
    edges = written_once(edges.withColumn("opened", opened), "csv-splits")
    # one row per split: the driver keeps as many in the list of the scan's tasks
    placed = lines.join(F.broadcast(edges), _SPLIT, "left")

    whole = placed.mapInArrow(lambda b: _cut(b, False), _PIECES)
    crossing = placed.where("opened IS NULL OR opened OR left_open")
    pieces = crossing.mapInArrow(lambda b: _cut(b, True), _PIECES)
    begun = Window.partitionBy("file").orderBy("start", "tail").rowsBetween(Window.unboundedPreceding, 0)
    record = F.max(F.when(F.col("tail"), F.col("start"))).over(begun)
    parts = F.array_sort(F.collect_list(F.struct("start", "tail", "text")))
    joined = (
        pieces.withColumn("record", record).groupBy("file", "record")
        .agg(F.max("first").alias("first"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))
    )
    columns = ["file", "first", F.regexp_replace("text", r"\r\z", "").alias("text")]
    return whole.select(*columns).unionByName(joined.select(*columns)).where("text <> ''")


def _cut(batches: Iterator[pa.RecordBatch], crossing: bool) -> Iterator[pa.RecordBatch]:
    """Records inside a split, or the pieces of those that cross its edges.

    The lines of a split come in order and follow one another.
    """
    split, lines, inside, head, seen = None, [], False, False, False

    def out(texts: list | pa.Array, tail: bool, first: int | None) -> pa.RecordBatch:
        firsts = np.zeros(len(texts), bool)
        if first is not None:
            firsts[first] = True
        n = len(texts)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([split[0]] * n, pa.string()), pa.array([split[1]] * n, pa.int64()),
                pa.array([tail] * n, pa.bool_()), pa.array(firsts), pa.array(texts, pa.string()),
            ],
            ["file", "start", "tail", "first", "text"],
        )

    def rest() -> Iterator[pa.RecordBatch]:
        """What the split's end leaves open, as one piece."""
        if lines and crossing:
            is_first = not head and not seen and split[1] == 0
            yield out(["\n".join(lines)], not head, 0 if is_first else None)

    for batch in batches:
        start, length = (batch.column(c).to_numpy() for c in ("start", "length"))
        files = batch.column("file")
        new = np.flatnonzero((np.diff(start) != 0) | (np.diff(length) != 0)) + 1
        changed = pc.not_equal(files[1:], files[:-1]).to_numpy(zero_copy_only=False)
        cuts = np.unique(np.concatenate([[0], new, np.flatnonzero(changed) + 1, [batch.num_rows]]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            here = (files[int(a)].as_py(), int(start[a]), int(length[a]))
            if here != split:
                yield from rest()
                opened = batch.column("opened")[int(a)].as_py()
                if opened is None:
                    raise RuntimeError(f"{here[0]} was split anew between two scans: read it again")
                split, lines, inside, head, seen = here, [], opened, opened, False
            texts = batch.column("value")[int(a) : int(b)]
            quotes = pc.count_substring(texts, '"').to_numpy()
            open_after = (np.cumsum(quotes) + inside) % 2 == 1
            inside = bool(open_after[-1])
            if not lines and not head and not open_after.any():
                records = texts
            else:
                records = []
                for text, still in zip(texts.to_pylist(), open_after):
                    lines.append(text)
                    if still:
                        continue
                    record, lines = "\n".join(lines), []
                    if not head:
                        records.append(record)
                    elif crossing:
                        yield out([record], False, None)
                    head = False
            first = None
            if not seen and split[1] == 0:
                first = next((i for i, r in enumerate(records) if str(r).strip("\r")), None)
                seen = first is not None
            if len(records) and not crossing:
                yield out(records, False, first)
    if split is not None:
        yield from rest()
