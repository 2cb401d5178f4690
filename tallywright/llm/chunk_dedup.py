"""Repeated passages by content-defined chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywright.llm import textops
from tallywright.session import ship

ship(__name__)

SHORTEST, LONGEST, MASK_BITS = 24, 256, 4
_REACH = 32
_GEAR = (textops.mix(np.arange(1000, 1256, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def _cuts(content: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all chunks in the buffer, and the number of chunks of each text.

    The gear hash of the last 32 bytes, h = (h << 1) + gear[byte], is summed by
    doubling. A chunk ends where its leading bits are zero, at the shortest length or
    later, and at the longest length at the latest.
    """
    padded, starts = textops.spread(content, bounds, _REACH, 0)
    h, done = _GEAR[padded], 1
    while done < _REACH:
        h[done:] += h[:-done] << np.uint32(done)
        done *= 2
    marks = np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1
    shift = starts - bounds[:-1]
    first = np.searchsorted(marks, starts + 1)
    behind = np.searchsorted(marks, starts + np.diff(bounds), side="right")
    marks = marks.tolist()
    ends: list[int] = []
    counts = []
    for a, b, move, begin, end in zip(
        first.tolist(), behind.tolist(), shift.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()
    ):
        before, last = len(ends), begin
        for mark in marks[a:b]:
            mark -= move
            if mark - last >= SHORTEST:
                while mark - last > LONGEST:
                    last += LONGEST
                    ends.append(last)
                if mark - last >= SHORTEST:
                    ends.append(mark)
                    last = mark
        while end - last > LONGEST:
            last += LONGEST
            ends.append(last)
        if end > last:
            ends.append(end)
        counts.append(len(ends) - before)
    return np.array(ends, np.int64), np.array(counts, np.int64)


def chunks(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per chunk: doc_id, start, size (bytes), its 128-bit digest, and again.

    `again` marks a chunk that its own document already has further in front. Empty
    and missing texts have no chunks.
    """
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))

    def run(batches):
        for batch in textops.slices(batches):
            content, bounds = textops.flat(batch.column("text"))
            ends, counts = _cuts(content, bounds)
            owner = np.repeat(np.arange(len(counts)), counts)
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            one = textops.Hasher(content, 0).of(starts, ends)
            two = textops.Hasher(content, 1).of(starts, ends)
            order = np.lexsort((starts, two, one, owner))
            again = np.zeros(len(ends), bool)
            a, b = order[:-1], order[1:]
            again[b] = (owner[a] == owner[b]) & (one[a] == one[b]) & (two[a] == two[b])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(owner)),
                    pa.array(starts - bounds[owner]),
                    pa.array((ends - starts).astype(np.int32)),
                    pa.array(one.view(np.int64)),
                    pa.array(two.view(np.int64)),
                    pa.array(again),
                ],
                ["doc_id", "start", "size", "one", "two", "again"],
            )

    return narrow.mapInArrow(
        run, "doc_id bigint, start bigint, size int, one bigint, two bigint, again boolean"
    )


def repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = 64) -> DataFrame:
    """Per document what earlier documents, or its own earlier text, already hold.

    A chunk repeats if an equal one lies in a document with a smaller key or further
    in front in the same one. Neighbouring repeated chunks form a span, removed where
    it has at least `least` bytes, so that a short phrase alone stays. Rows with the
    same key are one document and keep each other. A null key precedes all others.
    Empty and missing texts have zeros.

    Chunks are cut in the tasks that read the texts. The earliest key of each digest
    is a partial aggregate, so a chunk that a third of all documents share comes
    down to a row per task; it is then joined with the chunks on the digest, which
    adaptive execution can split.
    """
    key = F.coalesce(F.col(id_column), F.lit(-(1 << 63)))
    plain = docs.select(key.alias("doc_id"), F.col(text_column).alias("text"))
    cut = chunks(plain)
    earliest = (
        cut.groupBy("one", "two")
        .agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
        .where("first_id < last_id")
        .drop("last_id")
    )
    marked = (
        cut.join(earliest, ["one", "two"], "left")
        .where(F.col("again") | (F.col("doc_id") > F.col("first_id")))
        .select("doc_id", "start", (F.col("start") + F.col("size")).alias("end"))
        .distinct()
    )
    along = Window.partitionBy("doc_id").orderBy("start")
    spans = (
        marked.withColumn("new", (~F.col("start").eqNullSafe(F.lag("end").over(along))).cast("long"))
        .withColumn("run", F.sum("new").over(along))
        .groupBy("doc_id", "run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"))
        .where(F.col("end") - F.col("start") >= least)
        .groupBy("doc_id")
        .agg(
            F.sum("n").alias("n_repeated"),
            F.sum(F.col("end") - F.col("start")).alias("n_removed"),
            F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"),
        )
    )
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    whole = plain.select(
        "doc_id",
        F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")).alias("shown"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
    )
    return whole.join(spans, "doc_id", "left").select(
        F.col("shown").alias("doc_id"),
        "n_bytes",
        F.coalesce("n_repeated", F.lit(0)).alias("n_repeated"),
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("spans", none).alias("spans"),
    )
