"""Digests of a document's most improbable byte windows, and their likeness."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallywright.llm import textops
from tallywright.session import ship

ship(__name__)

WINDOW = 64  # bytes of a feature, and neighbouring features that compete
POPULAR = 16  # competitions that a selected feature has won
LEVELS = 256
FILTER_BITS = 2048
FILTER_FEATURES = 160
HASHES = 5
BROADCAST_PARTS = 200_000
_GAP = 2 * WINDOW
_NEVER = np.int64(1) << 62

_share = np.arange(1, WINDOW + 1)
_WEIGHT = np.concatenate([[0], np.rint(_share * np.log2(_share) * 65536)]).astype(np.int64)
_STEP = np.diff(_WEIGHT)


def _levels(padded: np.ndarray) -> np.ndarray:
    """Entropy level of the window that ends at each byte, in exact integers.

    A window moves on by one byte: the sum of count * log(count) loses the step of
    the leaving byte and gains that of the entering one.
    """
    before, behind = np.zeros((2, len(padded)), np.uint8)
    for lag in range(1, WINDOW):
        same = (padded[lag:] == padded[:-lag]).view(np.uint8)
        before[lag:] += same
        behind[:-lag] += same
    total = np.full(len(padded), _WEIGHT[WINDOW])  # the first window is all fill
    change = _STEP[before[WINDOW:]] - _STEP[behind[:-WINDOW]]
    total[WINDOW:] += np.cumsum(change)
    return (LEVELS - 1) - (total * (LEVELS - 1)) // _WEIGHT[WINDOW]


def _windows(column: pa.Array):
    """The texts with gaps, their bounds, and where whole windows end."""
    content, bounds = textops.flat(column)
    padded, starts = textops.spread(content, bounds, _GAP, 0)
    sizes = np.diff(bounds)
    change = np.zeros(len(padded) + 1, np.int8)
    full = sizes >= WINDOW
    change[starts[full] + WINDOW - 1] = 1
    change[starts[full] + sizes[full]] = -1
    return padded, starts, sizes, np.cumsum(change[:-1], dtype=np.int8).astype(bool)


def rarity(docs: DataFrame, text_column: str = "text") -> list[int]:
    """Rank of each entropy level by how rare it is among all windows of all texts.

    Every text is read whole; `LEVELS` counts come to the driver. Of levels equally
    frequent the higher is the rarer.
    """

    def count(batches):
        seen = np.zeros(LEVELS, np.int64)
        for batch in textops.slices(batches):
            padded, _, _, whole = _windows(batch.column("text"))
            seen += np.bincount(_levels(padded)[whole], minlength=LEVELS)
        level = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(level), pa.array(seen[level])], ["level", "n"])

    counts = np.zeros(LEVELS, np.int64)
    found = docs.select(F.col(text_column).alias("text")).mapInArrow(count, "level bigint, n bigint")
    for row in found.groupBy("level").agg(F.sum("n").alias("n")).collect():
        counts[row["level"]] = row["n"]
    rank = np.empty(LEVELS, np.int64)
    rank[np.lexsort((-np.arange(LEVELS), counts))] = np.arange(LEVELS)
    return rank.tolist()


def _digests(column: pa.Array, rank: np.ndarray) -> list[str]:
    padded, starts, sizes, whole = _windows(column)
    levels = _levels(padded)
    usable = whole & (levels > LEVELS // 16)
    key = np.where(usable, (rank[levels] << 32) | np.arange(len(padded)), _NEVER)
    best = textops.sliding_min(key, WINDOW)
    best = best[best < _NEVER] & 0xFFFFFFFF
    first = np.flatnonzero(np.diff(best, prepend=-1))
    won = np.diff(first, append=len(best))
    ends = best[first][won >= POPULAR] + 1
    begins = ends - WINDOW
    owner = np.searchsorted(starts, begins, side="right") - 1
    lone = np.setdiff1d(np.flatnonzero(sizes > 0), owner)
    if len(lone):  # texts without a feature count whole
        owner = np.concatenate([owner, lone])
        begins = np.concatenate([begins, starts[lone]])
        ends = np.concatenate([ends, starts[lone] + sizes[lone]])
        order = np.argsort(owner, kind="stable")
        owner, begins, ends = owner[order], begins[order], ends[order]
    hashes = textops.Hasher(padded).of(begins, ends)
    per_text = np.bincount(owner, minlength=len(sizes))
    filters = -(-per_text // FILTER_FEATURES)
    first_filter = np.cumsum(filters) - filters
    ordinal = np.arange(len(owner)) - (np.cumsum(per_text) - per_text)[owner]
    place = first_filter[owner] + ordinal // FILTER_FEATURES
    bits = np.zeros((int(filters.sum()), FILTER_BITS), bool)
    for i in range(HASHES):
        bits[place, (hashes >> np.uint64(11 * i)).astype(np.int64) & (FILTER_BITS - 1)] = True
    packed = np.packbits(bits, axis=1)
    return [
        base64.b64encode(packed[a : a + n].tobytes()).decode()
        for a, n in zip(first_filter.tolist(), filters.tolist())
    ]


def fingerprint(docs: DataFrame, rank: list[int], text_column: str = "text", name: str = "fingerprint") -> DataFrame:
    """Each row with a fingerprint: chained Bloom filters in base64.

    Of each `WINDOW` neighbouring windows the one of the rarest entropy (the first of
    equals) wins; windows that won `POPULAR` times are inserted in order, 160 to a
    filter of 2,048 bits, five bits each. A text without such a window (short, or
    nearly constant) is one feature as a whole; an empty or missing text has the
    empty fingerprint. Other columns are kept; one named `name` is replaced.
    """
    kept = docs.drop(name)

    def run(batches):
        ranks = np.array(rank)
        for batch in textops.slices(batches, text_column):
            texts = batch.column(batch.schema.get_field_index(text_column))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(_digests(texts, ranks), pa.string())],
                [*batch.schema.names, name],
            )

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(name, StringType())]))


def _filters(digest: str) -> list[int]:
    raw, size = base64.b64decode(digest), FILTER_BITS // 8
    return [int.from_bytes(raw[i : i + size]) for i in range(0, len(raw), size)]


def compare(one: str | None, other: str | None) -> float:
    """Likeness of two fingerprints: 1 for equal ones, 0 for no more than chance.

    Each filter of the shorter chain meets its best partner in the other; the overlap
    of bits beyond what chance gives is divided by the most that is possible, and the
    filters count by their bits. Two empty fingerprints are equal.
    """
    one, other = one or "", other or ""
    if one == other or not one or not other:
        return float(one == other)
    short, long = sorted((_filters(one), _filters(other)), key=lambda c: (len(c), sum(f.bit_count() for f in c)))
    sizes = [f.bit_count() for f in long]
    total = weight = 0.0
    for f in short:
        own, best = f.bit_count(), 0.0
        for g, size in zip(long, sizes):
            chance = own * size / FILTER_BITS
            most = min(own, size) - chance
            if most > 0:
                best = max(best, ((f & g).bit_count() - chance) / most)
        total += best * own
        weight += own
    return min(1.0, total / weight)


def likeness(one: str, other: str) -> Column:
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([compare(x, y) for x, y in zip(a, b)], dtype=float)

    return run(one, other)


def with_next(
    docs: DataFrame,
    columns: list[str],
    keys: DataFrame | None = None,
    id_column: str = "doc_id",
    part_rows: int = 1000,
) -> DataFrame:
    """Each row with next_<column>: the values of the next row, descending by key.

    After the last row comes the first. A null key is the last of all, and rows with
    the same key follow one another by their columns. `keys` may give the same keys
    from a cheaper table.

    The rows are ordered in parts of the key's range holding about `part_rows`; the
    head of each part also visits the part before, so no task orders more than a part
    and the rows are shuffled once. The heads (a row per part) are broadcast up to
    `BROADCAST_PARTS`, and joined by shuffle beyond.
    """
    key = F.col(id_column)
    keys = (docs if keys is None else keys).select(key)
    low, high, known, n = keys.agg(F.min(key), F.max(key), F.count(key), F.count(F.lit(1))).first()
    low, high = (0, 0) if low is None else (int(low), int(high))
    wide = max(1, (high - low + 2) * part_rows // max(1, n))
    lowest = 0 if known < n else 1 // wide
    filled = F.coalesce(key, F.lit(low - 1))
    part = F.floor((filled - F.lit(low - 1)) / F.lit(wide)).cast("bigint")
    heads = keys.groupBy(part.alias("_part")).agg(F.max(filled).alias("_key"))
    heads = heads.withColumn("_block", F.floor(F.col("_part") / 1000))
    # a head visits the nearest part above; the last part of a block looks into the next block
    blocks = heads.groupBy("_block").agg(F.min("_part").alias("_low"))
    above = blocks.select("_block", F.lead("_low").over(Window.orderBy("_block")).alias("_above"))
    within = Window.partitionBy("_block").orderBy("_part")
    visits = (
        heads.withColumn("_up", F.lead("_part").over(within))
        .join(above, "_block")
        .select("_key", F.coalesce("_up", "_above", F.lit(lowest)).alias("_visits"))
    )
    if (high - low + 2) // wide < BROADCAST_PARTS:
        visits = F.broadcast(visits)
    seat = lambda guest, where: F.struct(F.lit(guest).alias("guest"), where.alias("part"))
    own = seat(False, F.col("_part"))
    seats = F.when(F.col("_visits").isNull(), F.array(own)).otherwise(
        F.array(own, seat(True, F.col("_visits")))
    )
    order = Window.partitionBy("_seat.part").orderBy("_seat.guest", F.desc("_key"), *columns)
    return (
        docs.withColumns({"_key": filled, "_part": part})
        .join(visits, "_key", "left")
        .withColumn("_seat", F.explode(seats))
        .select(
            *docs.columns,
            "_seat",
            *[F.lead(c).over(order).alias(f"next_{c}") for c in columns],
        )
        .where("NOT _seat.guest")
        .drop("_seat")
    )


def edited(text: str = "text", following: str = "next_text") -> Column:
    """The text with its last half replaced by as much of the following text."""
    size = F.length(F.coalesce(F.col(text), F.lit("")))
    half = (size / 2).cast("int")
    return F.concat(
        F.coalesce(F.col(text), F.lit("")).substr(F.lit(1), size - half),
        F.coalesce(F.col(following), F.lit("")).substr(F.lit(1), half),
    )
