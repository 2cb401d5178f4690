"""Whole Arrow batches of text as NumPy arrays: slices, words, hashes.

Texts lie one behind the other in one byte buffer, so each step below is a few
array operations for many documents. A missing text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tallywright.session import ship

ship(__name__)

SLICE_BYTES = 1 << 21
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and where each text starts (and the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[
        column.offset : column.offset + len(column) + 1
    ]
    content = (
        np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
        if data is not None and data.size
        else np.zeros(0, np.uint8)
    )
    return content, bounds - bounds[0]


def slices(
    batches, column: str = "text", rows: int = 1 << 30, size: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Batches cut to about `size` bytes of text, each text whole."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(
            zero_copy_only=False
        )
        ends, start = np.cumsum(lengths, dtype=np.int64), 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, before + size, side="right"))
            stop = min(max(stop, start + 1), start + rows)
            yield batch.slice(start, stop - start)
            start = stop


def spread(content: np.ndarray, bounds: np.ndarray, gap: int, fill: int):
    """The texts with `gap` fill bytes before, between and behind them."""
    count = len(bounds) - 1
    out = np.full(len(content) + gap * (count + 1), fill, np.uint8)
    owner = np.repeat(np.arange(count), np.diff(bounds))
    out[np.arange(len(content)) + gap * (owner + 1)] = content
    return out, bounds[:-1] + gap * np.arange(1, count + 1)


def mix(values: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit value spread over all bits (a bijection)."""
    v = values.astype(np.uint64, copy=True)
    v ^= v >> np.uint64(30)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(27)
    v *= np.uint64(0x94D049BB133111EB)
    v ^= v >> np.uint64(31)
    return v


TABLES = mix(np.arange(1, 513, dtype=np.uint64)).reshape(2, 256)


class Hasher:
    """64-bit hashes of any substrings of a buffer, equal for equal bytes."""

    def __init__(self, content: np.ndarray, seed: int = 0) -> None:
        size = len(content) + 1
        if not _powers or len(_powers[0]) < size:
            room = max(size, 1 << 20)
            _powers[:] = [
                np.concatenate(
                    [[np.uint64(1)], np.full(room - 1, b, np.uint64)]
                ).cumprod(dtype=np.uint64)
                for b in (_BASE, _INVERSE)
            ]
        weighted = TABLES[seed][content] * _powers[0][: size - 1]
        self.sums = np.zeros(size, np.uint64)
        np.cumsum(weighted, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * _powers[1][start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(content: np.ndarray, bounds: np.ndarray):
    """Start and end of each word, and the number of words before each text.

    A word is a longest run of bytes other than blank, tab to carriage return.
    """
    inside = ~SPACE[content]
    edge = np.zeros(len(content) + 1, bool)
    edge[bounds] = True
    before = np.concatenate([[False], inside[:-1]]) if len(inside) else inside
    after = np.concatenate([inside[1:], [False]]) if len(inside) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbouring values."""
    done, low = 1, values
    while done < width:
        step = min(done, width - done)
        low = np.minimum(low[:-step], low[step:])
        done += step
    return low
