"""Counting quotient filters for n-grams of word numbers: lossless, sorted, mergeable.

An n-gram is `length` word numbers of `bits` bits each, held as one array per word. A
Feistel network permutes it within its own `length * bits` bits, so nothing is lost and
`restore` gives the words back. The leading bits of the permuted value name the block
(the shard that a filter belongs to), the next ones are the quotient and all others are
the stored remainder. A filter keeps its entries in order: one bit per quotient tells
whether it occurs, one bit per entry ends the run of a quotient, remainders take whole
bytes, and a count takes one byte, or an escape and eight where it is 255 or more.
"""

from __future__ import annotations

import numpy as np

from tallywright.llm import textops
from tallywright.session import ship

ship(__name__)

Entries = tuple[list[np.ndarray], np.ndarray]  # permuted words in order, counts

_HEAD = 7
_ESCAPE = 255
_ROUND = textops.mix(np.arange(2000, 2064, dtype=np.uint64)) | np.uint64(1)


def _step(words: list[np.ndarray], place: int, turn: int, bits: int) -> np.ndarray:
    total = np.full(len(words[0]), _ROUND[turn], np.uint64)
    for i, word in enumerate(words):
        if i != place:
            total += word * _ROUND[32 + (turn * 4 + i) % 32]
    return words[place] ^ (textops.mix(total) >> np.uint64(64 - bits))


def permute(words: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """Each n-gram's words, spread evenly over all values; `restore` undoes it."""
    out = list(words)
    for turn in range(2 * len(out)):
        place = turn % len(out)
        out[place] = _step(out, place, turn, bits)
    return out


def restore(words: list[np.ndarray], bits: int) -> list[np.ndarray]:
    out = list(words)
    for turn in reversed(range(2 * len(out))):
        place = turn % len(out)
        out[place] = _step(out, place, turn, bits)
    return out


def _same(words: list[np.ndarray]) -> np.ndarray:
    """Whether each entry but the first equals the one before it."""
    out = words[0][1:] == words[0][:-1]
    for word in words[1:]:
        out &= word[1:] == word[:-1]
    return out


def merge(parts: list[Entries]) -> Entries:
    """Entries of all parts in order, equal ones added up."""
    words = [np.concatenate(column) for column in zip(*(p[0] for p in parts))]
    counts = np.concatenate([p[1] for p in parts])
    order = np.argsort(words[0], kind="stable")
    words, counts = [w[order] for w in words], counts[order]
    tied = words[0][1:] == words[0][:-1]
    if (tied & ~_same(words)).any():  # equal leading words of different n-grams
        order = np.lexsort(words[::-1])
        words, counts = [w[order] for w in words], counts[order]
    if not len(counts):
        return words, counts
    first = np.flatnonzero(np.concatenate([[True], ~_same(words)]))
    return [w[first] for w in words], np.add.reduceat(counts, first)


def _packed(values: np.ndarray, bits: int) -> bytes:
    rows = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)
    return rows[:, : (bits + 7) // 8].tobytes()


def encode(entries: Entries, bits: int, block_bits: int) -> bytes:
    """The filter of one block: entries in order that share their leading bits."""
    words, counts = entries
    count = len(counts)
    quotient_bits = min(max(count, 1).bit_length(), bits - block_bits)
    low = bits - block_bits - quotient_bits
    block = int(words[0][0]) >> (bits - block_bits)
    rest = words[0] & np.uint64((1 << (bits - block_bits)) - 1)
    quotient = (rest >> np.uint64(low)).astype(np.int64)
    occupied = np.zeros(1 << quotient_bits, bool)
    occupied[quotient] = True
    ends = np.concatenate([quotient[1:] != quotient[:-1], [True]])
    large = counts[counts >= _ESCAPE].astype("<i8")
    head = np.array([len(words), bits, block_bits, block, quotient_bits, count, len(large)], "<i8")
    return b"".join(
        [
            head.tobytes(),
            np.packbits(occupied).tobytes(),
            np.packbits(ends).tobytes(),
            _packed(rest & np.uint64((1 << low) - 1), low),
            *(_packed(word, bits) for word in words[1:]),
            np.minimum(counts, _ESCAPE).astype(np.uint8).tobytes(),
            large.tobytes(),
        ]
    )


def decode(data: bytes) -> Entries:
    """The entries of a filter, as `encode` was given them."""
    length, bits, block_bits, block, quotient_bits, count, large = map(
        int, np.frombuffer(data, "<i8", _HEAD)
    )
    place = _HEAD * 8

    def taken(size: int) -> np.ndarray:
        nonlocal place
        place += size
        return np.frombuffer(data, np.uint8, size, place - size)

    def values(width: int) -> np.ndarray:
        size = (width + 7) // 8
        rows = np.zeros((count, 8), np.uint8)
        rows[:, :size] = taken(count * size).reshape(count, size)
        return rows.reshape(-1).view("<u8").astype(np.uint64, copy=False)

    occupied = np.unpackbits(taken(((1 << quotient_bits) + 7) // 8), count=1 << quotient_bits)
    ends = np.unpackbits(taken((count + 7) // 8), count=count)
    run = np.cumsum(ends) - ends
    quotient = np.flatnonzero(occupied)[run].astype(np.uint64)
    low = bits - block_bits - quotient_bits
    lead = (quotient << np.uint64(low)) | values(low)
    if block_bits:
        lead |= np.uint64(block << (bits - block_bits))
    words = [lead, *(values(bits) for _ in range(length - 1))]
    counts = taken(count).astype(np.int64)
    counts[counts == _ESCAPE] = taken(8 * large).view("<i8")
    return words, counts


def blocks(entries: Entries, bits: int, block_bits: int):
    """(block, filter) of each block that has entries."""
    words, counts = entries
    if not len(counts):
        return
    number = words[0] >> np.uint64(bits - block_bits) if block_bits else np.zeros(len(counts), np.uint64)
    cuts = np.concatenate([[0], np.flatnonzero(number[1:] != number[:-1]) + 1, [len(number)]])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield int(number[a]), encode(([w[a:b] for w in words], counts[a:b]), bits, block_bits)
