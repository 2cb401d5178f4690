"""Repeated byte strings by a logarithmic family of sorted suffix lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm import tables, textops
from tallywright.session import ship

ship(__name__)

LENGTH = 100
PROBE = 20
BATCH = 1 << 16
_PLACE_BITS = 26
_SEGMENT = 1 << 24
_NO_ID = -(1 << 63)
_SUFFIXES = "doc_id bigint, key bigint, context bigint, place bigint"
_STRINGS = "doc_id bigint, key bigint, place bigint"
_MATCHES = "doc_id bigint, lo bigint, n int, off int, covered boolean"
# a place is lo, n and off in one whole number; n and off are below the length's limit
_LO, _N, _LOW = 30, 15, (1 << 15) - 1


def _segments(content: np.ndarray, bounds: np.ndarray, length: int):
    """A slice as it is, or a very long text in parts that overlap."""
    if len(content) <= _SEGMENT:
        yield content, bounds, 0
        return
    for at in range(0, max(1, len(content) - length + 1), _SEGMENT):
        part = content[at : at + _SEGMENT + length - 1]
        yield part, np.array([0, len(part)]), at


def _suffix_rows(names: np.ndarray, key, context, lo, n, off) -> pa.RecordBatch:
    """Rows of doc_id, key, context and place; without a context the key is all.

    place holds lo, n and off, lo in its highest bits; inverted (below zero) it marks all
    but the first row of a context.
    """
    whole = key if context is None else context
    order = np.lexsort((lo, names, whole))
    same = np.zeros(len(order), bool)
    same[order[1:]] = whole[order[1:]] == whole[order[:-1]]
    # rows of one key and place are one document, not a repeat
    twin = (names[order[1:]] == names[order[:-1]]) & (lo[order[1:]] == lo[order[:-1]])
    same[order[1:][twin]] = False
    place = (lo << _LO) | (n << _N) | off
    columns = {"doc_id": names, "key": key.view(np.int64)}
    if context is not None:
        columns["context"] = context.view(np.int64)
    columns["place"] = np.where(same, ~place, place)
    return pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in columns.items()})


def sampled_suffixes(docs: DataFrame, length: int = LENGTH, probe: int = PROBE) -> DataFrame:
    """The suffixes that stand for all strings of `length` bytes.

    A string is represented by the suffix at its least hash of `probe` bytes (the
    leftmost of equals), so equal strings are represented alike. Rows: doc_id; key,
    the hash of the suffix's first bytes; context, the hash of all bytes of the
    strings represented; and
    place, which holds those strings' starts, lo to lo + n - 1, how far the suffix lies
    behind lo, and whether an earlier row of the same slice of texts has the same context
    (`_suffix_rows`).
    """
    if not probe <= length < 1 << 15:
        raise ValueError("the strings must be longer than the probe, and below 32768 bytes")
    reach = length - probe + 1

    def run(batches):
        for batch in textops.slices(batches):
            content, bounds = textops.flat(batch.column("text"))
            names = batch.column("doc_id").to_numpy()
            for part, edges, shift in _segments(content, bounds, length):
                if len(part) < length:
                    continue
                hasher = textops.Hasher(part)
                at = np.arange(len(part) - probe + 1)
                code = hasher.of(at, at + probe)
                low = np.uint64((1 << _PLACE_BITS) - 1)
                ranked = (code & ~low) | at.astype(np.uint64)
                anchor = (textops.sliding_min(ranked, reach) & low).astype(np.int64)
                ends = np.repeat(edges[1:], np.diff(edges))[: len(anchor)]
                fits = np.arange(len(anchor)) + length <= ends
                turn = (anchor[1:] != anchor[:-1]) | ~fits[:-1] | ~fits[1:]
                first = np.flatnonzero(fits & np.concatenate([[True], turn]))
                last = np.flatnonzero(fits & np.concatenate([turn, [True]]))
                owner = np.searchsorted(edges, first, side="right") - 1
                yield _suffix_rows(
                    names[owner],
                    code[anchor[first]],
                    hasher.of(first, last + length),
                    first - edges[owner] + shift,
                    last - first + 1,
                    anchor[first] - first,
                )

    return docs.mapInArrow(run, _SUFFIXES)


class Family:
    """Suffix lists sorted by key and context, each twice as long as the next or more.

    A new batch is sorted, scanned against every list, and its new suffixes become a
    list; lists of the same rank are merged into one of the next rank. So a suffix is
    merged a logarithmic number of times.
    """

    def __init__(self) -> None:
        self.levels: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, contexts: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Which contexts came before, in this batch or an earlier one."""
        order = np.lexsort((np.arange(len(keys)), contexts, keys))
        k, c, r = keys[order], contexts[order], rows[order]
        seen = np.zeros(len(k), bool)
        seen[1:] = (k[1:] == k[:-1]) & (c[1:] == c[:-1])
        for _, level_keys, level_contexts, _ in self.levels:
            seen |= _holds(level_keys, level_contexts, k, c)
        run, rank = (k[~seen], c[~seen], r[~seen]), 0
        while self.levels and self.levels[-1][0] == rank:
            run = _merged(self.levels.pop()[1:], run)
            rank += 1
        self.levels.append((rank, *run))
        out = np.empty(len(k), bool)
        out[order] = seen
        return out

    def split_keys(self) -> np.ndarray:
        """Rows of the suffixes whose key goes on in different ways."""
        run = None
        for level in reversed(self.levels):
            run = level[1:] if run is None else _merged(level[1:], run)
        if run is None or not len(run[0]):
            return np.zeros((0, 4), np.int64)
        same = run[0][1:] == run[0][:-1]
        return run[2][np.concatenate([same, [False]]) | np.concatenate([[False], same])]


def _merged(one, other):
    k, c, r = (np.concatenate(x) for x in zip(one, other))
    order = np.lexsort((c, k))
    return k[order], c[order], r[order]


def _holds(level_keys, level_contexts, keys, contexts) -> np.ndarray:
    """Binary search for key and context: first the key's rows, then within them."""
    low = np.searchsorted(level_keys, keys, side="left")
    high = np.searchsorted(level_keys, keys, side="right")
    end = high.copy()
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) // 2
        less = level_contexts[middle] < contexts[open_]
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]
    found = low < end
    found[found] = level_contexts[low[found]] == contexts[found]
    return found


def matches(suffixes: DataFrame, batch: int = BATCH) -> DataFrame:
    """Scan the suffixes in order of their place: doc_id, lo, n, off, covered.

    Covered suffixes have the context of an earlier one: all their strings repeat.
    The other rows are the first suffixes of contexts whose key is shared by another
    context, so some of their strings may repeat.

    One shuffle by key. A key comes at most once from each document, and a context
    once from each slice of texts (the rest goes to any task), so even a passage that
    every document has is a stream of short rows; a task keeps each context once, and
    its memory is set by the number of partitions.
    """
    spread = F.when(F.col("place") < 0, F.xxhash64("doc_id", "place")).otherwise(F.col("key"))
    count = tables.parallelism(suffixes)

    def run(batches):
        family, before = Family(), None
        waiting, size = [], 0

        def scan():
            nonlocal before
            table = pa.Table.from_batches(waiting)
            ids, keys, place = (table[c].to_numpy() for c in ("doc_id", "key", "place"))
            contexts = table["context"].to_numpy() if "context" in table.schema.names else keys
            again = place < 0
            place = np.where(again, ~place, place)
            lo, n = place >> _LO, (place >> _N) & _LOW
            yield ids[again], lo[again], n[again], None
            ids, keys, contexts, lo, n, off = (
                x[~again] for x in (ids, keys, contexts, lo, n, place & _LOW)
            )
            fields = np.stack([ids, lo, contexts], axis=1)
            twin = np.zeros(len(ids), bool)
            twin[1:] = (fields[1:] == fields[:-1]).all(axis=1)
            if len(ids) and before is not None:
                twin[0] = bool((fields[0] == before).all())
            if len(ids):
                before = fields[-1].copy()
            ids, keys, contexts, lo, n, off = (
                x[~twin] for x in (ids, keys, contexts, lo, n, off)
            )
            seen = family.add(
                keys.view(np.uint64),
                contexts.view(np.uint64),
                np.stack([ids, lo, n, off], axis=1),
            )
            yield ids[seen], lo[seen], n[seen], None

        def out(ids, lo, n, off):
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(lo, pa.int64()),
                    pa.array(n.astype(np.int32)),
                    pa.nulls(len(ids), pa.int32()) if off is None else pa.array(off.astype(np.int32)),
                    pa.array(np.full(len(ids), off is None)),
                ],
                ["doc_id", "lo", "n", "off", "covered"],
            )

        for part in batches:
            waiting.append(part)
            size += part.num_rows
            if size >= batch:
                for found in scan():
                    yield out(*found)
                waiting, size = [], 0
        if waiting:
            for found in scan():
                yield out(*found)
        rest = family.split_keys()
        yield out(*rest.T)

    # rows of one document, place and context must follow one another, whatever their off
    last = "context" if "context" in suffixes.columns else "key"
    return (
        suffixes.repartition(count, spread)
        .sortWithinPartitions("doc_id", F.shiftright("place", _LO), last)
        .mapInArrow(run, _MATCHES)
    )


def _listed(rows: DataFrame, *fields: str) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.collect_list(F.struct(*fields)).alias("listed"))


def _widths(length: int, probe: int) -> list[int]:
    """Into blocks of how many strings the open suffixes are cut, one step after the other."""
    reach = length - probe + 1
    return sorted({-(-reach // 2), -(-reach // 9), 1}, reverse=True)


def _pieces(docs: DataFrame, open_rows: DataFrame, length: int, probe: int, width: int) -> DataFrame:
    """The strings of the listed suffixes in blocks of `width`, each a suffix row of its own.

    Blocks are counted from the suffix that stands for the strings, so equal strings lie in
    equal blocks. A block's key is the hash of the bytes that all its strings share, its
    context that of all bytes of those strings of it that are listed. Blocks of one are
    strings, their key is all.
    """

    def run(batches):
        for batch in textops.slices(batches):
            content, bounds = textops.flat(batch.column("text"))
            lists = batch.column("listed")
            flat = lists.flatten()
            lo, n, off = (
                flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lo", "n", "off")
            )
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            # a row of the same key may have a shorter text
            n = np.minimum(n, np.diff(bounds)[owner] - length + 1 - lo)
            owner, lo, n, off = (x[n > 0] for x in (owner, lo, n, off))
            block, least = off // width, off - n + 1
            count = block - least // width + 1
            inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            owner, anchor, block, off, least = (
                np.repeat(x, count) for x in (owner, lo + off, block, off, least)
            )
            low = (block - inner) * width
            high = np.minimum(low + width - 1, length - probe)
            off, least = np.minimum(off, high), np.maximum(least, low)
            at, n = anchor - off, off - least + 1
            base = bounds[owner]
            hasher = textops.Hasher(content)
            context = hasher.of(base + at, base + at + (n - 1 + length))
            names = batch.column("doc_id").to_numpy()[owner]
            if width == 1:
                yield _suffix_rows(names, context, None, at, n, np.zeros_like(at))
                continue
            key = hasher.of(base + anchor - low, base + anchor - high + length)
            yield _suffix_rows(names, key, context, at, n, off)

    listed = _listed(open_rows, "lo", "n", "off")
    return docs.join(listed, "doc_id").mapInArrow(run, _SUFFIXES if width > 1 else _STRINGS)


def deduplicate(
    docs: DataFrame,
    length: int = LENGTH,
    probe: int = PROBE,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Per document its text's bytes without the strings that come earlier.

    A byte goes if any string of `length` bytes covering it also starts earlier: in a
    document with a smaller key, or further in front in the same one. Returns doc_id,
    n_bytes, spans (start and end of the longest removed runs) and kept (binary).
    Empty and missing texts stay as they are, a null key precedes all others, and
    rows with the same key are one document: they keep each other and lose the same.

    Only every fortieth suffix or so is indexed (`sampled_suffixes`). Where a whole
    context repeats, all its strings do. Where only its beginning repeats, a match may
    end inside it, and its strings are looked up in halves, in smaller blocks of those that
    share more than a beginning, and one by one in the last ones (`_pieces`). Each look-up
    is settled, so its shuffle files go before the next. Equality is that of 64-bit hashes
    of the bytes.
    """
    key = F.coalesce(F.col(id_column), F.lit(_NO_ID))
    plain = docs.select(key.alias("doc_id"), F.col(text_column).alias("text"))
    found = tables.settled(matches(sampled_suffixes(plain, length, probe)), "suffixes")
    covered = found.where("covered")
    for width in _widths(length, probe):
        pieces = _pieces(plain, found.where("NOT covered"), length, probe, width)
        found = tables.settled(matches(pieces), "pieces")
        covered = covered.unionByName(found.where("covered"))

    def run(batches):
        for batch in textops.slices(batches):
            content, bounds = textops.flat(batch.column("text"))
            raw = content.tobytes()
            spans, kept = [], []
            lists = batch.column("listed")
            for i, listed in enumerate(lists):
                text = raw[bounds[i] : bounds[i + 1]]
                if not listed.is_valid:
                    spans.append([])
                    kept.append(text)
                    continue
                lo = listed.values.field("lo").to_numpy()
                end = lo + listed.values.field("n").to_numpy() + (length - 1)
                order = np.argsort(lo, kind="stable")
                lo, end = lo[order], np.maximum.accumulate(end[order])
                gap = np.flatnonzero(lo[1:] > end[:-1])
                starts = lo[np.concatenate([[0], gap + 1])]
                ends = end[np.concatenate([gap, [len(end) - 1]])]
                spans.append([{"start": a, "end": b} for a, b in zip(starts.tolist(), ends.tolist())])
                edges = [0, *np.stack([starts, ends], axis=1).ravel().tolist(), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
            span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            names = batch.column("doc_id")
            known = np.array(names.to_numpy() != _NO_ID)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names.to_numpy(), mask=~known),
                    pa.array(np.diff(bounds)),
                    pa.array(spans, pa.list_(span)),
                    pa.array(kept, pa.binary()),
                ],
                ["doc_id", "n_bytes", "spans", "kept"],
            )

    return plain.join(_listed(covered, "lo", "n"), "doc_id", "left").mapInArrow(
        run,
        "doc_id bigint, n_bytes bigint,"
        " spans array<struct<start:bigint,end:bigint>>, kept binary",
    )
