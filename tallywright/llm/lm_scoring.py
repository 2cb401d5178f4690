"""Log probability of texts under a subword lattice."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm import tables, textops
from tallywright.session import ship

ship(__name__)

_PACKED = 8  # bytes of a piece that are looked up as they are; longer ones by a hash
DISCOUNT = 0.75
ROUNDS = 2
PRIOR_USES = 10_000.0  # what the vocabulary's own scores count for, in uses of pieces
_SLICE = 1 << 23
_PART = 1 << 20  # a slice is hashed in parts, since hashing takes 40 bytes to a byte
_WORD_BYTES = 1 << 17
_LONG = 1 << 12  # bytes of a word beyond which its recursion is cut into chunks
_CHUNK = 128
_CHUNKS = 128
_BATCH = "16m"
_ROWS = 1 << 14


@dataclass
class Pieces:
    """Pieces by length: sorted packed bytes, numbers, and log probabilities (base e).

    In place of packed bytes, pieces of more than 8 bytes have the 64-bit hash of theirs.
    """

    packed: list[np.ndarray]
    numbers: list[np.ndarray]
    logs: np.ndarray
    stop: float = 0.25  # chance that a word ends after a piece
    scores: np.ndarray | None = None  # probabilities by the vocabulary's own scores


def _hashed(pieces: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(p) for p in pieces])
    starts = ends - [len(p) for p in pieces]
    return textops.Hasher(np.frombuffer(b"".join(pieces), np.uint8)).of(starts, ends)


def read_vocabulary(path: str) -> Pieces:
    """The pieces of a sentencepiece file, lower-cased, and every single byte.

    A piece's weight falls with its rank in the file's scores. Pieces that no
    lower-cased word can use are left out: those with A to Z, or a blank further on.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weight: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        raw = model.id_to_piece(i).replace("▁", " ").encode()
        if b" " not in raw[1:] and not set(raw) & set(range(65, 91)):
            weight[raw] = 1.0 / (200.0 - model.get_score(i))
    for byte in range(256):
        weight.setdefault(bytes([byte]), 1e-6)
    total = sum(weight.values())
    listed = sorted(weight, key=lambda p: (len(p), p))
    packed, numbers = [], []
    for size in range(1, len(listed[-1]) + 1):
        number = np.array([i for i, p in enumerate(listed) if len(p) == size], np.int64)
        own = [listed[i] for i in number]
        if size <= _PACKED or not own:
            packed.append(np.array([int.from_bytes(p) for p in own], np.uint64))
        else:
            code = _hashed(own)
            order = np.argsort(code)
            number = number[order]
            packed.append(code[order])
        numbers.append(number)
    share = np.array([weight[p] / total for p in listed])
    return Pieces(packed, numbers, np.log(share), scores=share)


def _matches(raw: np.ndarray, left: np.ndarray, pieces: Pieces):
    """By size: the places where a piece of that size begins, and its number.

    A place has `left` bytes up to the end of its word.
    """
    value = np.zeros(len(left), np.uint64)
    longer = np.concatenate([raw, np.zeros(_PACKED, np.uint8)])
    hasher = textops.Hasher(raw)
    for size, (known, number) in enumerate(zip(pieces.packed, pieces.numbers), 1):
        if size <= _PACKED:
            value = (value << np.uint64(8)) | longer[size - 1 : size - 1 + len(left)]
        fits = np.flatnonzero(left >= size)
        if not len(known) or not len(fits):
            continue
        sought = value[fits] if size <= _PACKED else hasher.of(fits, fits + size)
        at = np.minimum(np.searchsorted(known, sought), len(known) - 1)
        hit = known[at] == sought
        if hit.any():
            yield size, fits[hit], number[at[hit]]


def _log_sum(rows: np.ndarray, axis: int) -> np.ndarray:
    top = rows.max(axis=axis)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(rows - np.expand_dims(safe, axis)).sum(axis=axis))


class _Lattice:
    """All segmentations of many words at once, in log space."""

    def __init__(self, words: list[bytes], pieces: Pieces) -> None:
        self.order = np.argsort([-len(w) for w in words], kind="stable")
        text = b"".join(b" " + words[i] for i in self.order) + b"  "
        self.sizes = np.array([len(words[i]) + 1 for i in self.order])
        raw = np.frombuffer(text, np.uint8)
        begins = np.cumsum(self.sizes) - self.sizes
        self.begins = begins + np.arange(len(begins))  # a slot more for each end
        slots = int(self.sizes.sum()) + len(begins)
        slot = np.arange(len(raw) - 2) + np.repeat(np.arange(len(begins)), self.sizes)
        left = np.repeat(begins + self.sizes, self.sizes) - np.arange(len(slot))
        self.slots, self.arcs, self.numbers = slots, {}, {}
        for size, places, which in _matches(raw, left, pieces):
            where = slot[places]
            found_number = np.full(slots, -1, np.int32)
            found_number[where] = which
            logs = np.full(slots, -np.inf)
            logs[where] = pieces.logs[which] + np.log(1 - pieces.stop)
            self.arcs[size] = logs
            self.numbers[size] = found_number
        self.final = np.log(pieces.stop / (1 - pieces.stop))

    def _swept(self, forward: bool) -> np.ndarray:
        out = np.full(self.slots, -np.inf)
        out[self.begins if forward else self.begins + self.sizes] = 0.0
        for step in range(1, int(self.sizes[0]) + 1 if len(self.sizes) else 0):
            # the words that reach so far are the first ones
            active = np.searchsorted(-self.sizes, -step, side="right")
            here = (self.begins if forward else self.begins + self.sizes)[:active]
            here = here + step if forward else here - step
            terms = []
            for size, arc in self.arcs.items():
                if size > step:
                    break
                terms.append(out[here - size] + arc[here - size] if forward else out[here + size] + arc[here])
            out[here] = _log_sum(np.stack(terms), 0)
        return out

    def log_probability(self) -> np.ndarray:
        """log10 of the sum over all segmentations, in the order of the words."""
        out = np.empty(len(self.sizes))
        out[self.order] = self._swept(True)[self.begins + self.sizes] + self.final
        return out / np.log(10.0)

    def expected(self, count: int, weights: np.ndarray | None = None) -> tuple[np.ndarray, float]:
        """Expected uses of every piece, and of all pieces together; words count by weight."""
        ahead, back = self._swept(True), self._swept(False)
        whole = np.repeat(ahead[self.begins + self.sizes], self.sizes + 1)
        weight = np.ones(len(self.sizes)) if weights is None else weights[self.order]
        each = np.repeat(weight, self.sizes + 1)
        uses = np.zeros(count)
        for size, arc in self.arcs.items():
            number = self.numbers[size]
            at = np.flatnonzero(number >= 0)
            share = np.exp(ahead[at] + arc[at] + back[at + size] - whole[at]) * each[at]
            uses += np.bincount(number[at], share, minlength=count)
        return uses, float(uses.sum())


def _long_log_probability(word: bytes, pieces: Pieces) -> float:
    """log10 of the sum over all segmentations of one long word, in bounded memory.

    The recursion looks back no further than the longest piece found. So a chunk of the
    word is a matrix that takes the values of the last places before it to those of the
    last places in it. Many chunks are swept at once, and their matrices follow one
    another in log space.
    """
    raw = np.frombuffer(b" " + word, np.uint8)
    step = _CHUNK * _CHUNKS
    longest = len(pieces.packed)

    def window(start: int, end: int):
        return _matches(raw[start:end], end - np.arange(start, end), pieces)

    reach = max(
        size
        for start in range(0, len(raw), step)
        for size, _, _ in window(max(0, start - longest + 1), min(len(raw), start + step))
    )
    state = np.full(reach, -np.inf)
    state[-1] = 0.0
    sizes = np.arange(1, reach + 1)
    at = 0
    while at < len(raw):
        chunk = min(_CHUNK, len(raw) - at)
        count = min(_CHUNKS, (len(raw) - at) // chunk)
        first, end = max(0, at - reach + 1), at + chunk * count
        arcs = np.full((reach + 1, reach - 1 + chunk * count), -np.inf)
        for size, places, which in window(first, end):
            arcs[size, places + first - (at - reach + 1)] = pieces.logs[which] + np.log(1 - pieces.stop)
        begins = np.arange(count) * chunk
        out = np.full((count, reach, reach + chunk), -np.inf)
        out[:, np.arange(reach), np.arange(reach)] = 0.0
        for here in range(reach, reach + chunk):
            arc = arcs[sizes, begins[:, None] + here - sizes]
            out[:, :, here] = _log_sum(out[:, :, here - sizes] + arc[:, None, :], 2)
        for matrix in out[:, :, chunk:]:
            state = _log_sum(state[:, None] + matrix, 0)
        at = end
    return float((state[-1] + np.log(pieces.stop / (1 - pieces.stop))) / np.log(10.0))


def _log_probabilities(words: list[bytes], pieces: Pieces) -> np.ndarray:
    """log10 of each word's marginal probability, long words apart."""
    out = np.empty(len(words))
    short = [i for i, w in enumerate(words) if len(w) <= _LONG]
    out[short] = _Lattice([words[i] for i in short], pieces).log_probability()
    for i in set(range(len(words))).difference(short):
        out[i] = _long_log_probability(words[i], pieces)
    return out


def _groups(batches):
    """Word rows in groups of bounded bytes."""
    yield from textops.slices(batches, "word", size=_WORD_BYTES)


def _cut(words: list[bytes], counts: np.ndarray):
    """Long words in parts, as words of their own, in groups of bounded bytes."""
    group, weights, size = [], [], 0
    for word, count in zip(words, counts.tolist()):
        for start in range(0, len(word), _LONG):
            group.append(word[start : start + _LONG])
            weights.append(count)
            size += len(group[-1])
            if size >= _WORD_BYTES:
                yield group, np.array(weights, float)
                group, weights, size = [], [], 0
    if group:
        yield group, np.array(weights, float)


def _trained(words: DataFrame, pieces: Pieces, rounds: int) -> Pieces:
    """Piece probabilities by expectation maximisation over all words that are learned from.

    The vocabulary's scores stay in as `PRIOR_USES` uses, dealt out by them.
    """
    count = len(pieces.logs)
    for _ in range(rounds):

        def expect(batches, pieces=pieces):  # sent along: as large as the vocabulary
            uses = np.zeros(count + 1)
            for batch in _groups(batches):
                listed = [w.encode() for w in batch.column("word").to_pylist()]
                for group, weights in _cut(listed, batch.column("c").to_numpy()):
                    found, _ = _Lattice(group, pieces).expected(count, weights)
                    uses[:-1] += found
                    uses[-1] += weights.sum()
            at = np.flatnonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(uses[at])], ["piece", "uses"])

        rows = (
            words.where("c > 0")
            .select("word", "c")
            .mapInArrow(expect, "piece bigint, uses double")
            .groupBy("piece")
            .agg(F.sum("uses").alias("uses"))
            .collect()  # a row per piece
        )
        uses = np.zeros(count + 1)
        for row in rows:
            uses[row["piece"]] = row["uses"]
        if not uses[-1]:
            return pieces
        share = uses[:-1] + PRIOR_USES * pieces.scores
        stop = uses[-1] / max(uses[:-1].sum(), uses[-1] + 1e-9)
        pieces = Pieces(
            pieces.packed, pieces.numbers, np.log(share / share.sum()), float(stop) * (1 - 1e-6), pieces.scores
        )
    return pieces


def _squeezed(numbers: np.ndarray) -> bytes:
    """Small whole numbers as compressed planes of bytes."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unsqueezed(stored: bytes, count: int) -> np.ndarray:
    planes = pa.decompress(stored, decompressed_size=4 * count, codec="zstd", asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(4, count).T.copy().view("<u4").ravel().astype(np.int64)


def _tokenised(docs: DataFrame) -> DataFrame:
    """Per slice of texts a row for each distinct word, then one for each text.

    The rows of words have place, word and c (uses in what is learned from), those of
    texts doc_id, held_out, n_words and numbers, the places of their words. The most
    frequent words of a slice have the least places, which compress best. A slice is
    hashed in parts, of which only distinct words and places are kept.
    """
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        for batch in textops.slices(batches, size=_SLICE):
            codes, listed, inner, sizes = [], [], [], [np.zeros(1, np.int64)]
            seen = 0
            for part in textops.slices([batch], size=_PART):
                content, bounds = textops.flat(part.column("text"))
                content = textops.LOWER[content]
                start, end, before = textops.words(content, bounds)
                code, first, back = np.unique(
                    textops.Hasher(content).of(start, end), return_index=True, return_inverse=True
                )
                text = content.tobytes()
                listed += [text[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())]
                codes.append(code)
                inner.append((back + seen).astype(np.int32))
                sizes.append(np.diff(before))
                seen += len(code)
            _, first, merged = np.unique(np.concatenate(codes), return_index=True, return_inverse=True)
            inner = merged.astype(np.int32)[np.concatenate(inner)]
            order = np.argsort(-np.bincount(inner, minlength=len(first)), kind="stable")
            listed = [listed[i] for i in first[order].tolist()]
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            inner = place[inner]
            before = np.concatenate(sizes).cumsum()
            held = batch.column("held_out").to_numpy(zero_copy_only=False)
            taught = ~np.repeat(held, np.diff(before))
            counts = np.bincount(inner[taught], minlength=len(listed))
            own = pa.scalar(task << 32 | number)
            number += 1
            for at in range(0, len(listed), _ROWS):
                words = listed[at : at + _ROWS]
                rows = pa.RecordBatch.from_pydict(
                    {
                        "place": pa.array(np.arange(at, at + len(words)), pa.int32()),
                        "word": pa.array(words, pa.binary()).cast(pa.string()),
                        "c": pa.array(counts[at : at + len(words)], pa.int64()),
                    }
                )
                yield _row_batch(own, rows, batch.schema)
            for at in range(0, batch.num_rows, _ROWS):
                part, edge = batch.slice(at, _ROWS), before[at : at + _ROWS + 1]
                rows = pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id"),
                        "held_out": part.column("held_out"),
                        "n_words": pa.array(np.diff(edge), pa.int64()),
                        "numbers": pa.array(
                            [_squeezed(inner[a:b]) for a, b in zip(edge, edge[1:])], pa.binary()
                        ),
                    }
                )
                yield _row_batch(own, rows, batch.schema)
            del batch, part, listed, inner, rows
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(
        run,
        f"slice bigint, place int, word string, c bigint, doc_id {key}, held_out boolean,"
        " n_words bigint, numbers binary",
    )


def _row_batch(number: pa.Scalar, rows: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """Rows with all columns of the stored table; those they lack are null."""
    types = {
        "slice": pa.int64(), "place": pa.int32(), "word": pa.string(), "c": pa.int64(),
        "doc_id": schema.field("doc_id").type, "held_out": pa.bool_(), "n_words": pa.int64(), "numbers": pa.binary(),
    }
    own = {name: rows.column(name) for name in rows.schema.names}
    own["slice"] = pa.repeat(number, rows.num_rows).cast(pa.int64())
    arrays = [own[n] if n in own else pa.nulls(rows.num_rows, t) for n, t in types.items()]
    return pa.RecordBatch.from_arrays(arrays, list(types))


def score(docs: DataFrame, vocabulary: str, rounds: int = ROUNDS) -> DataFrame:
    """Score `text` of every row; learn from the rows where `held_out` is false.

    Needs doc_id (of any type), text and held_out; other columns are not looked at.
    Tokens are words between ASCII white space, A to Z lower-cased, and one end. The
    score is the log10 probability of the text: a token is the end with the share that
    ends have in what is learned from, else a word, whose probability is the sum over
    all its segmentations into pieces; pieces are drawn independently, and a word stops
    after each with a fixed chance. So the probabilities of all texts sum to at most
    one. A piece's probability follows its expected uses in all words learned from, to
    which the vocabulary's own scores add `PRIOR_USES`. For that, words of more than
    4,096 bytes are learned from in parts; all are scored whole.

    base_score is the add-one score of whole words. mixed_score is a second model: a
    word's discounted count, max(c - 0.75, 0), with the lattice's probability as what
    it backs off to. Empty and missing texts are an end; a null key, held_out of a null
    key, and repeated rows are treated like others.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    mixed_score.

    Words are counted once per slice of about 8 MB of text, and only the distinct
    words of a slice are joined with the counts and lattice scores, so a frequent
    word has a row per slice. Nothing as large as the word list is broadcast.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    sliced = tables.settled(
        _tokenised(docs.select("doc_id", "text", F.coalesce("held_out", F.lit(False)).alias("held_out"))),
        "slices",
        _BATCH,
    )
    listed = sliced.where("place IS NOT NULL").select("slice", "place", "word", "c")
    texts = sliced.where("place IS NULL").select(F.col("slice").alias("of_slice"), "doc_id", "held_out", "n_words", "numbers")
    counted = tables.settled(listed.groupBy("word").agg(F.sum("c").alias("c")), "words")
    known = counted.where("c > 0").agg(F.sum("c"), F.count("*")).first()
    ends = texts.where("NOT held_out").count()
    every, distinct = int(known[0] or 0) + ends, int(known[1]) + (ends > 0)
    pieces = _trained(counted, read_vocabulary(vocabulary), rounds)
    end_share = (ends + 1) / (every + 2)

    def lattice(batches):
        for batch in _groups(batches):
            words = [w.encode() for w in batch.column("word").to_pylist()]
            logs = _log_probabilities(words, pieces) + np.log10(1 - end_share)
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("c"), pa.array(logs)], ["word", "c", "log"]
            )

    scored = counted.mapInArrow(lattice, "word string, c bigint, log double")
    joined = listed.select("slice", "place", "word").join(scored, "word").select("slice", "place", "c", "log")

    def mixed(c: np.ndarray, log: np.ndarray) -> np.ndarray:
        spare = DISCOUNT * distinct + 1
        direct = np.log10(np.maximum(c - DISCOUNT, 0) + spare * 10.0 ** np.maximum(log, -290))
        # below the smallest doubles the logarithm itself is taken
        return np.where((log < -290) & (c < 1), np.log10(spare) + log, direct) - np.log10(every + 1)

    def base(c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (every + distinct + 1))

    end = np.array([float(ends)]), np.log10(np.array([end_share]))

    def finish(slice_texts: pa.Table, found: pa.Table) -> pa.Table:
        place = found.column("place").to_numpy()
        c, log = np.zeros((2, len(place) + 1))
        c[place] = found.column("c").to_numpy()
        log[place] = found.column("log").to_numpy()
        values = np.stack([c > 0, base(c), log, mixed(c, log)]).astype(float)
        values[:, -1] = 0.0  # stands behind the words, for texts without any
        sums = np.zeros((4, slice_texts.num_rows))
        stored = slice_texts.column("numbers").to_pylist()
        for i, n in enumerate(slice_texts.column("n_words").to_pylist()):
            if n:
                sums[:, i] = values[:, _unsqueezed(stored[i], n)].sum(axis=1)
        sums += np.array([float(ends > 0), base(end[0])[0], end[1][0], mixed(*end)[0]])[:, None]
        return pa.table(
            {
                "doc_id": slice_texts.column("doc_id"),
                "held_out": slice_texts.column("held_out"),
                "n_tokens": pa.array(slice_texts.column("n_words").to_numpy() + 1, pa.int64()),
                "n_known": pa.array(sums[0].astype(np.int64)),
                "train_tokens": pa.array(np.full(len(stored), every, np.int64)),
                "base_score": pa.array(sums[1]),
                "score": pa.array(sums[2]),
                "mixed_score": pa.array(sums[3]),
            }
        )

    return (
        texts.groupBy("of_slice")
        .cogroup(joined.groupBy("slice"))
        .applyInArrow(
            finish,
            f"doc_id {key}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint,"
            " base_score double, score double, mixed_score double",
        )
    )
