"""Packing of documents into training sequences by dynamic programming."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm import textops
from tallywright.session import ship

ship(__name__)

SENTENCE_CUT = 2
HARD_CUT = 32
SEQUENCE_COST = 4
BLOCK_TOKENS = 1 << 18
CACHED_WORDS = 1 << 18
SLICE_BYTES = 1 << 20
_CLOSING = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # without the apostrophe, which may begin a piece with letters
_SCHEMA = (
    "doc_id {id}, start bigint, length bigint, ids binary, doc_tokens bigint,"
    " sequence_id bigint, offset bigint"
)


def best_cuts(positions: np.ndarray, penalties: np.ndarray, length: int) -> list[int]:
    """Indices of the positions where sequences start and end.

    Of all ways to cut, each piece at most `length` long, the one with the least
    sum of padding, penalties of the cuts and a small cost per sequence. A
    sequence is padded to `length`, but not where its own length is a power of
    two. The padding of a cut from i to j is length + position i - position j, so
    the best i is the least cost plus position within reach: the head of a
    monotone queue. Ties: the earliest i.
    """
    place = np.full(int(positions[-1]) + 1, -1, np.int64)
    place[positions] = np.arange(len(positions))
    hits, power = [], 1
    while power < length:
        ends = np.flatnonzero(positions >= power)
        begins = place[positions[ends] - power]
        found = begins >= 0
        hits.append(np.stack([ends[found], begins[found]]))
        power *= 2
    exact = np.concatenate(hits, axis=1) if hits else np.zeros((2, 0), np.int64)
    exact = exact[:, np.argsort(exact[0], kind="stable")]
    first = np.searchsorted(exact[0], np.arange(len(positions) + 1)).tolist()
    exact_from = exact[1].tolist()
    at, paid = positions.tolist(), penalties.tolist()
    cost, came, keys = [0.0] * len(at), [0] * len(at), [0.0] * len(at)
    queue: deque[int] = deque([0])
    for j in range(1, len(at)):
        here = at[j]
        while at[queue[0]] < here - length:
            queue.popleft()
        i = queue[0]
        least = keys[i] + length - here
        for x in range(first[j], first[j + 1]):
            other = exact_from[x]
            if cost[other] < least:
                least, i = cost[other], other
        cost[j], came[j] = least + paid[j] + SEQUENCE_COST, i
        key = keys[j] = cost[j] + here
        while queue and keys[queue[-1]] > key:
            queue.pop()
        queue.append(j)
    path = [len(at) - 1]
    while path[-1]:
        path.append(came[path[-1]])
    return path[::-1]


def _candidates(ends: np.ndarray, sentences: np.ndarray, length: int, last: bool):
    """Positions where a block may be cut and what each cut costs."""
    total = int(ends[-1])
    cost = {HARD_CUT: [], SENTENCE_CUT: sentences, 0: np.concatenate([[0], ends])}
    soft = np.unique(np.concatenate([sentences, [0], ends]))
    wide = np.flatnonzero(np.diff(soft) > length)
    hard = [np.arange(soft[i] + length, soft[i + 1], length) for i in wide]
    if last:  # the rest may be cut anywhere, so that it needs no padding
        hard.append(np.arange(max(1, total - length), total))
    cost[HARD_CUT] = np.concatenate(hard) if hard else np.zeros(0, np.int64)
    penalty = np.full(total + 1, -1, np.int32)
    for price, where in cost.items():  # a document's end prevails
        penalty[np.asarray(where, np.int64)] = price
    positions = np.flatnonzero(penalty >= 0)
    return positions, penalty[positions]


def _texts(column: pa.Array) -> list[str]:
    """As to_pylist, in a fraction of its time."""
    return column.to_numpy(zero_copy_only=False).tolist()


class _Encoder:
    """Token ids of whole texts. Words between ASCII white space are encoded once.

    So are letters and the ASCII punctuation behind them, which the vocabulary's
    tokenizer takes apart where the letters are letters once it has normalised them
    (some become a letter and a mark, which stays with the punctuation); words of
    letters alone go to it many to a text, and the tokens that end a word part them
    again. Words are told apart, taken apart and put together by Arrow.
    """

    def __init__(self, path: str, separator: int) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}
        self.tail = np.uint32(separator)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_sentence = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, number in vocabulary.items():
            if re.search(r"[.!?]\W*(</w>)?$", token):
                self.ends_sentence[number] = True
        self.ends_word = np.zeros(len(self.ends_sentence), bool)
        self.ends_word[[n for t, n in vocabulary.items() if t.endswith("</w>")]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _all_letters(self, cores: list[str]) -> list[bool]:
        """Whether each core, letters alone, still is so as the tokenizer normalises it."""
        normalizer = self.tokenizer.normalizer
        if normalizer is None or not cores:
            return [True] * len(cores)
        parts = normalizer.normalize_str(" ".join(cores)).split(" ")
        if len(parts) != len(cores):
            parts = [normalizer.normalize_str(core) for core in cores]
        return [part.isalpha() for part in parts]

    def _learn(self, cores: list[str]) -> None:
        """Ids of words that the tokenizer leaves whole, many of them to a text."""
        for at in range(0, len(cores), 256):
            some = cores[at : at + 256]
            ids = np.frombuffer(self._encode([" ".join(some)])[0], "<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(some):
                raw, ends = ids.tobytes(), (4 * ends).tolist()
                self.cores.update(zip(some, (raw[a:b] for a, b in zip([0, *ends], ends))))
            else:
                self.cores.update(zip(some, self._encode(some)))

    def _spelled(self, words: pa.Array) -> pa.Array:
        """The ids of each word as bytes; Python meets distinct cores and odd words only."""
        bare = pc.ascii_rtrim(words, characters=_CLOSING)
        coded = bare.dictionary_encode()
        cores, core_of = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        plain = pc.string_is_ascii(cores)
        keys = _texts(pc.if_else(plain, pc.ascii_lower(cores), cores))
        letters = pc.and_(plain, pc.ascii_is_alpha(cores)).to_numpy(zero_copy_only=False).copy()
        wide = [i for i in np.flatnonzero(~plain.to_numpy(zero_copy_only=False)).tolist() if keys[i].isalpha()]
        unseen = [keys[i] for i in wide if keys[i] not in self.cores]
        unsafe = {k for k, fine in zip(unseen, self._all_letters(unseen)) if not fine}
        letters[[i for i in wide if keys[i] not in unsafe]] = True

        parted = letters[core_of]
        size = pc.subtract(pc.binary_length(words), pc.binary_length(bare)).to_numpy(zero_copy_only=False)
        stops = np.cumsum(np.where(parted, size, 0), dtype=np.int64)
        content, bounds = textops.flat(words)
        behind = np.diff(stops, prepend=0)
        behind = content[np.repeat(bounds[1:] - stops, behind) + np.arange(behind.sum())]
        edges = pa.py_buffer(np.concatenate([[0], stops]).astype(np.int64))
        tails = pa.LargeStringArray.from_buffers(len(words), edges, pa.py_buffer(behind)).dictionary_encode()
        closing = tails.dictionary.to_pylist()
        odd = _texts(words.filter(pa.array(~parted)))

        fine = letters.tolist()
        self._learn(list({k for k, f in zip(keys, fine) if f}.difference(self.cores)))
        new = list(set(closing).difference(self.cores))
        self.cores.update(zip(new, self._encode(new)))
        new = list(set(odd).difference(self.known))
        self.known.update(zip(new, self._encode(new)))
        front = [self.cores[k] if f else b"" for k, f in zip(keys, fine)] + [self.known[w] for w in odd]
        back = [self.cores[k] for k in closing]
        if len(self.cores) > CACHED_WORDS:  # the frequent ones are among these
            self.cores = {k: x for k, x, f in zip(keys, front, fine) if f}
        if len(self.known) > CACHED_WORDS:
            self.known = dict(zip(odd, front[len(keys) :]))
        at = core_of.astype(np.int64)
        at[~parted] = len(keys) + np.arange(len(odd))
        return pc.binary_join_element_wise(
            pa.array(front, pa.large_binary()).take(pa.array(at)),
            pa.array(back, pa.large_binary()).take(tails.indices),
            pa.scalar(b"", pa.large_binary()),
        )

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text and the separator; words are looked up once per call."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        content, ends = textops.flat(self._spelled(coded.dictionary).take(coded.indices))
        ids, ends = content.view("<u4"), ends // 4
        bounds = split.offsets.to_numpy()
        edges = ends[bounds - bounds[0]].tolist()
        for a, b in zip(edges, edges[1:]):
            yield np.append(ids[a:b], self.tail)


def pack(
    docs: DataFrame,
    tokenizer: str,
    length: int = 2048,
    separator: int = 1,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """All documents in sequences of at most `length` tokens, in one pass.

    A document is the ids of its text and then `separator`; a missing or empty
    text is the separator alone. Returns per piece the document's key, where the
    piece starts in it, its length, its ids (little-endian 32-bit), the document's
    length, the sequence and the place in it. Other columns are not looked at;
    repeated rows are packed as often as they come, and a null key is kept.

    Documents keep the order in which a task reads them, so no text is shuffled. A
    task cuts blocks of about 262,144 tokens by `best_cuts` at document ends (free),
    sentence ends and, where a sentence is longer than a sequence, hard cuts; the
    last sequence of a block goes on with the next one. The rest of a task may be
    cut anywhere. Memory is a block, or the longest document.
    """
    key = docs.schema[id_column].dataType
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))

    def run(batches):
        encode, number = _Encoder(tokenizer, separator), TaskContext.get().partitionId() << 32
        waiting: list[tuple[object, int, np.ndarray, int]] = []
        tokens = 0
        schema = None

        def cut(last: bool):
            nonlocal waiting, tokens, number
            sizes = np.array([len(ids) for _, _, ids, _ in waiting])
            ends = np.cumsum(sizes)
            stream = np.concatenate([ids for _, _, ids, _ in waiting])
            sentences = np.flatnonzero(encode.ends_sentence[stream]) + 1
            positions, penalties = _candidates(ends, sentences, length, last)
            cuts = positions[best_cuts(positions, penalties, length)]
            if not last:
                cuts = cuts[:-1]
            edges = np.unique(np.concatenate([cuts, ends[ends <= cuts[-1]]]))
            begins, stops = edges[:-1], edges[1:]
            owner = np.searchsorted(ends, begins, side="right")
            sequence = np.searchsorted(cuts, begins, side="right") - 1
            base = np.array([start for _, start, _, _ in waiting]) - (ends - sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([waiting[i][0] for i in owner], schema),
                    pa.array(begins + base[owner], pa.int64()),
                    pa.array(stops - begins, pa.int64()),
                    pa.array(
                        [stream[a:b].tobytes() for a, b in zip(begins, stops)],
                        pa.binary(),
                    ),
                    pa.array([waiting[i][3] for i in owner], pa.int64()),
                    pa.array(sequence + number, pa.int64()),
                    pa.array(begins - cuts[sequence], pa.int64()),
                ],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )
            number += len(cuts) - 1
            rest = int(np.searchsorted(ends, cuts[-1], side="right"))
            kept = waiting[rest:]
            if kept:
                name, start, ids, whole = kept[0]
                done = int(cuts[-1] - (ends[rest] - sizes[rest]))
                kept[0] = (name, start + done, ids[done:], whole)
            waiting, tokens = kept, int(ends[-1] - cuts[-1])

        for batch in textops.slices(batches, size=SLICE_BYTES):
            schema = batch.schema.field("doc_id").type
            for name, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text"))):
                waiting.append((name, 0, ids, len(ids)))
                tokens += len(ids)
                if tokens >= BLOCK_TOKENS:
                    yield from cut(last=False)
        if waiting:
            yield from cut(last=True)

    return narrow.mapInArrow(run, _SCHEMA.format(id=key.simpleString()))
