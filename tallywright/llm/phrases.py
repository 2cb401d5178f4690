"""Phrases whose words occur together far more often than apart, per language."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywright.llm import quotient, tables, textops
from tallywright.session import ship

ship(__name__)

LEAST, SHARE, TOP, LONGEST = 30, 80, 2000, 4
SLICE_BYTES = 3 << 20
ARROW_BYTES = "16m"
CELL_BITS = 27  # of the sieves: 16 MB of bits, whatever the corpus
HELD_ENTRIES = 1 << 20
BLOCK_ENTRIES = 1 << 20
SCALE = 2_000_000

_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
_GAP = _STOP.copy()
_GAP[[9, 32]] = True


def _named(docs: DataFrame, text_column: str, lang_column: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"),
        F.col(text_column).alias("text"),
    )


class _Words:
    """The words of a batch: bytes, places, 64-bit numbers, and which are neighbours."""

    def __init__(self, batch: pa.RecordBatch, seed: int) -> None:
        content, bounds = textops.flat(batch.column("text"))
        self.content = textops.LOWER[content]
        inside = ~_GAP[self.content]
        edge = np.zeros(len(content) + 1, bool)
        edge[bounds] = True
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.owner = np.searchsorted(bounds, self.start, side="right") - 1
        stops = np.cumsum(_STOP[self.content], dtype=np.int32)[self.start] if len(content) else self.start
        self.beside = (self.owner[1:] == self.owner[:-1]) & (stops[1:] == stops[:-1])
        names, spots = textops.flat(batch.column("lang"))
        lang = textops.Hasher(names, seed).of(spots[:-1], spots[1:])
        del inside, edge, begins, ends, stops
        own = textops.Hasher(self.content, seed).of(self.start, self.end)
        self.hash = textops.mix(own + textops.mix(lang + np.uint64(seed))[self.owner])


def words(docs: DataFrame, seed: int = 0) -> DataFrame:
    """Count of every word of every language, with its 64-bit number."""

    def run(batches):
        for batch in textops.slices(batches, size=SLICE_BYTES):
            found = _Words(batch, seed)
            number, first, count = np.unique(found.hash, return_index=True, return_counts=True)
            start, end = found.start[first], found.end[first]
            sizes = end - start
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            take = np.repeat(start - offsets[:-1], sizes) + np.arange(offsets[-1])
            text = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(),
                len(sizes),
                [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(found.content[take])],
            )
            lang = batch.column("lang").take(pa.array(found.owner[first]))
            for a in range(0, len(sizes), 1 << 16):
                piece = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(number[piece].view(np.int64)),
                        lang[piece],
                        text[piece].cast(pa.binary()).cast(pa.string()),
                        pa.array(count[piece].astype(np.int64)),
                    ],
                    ["number", "lang", "word", "n"],
                )

    return (
        docs.mapInArrow(run, "number bigint, lang string, word string, n bigint")
        .groupBy("number", "lang", "word")
        .agg(F.sum("n").alias("n"))
    )


def _sieve(cells: DataFrame):
    """One bit per cell that occurs in the column `cell`, in a broadcast of fixed size."""
    rows = (
        cells.groupBy(F.shiftright("cell", 15).alias("part"))
        .agg(F.bitmap_construct_agg(F.col("cell").bitwiseAND(32767)).alias("bits"))
        .collect()
    )
    held = np.zeros((1 << (CELL_BITS - 15), 4096), np.uint8)
    for row in rows:
        held[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return cells.sparkSession.sparkContext.broadcast(held.reshape(-1))


def _among(sieve: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (sieve[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _gram_cells(words: list[np.ndarray]) -> np.ndarray:
    total = words[0]
    for i, word in enumerate(words[1:], 1):
        total = textops.mix(total + word * np.uint64(2 * i + 1))
    return _cells(total)


def counted(
    docs: DataFrame, lengths: list[int], bits: int, block_bits: int, seed: int, known, pairs=None, least: int = LEAST
) -> DataFrame:
    """N-grams with at least `least` occurrences: length, ids (8 bytes a word), a, cell.

    Each task counts its texts in sorted filters and hands on one filter per block and
    million entries; blocks are merged one by one. `known` sieves words; with
    `pairs`, a sieve of two-word phrases, only n-grams made of such pairs count.
    """

    def run(batches):
        held = {length: [] for length in lengths}
        sizes = dict.fromkeys(lengths, 0)

        def handed_on(length):
            merged = quotient.merge(held[length])
            held[length], sizes[length] = [merged], len(merged[1])
            if sizes[length] * 2 < HELD_ENTRIES and not last:
                return
            held[length], sizes[length] = [], 0
            for block, data in quotient.blocks(merged, bits, block_bits):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([length], pa.int32()), pa.array([block], pa.int64()), pa.array([data], pa.binary())],
                    ["length", "block", "filter"],
                )

        last = False
        for batch in textops.slices(batches, size=SLICE_BYTES):
            found = _Words(batch, seed)
            usual = _among(known.value, _cells(found.hash))
            number = found.hash >> np.uint64(64 - bits)
            linked = found.beside & usual[1:] & usual[:-1]
            del found
            if pairs is not None:
                at = np.flatnonzero(linked)
                linked[at] = _among(pairs.value, _gram_cells([number[at], number[at + 1]]))
            for length in lengths:
                whole = linked[: max(len(linked) - length + 2, 0)].copy()
                for i in range(1, length - 1):
                    whole &= linked[i : i + len(whole)]
                at = np.flatnonzero(whole)
                if len(at):
                    grams = quotient.permute([number[at + i] for i in range(length)], bits)
                    held[length].append(quotient.merge([(grams, np.ones(len(at), np.int64))]))
                    sizes[length] += len(held[length][-1][1])
                    if sizes[length] >= HELD_ENTRIES:
                        yield from handed_on(length)
        last = True
        for length in lengths:
            if held[length]:
                yield from handed_on(length)

    def merged(group: pa.Table) -> pa.Table:
        length = group.column("length")[0].as_py()
        parts = [quotient.decode(data.as_py()) for data in group.column("filter")]
        grams, counts = quotient.merge(parts)
        often = counts >= least
        grams = quotient.restore([word[often] for word in grams], bits)
        ids = np.stack(grams, axis=1).astype(">u8")
        flat = np.frombuffer(ids.tobytes(), np.uint8)
        return pa.table(
            {
                "length": pa.array(np.full(len(ids), length, np.int32)),
                "ids": pa.FixedSizeBinaryArray.from_buffers(
                    pa.binary(8 * length), len(ids), [None, pa.py_buffer(flat)]
                ).cast(pa.binary()),
                "a": pa.array(counts[often]),
                "cell": pa.array(_gram_cells(grams)),
            }
        )

    return (
        docs.mapInArrow(run, "length int, block bigint, filter binary")
        .groupBy("length", "block")
        .applyInArrow(merged, "length int, ids binary, a bigint, cell bigint")
    )


def _numbered(docs: DataFrame, least: int):
    """Words, the seed of their numbers, the width of a number, the sieve of usual ones.

    The sieve keeps every word with `least` occurrences and, by chance, few others.
    Numbers are cut to as few bits as keep all words apart that pass it, which is
    checked over all of them; should even 64 bits not do, another seed is taken.
    """
    for seed in range(2):
        every = tables.settled(words(docs, seed), "words", ARROW_BYTES)
        cell = F.shiftrightunsigned("number", 64 - CELL_BITS)
        cells = every.where(F.col("n") >= least).select(cell.alias("cell"))
        passing = every.join(cells.distinct(), cell == F.col("cell"), "left_semi")
        count = passing.count()
        bits = min(64, 2 * count.bit_length() + 8)
        while True:
            told = passing.select(F.shiftrightunsigned("number", 64 - bits)).distinct().count()
            if told == count:
                return every, seed, bits, _sieve(cells)
            if bits == 64:
                break
            bits = min(64, bits + 8)
    raise ValueError("word numbers of 64 bits collide under both seeds")


def mine(
    docs: DataFrame,
    text_column: str = "text",
    lang_column: str = "lang",
    least: int = LEAST,
    share: int = SHARE,
    top: int = TOP,
    longest: int = LONGEST,
) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces at sentence marks and line breaks, and
    into words at blanks and tabs. A phrase of 2 to `longest` words with a >= `least`
    occurrences has, per cut into a first part (l occurrences) and a rest (r), the
    score floor(2000000 * a / (l + r)); its lowest cut counts, of equal ones the first.
    Phrases inside a longer one with at least `share` percent of their occurrences are
    dropped. The `top` by score, then a, then phrase (bytes) are kept.

    A missing text is empty, a missing lang is `und`; empty texts and tables add no
    phrases; rows given twice count twice; other columns are not read.

    Three scans: words; pairs of usual words; longer phrases made of frequent pairs.
    Any part of a frequent phrase is itself frequent, so all parts are counted exactly.
    """
    plain = _named(docs, text_column, lang_column)
    every, seed, bits, known = _numbered(plain, least)
    totals = every.groupBy("lang").agg(F.sum("n").alias("n"))
    tokens = every.agg(F.sum("n")).first()[0] or 0
    spread = max(tables.parallelism(docs), 2 * tokens // BLOCK_ENTRIES, 2)
    block_bits = min((spread - 1).bit_length(), bits - 1)
    settings = {"bits": bits, "block_bits": block_bits, "seed": seed, "known": known, "least": least}
    grams = tables.settled(counted(plain, [2], **settings), "pairs", ARROW_BYTES)
    if longest > 2:
        pairs = _sieve(grams.select("cell"))
        more = counted(plain, list(range(3, longest + 1)), pairs=pairs, **settings)
        grams = grams.union(tables.settled(more, "phrases", ARROW_BYTES))
    number = F.lpad(F.hex(F.shiftrightunsigned("number", 64 - bits)), 16, "0")
    usual = every.where(F.col("n") >= least).select(F.unhex(number).alias("id"), "lang", "word", "n")
    return _best(grams.select("length", "ids", "a"), usual, totals, share, top)


def _best(grams: DataFrame, usual: DataFrame, totals: DataFrame, share: int, top: int) -> DataFrame:
    counts = grams.select("ids", F.col("a").alias("f")).union(usual.select("id", "n"))
    first = lambda k: F.substring("ids", F.lit(1), 8 * k)
    rest = lambda k: F.substring("ids", 8 * k + 1, 8 * F.col("length"))
    wide = lambda name: F.col(name).cast("decimal(20,0)")
    cuts = (
        grams.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("length") - 1)))
        .withColumn("front", first(F.col("cut")))
        .withColumn("back", rest(F.col("cut")))
        .join(counts.select(F.col("ids").alias("front"), F.col("f").alias("l")), "front")
        .join(counts.select(F.col("ids").alias("back"), F.col("f").alias("r")), "back")
        .withColumn("score", F.expr(f"CAST({SCALE} AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0)) DIV (CAST(l AS DECIMAL(20,0)) + r)"))
        .groupBy("length", "ids", "a")
        .agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    )
    inside = (
        grams.where("length > 2")
        .select(F.explode(F.array(first(F.col("length") - 1), rest(F.lit(1)))).alias("ids"), F.col("a").alias("longer"))
        .groupBy("ids")
        .agg(F.max("longer").alias("longer"))
    )
    kept = (
        cuts.join(inside, "ids", "left")
        .where(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * share))
        .select("ids", "length", "a", "best.l", "best.r", "best.score")
    )
    spelled = (
        kept.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("length") - 1)))
        .withColumn("id", F.substring("ids", 8 * F.col("at") + 1, F.lit(8)))
        .join(usual.select("id", "lang", "word"), "id")
        .groupBy("ids", "lang", "a", "l", "r", "score")
        .agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
        .withColumn("phrase", F.array_join("words.word", " "))
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("ids"), F.lit(64))
    ahead = Window.partitionBy("lang", salt).orderBy(*order)
    overall = Window.partitionBy("lang").orderBy(*order)
    return (
        spelled.withColumn("rank", F.row_number().over(ahead))
        .where(F.col("rank") <= top)
        .withColumn("rank", F.row_number().over(overall).cast("bigint"))
        .where(F.col("rank") <= top)
        .join(totals, "lang")
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
