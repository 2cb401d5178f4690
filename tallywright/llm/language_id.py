"""Language identification by the nearest of several centroids per language."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from tallywright.llm import textops
from tallywright.session import ship

ship(__name__)

BITS = 16
CENTROIDS = 3
SAMPLE_ROWS = 4000
ROWS = 4096
SLICE_BYTES = 1 << 19
BANDS = 32
BAND_ROWS = 20
MARGIN = 0.4
UNKNOWN = "und"

# lower-case letters and bytes of other letters stay, all else is a blank
_LETTERS = textops.LOWER.copy()
_LETTERS[[c for c in range(128) if not chr(c).isalpha()]] = 32


@dataclass
class Model:
    """Learned languages, one row of `centroids` for each entry of `languages`.

    `floors` holds, for each of these rows and each band of length, the similarity below
    which a text is too far away.
    """

    languages: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    floors: np.ndarray


def _nothing() -> Model:
    none = np.zeros((0, 1 << BITS), np.float32)
    return Model([], none, np.ones(1 << BITS, np.float32), np.zeros((0, BANDS)))


@dataclass
class _Texts:
    """Hashed three-byte sequences of texts: a cell and its count per entry."""

    bounds: np.ndarray  # where each text's entries start, and the end
    cells: np.ndarray
    counts: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.bounds))

    def band(self) -> np.ndarray:
        """The number of binary digits of the number of sequences."""
        total = np.bincount(self.owner, self.counts, len(self))
        return np.minimum(np.frexp(total)[1], BANDS - 1)

    def weights(self, idf: np.ndarray) -> np.ndarray:
        """Damped counts times idf, as vectors of length one."""
        raw = np.sqrt(self.counts) * idf[self.cells]
        length = np.sqrt(np.bincount(self.owner, raw * raw, len(self)))
        return raw / np.repeat(np.where(length > 0, length, 1), np.diff(self.bounds))

    def near(self, weights: np.ndarray, centres: np.ndarray) -> np.ndarray:
        """Cosine of every text with every centre."""
        owner, n = self.owner, len(self)
        each = [np.bincount(owner, weights * c[self.cells], n) for c in centres]
        return np.array(each).reshape(len(centres), n).T

    def take(self, rows: np.ndarray) -> _Texts:
        sizes = np.diff(self.bounds)[rows]
        ends = np.cumsum(sizes)
        places = np.arange(sizes.sum()) + np.repeat(self.bounds[:-1][rows] - (ends - sizes), sizes)
        return _Texts(np.concatenate([[0], ends]), self.cells[places], self.counts[places])


def _counts(column: pa.Array) -> _Texts:
    content, bounds = textops.flat(column)
    padded, starts = textops.spread(_LETTERS[content], bounds, 2, 32)
    a, b, c = (padded[i : len(padded) - 2 + i].astype(np.uint32) for i in range(3))
    h = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA6B) + c * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h >>= np.uint32(32 - BITS)
    blank = (a == 32) & (b == 32)
    owner = np.searchsorted(starts - 1, np.arange(len(h)), side="right") - 1
    kept = ~blank & (owner >= 0)
    found = np.sort((owner[kept].astype(np.uint32) << np.uint32(BITS)) | h[kept])
    first = np.flatnonzero(np.diff(found, prepend=found[:1] + 1) != 0)
    counts = np.diff(np.append(first, len(found)))
    cells = found[first]
    of_text = np.searchsorted(cells >> np.uint32(BITS), np.arange(len(column) + 1))
    return _Texts(of_text, (cells & np.uint32((1 << BITS) - 1)).astype(np.int32), counts)


def _centre(texts: _Texts, weights: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The direction of the chosen texts' sum."""
    mine = chosen[texts.owner]
    total = np.bincount(texts.cells[mine], weights[mine], 1 << BITS)
    return (total / (np.sqrt(total @ total) or 1.0)).astype(np.float32)


def _cluster(texts: _Texts, weights: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means, started from the texts farthest from one another."""
    n = len(texts)
    centres = _centre(texts, weights, np.ones(n, bool))[None]
    while len(centres) < min(k, n):
        farthest = texts.near(weights, centres).max(axis=1).argmin()
        centres = np.vstack([centres, _centre(texts, weights, np.arange(n) == farthest)])
    for _ in range(10):
        nearest = texts.near(weights, centres).argmax(axis=1)
        centres = np.vstack(
            [_centre(texts, weights, nearest == i) for i in np.unique(nearest)]
        )
    return centres


def _floors(texts: _Texts, idf: np.ndarray, k: int, margin: float) -> np.ndarray:
    """Per band of length, `margin` times the lowest hundredth of similarities.

    Centres of each half of the texts judge the other half. A band with too few texts
    has the floor of the next shorter one, as longer texts are nearer.
    """
    near, bands = [], []
    for half in (0, 1):
        other = texts.take(np.arange(1 - half, len(texts), 2))
        own = texts.take(np.arange(half, len(texts), 2))
        if len(own) and len(other):
            centres = _cluster(other, other.weights(idf), k)
            near.append(own.near(own.weights(idf), centres).max(axis=1))
            bands.append(own.band())
    floors = np.zeros(BANDS)
    if near:
        near, bands = np.concatenate(near), np.concatenate(bands)
        for band in range(1, BANDS):
            here = near[bands == band]
            enough = len(here) >= BAND_ROWS
            floors[band] = margin * np.quantile(here, 0.01) if enough else floors[band - 1]
    return floors


def fit(
    labelled: DataFrame,
    id_column: str = "doc_id",
    sample_rows: int = SAMPLE_ROWS,
    centroids: int = CENTROIDS,
    margin: float = MARGIN,
) -> Model:
    """Learn from rows with `text` and `lang`; rows lacking either are left out.

    At most about `sample_rows` rows, spread evenly over the languages and chosen by
    a hash of their key, are counted by tasks and come to the driver; all rows are
    counted for that. A text is too far from every language if its similarity to the
    nearest centroid is below that language's floor for texts about as long: `margin`
    times the lowest hundredth of the similarities of labelled texts.
    """
    usable = labelled.where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not sizes:
        return _nothing()
    each = max(1, sample_rows // len(sizes))
    share = F.lit(0.0)
    for language, size in sizes.items():
        share = F.when(F.col("lang") == language, min(1.0, each / size)).otherwise(share)
    chosen = F.pmod(F.xxhash64(id_column), F.lit(1 << 30)) < share * (1 << 30)

    def vectors(batches):
        for batch in textops.slices(batches, rows=ROWS, size=SLICE_BYTES):
            texts = _counts(batch.column("text"))
            cells, counts = (
                pa.LargeListArray.from_arrays(texts.bounds, pa.array(part.astype(np.int32))).cast(pa.list_(pa.int32()))
                for part in (texts.cells, texts.counts)
            )
            yield pa.RecordBatch.from_arrays([batch.column("lang"), cells, counts], ["lang", "cells", "counts"])

    sample = (
        usable.where(chosen)
        .select("lang", "text")
        .mapInArrow(vectors, "lang string, cells array<int>, counts array<int>")
        .toArrow()
    )
    names = np.array(sample["lang"].to_pylist())
    cells, counts = (sample[c].combine_chunks() for c in ("cells", "counts"))
    flat = lambda lists: lists.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(cells.offsets.to_numpy())
    texts = _Texts(np.concatenate([[0], np.cumsum(sizes)]), flat(cells), flat(counts))
    if not len(texts):
        return _nothing()
    idf = np.log((1 + len(texts)) / (1 + np.bincount(texts.cells, minlength=1 << BITS))) + 0.05
    idf = idf.astype(np.float32)
    # the same order whatever task came first
    order = np.lexsort((np.add.reduceat(np.append(texts.cells, 0), texts.bounds[:-1]), sizes))
    languages, centres, floors = [], [], []
    for language in sorted(set(names)):
        own = texts.take(order[names[order] == language])
        found = _cluster(own, own.weights(idf), centroids)
        languages += [language] * len(found)
        centres.append(found)
        floors += [_floors(own, idf, centroids, margin)] * len(found)
    return Model(languages, np.vstack(centres), idf, np.array(floors))


def predict(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """Each row with lang_pred, score (cosine, 0 to 1) and rejected.

    `und` with score 0 where the text is missing or has no letter, or nothing was
    learned. Rejected are those and the texts whose similarity to the nearest
    centroid is below its floor. Of equally near languages the first by name
    is taken. Columns of these three names are replaced, all others kept.
    """
    kept = docs.drop("lang_pred", "score", "rejected")
    schema = StructType(
        [
            *kept.schema.fields,
            StructField("lang_pred", StringType()),
            StructField("score", DoubleType()),
            StructField("rejected", BooleanType()),
        ]
    )

    def run(batches):
        known = model  # sent along: bounded by languages * centroids
        for batch in textops.slices(batches, text_column, rows=ROWS, size=SLICE_BYTES):
            texts = batch.column(batch.schema.get_field_index(text_column))
            content, bounds = textops.flat(texts)
            letters = np.concatenate(
                [[0], np.cumsum((content | 32 >= 97) & (content | 32 <= 122) & (content < 128))]
            )
            named = letters[bounds[1:]] > letters[bounds[:-1]]
            for i in np.flatnonzero(~named & (np.diff(bounds) > 0)):
                named[i] = any(map(str.isalpha, texts[int(i)].as_py()))
            if known.languages:
                counted = _counts(texts)
                near = counted.near(counted.weights(known.idf), known.centroids)
                best = near.argmax(axis=1)
                floor = known.floors[best, counted.band()]
                score = np.where(
                    named, np.clip(near[np.arange(len(best)), best], 0, 1), 0.0
                ).astype(np.float64)
                names = [known.languages[b] if n else UNKNOWN for b, n in zip(best, named)]
            else:
                score, names, floor = np.zeros(len(named)), [UNKNOWN] * len(named), 0.0
            rejected = (score < floor) | ~named | (not known.languages)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(score), pa.array(rejected)],
                [*batch.schema.names, "lang_pred", "score", "rejected"],
            )

    return kept.mapInArrow(run, schema)


def held_out(id_column: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Whether the row's key falls into the part that nothing is learned from."""
    key = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return F.crc32(key.cast("binary")) % parts == part
