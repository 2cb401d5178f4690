"""Exact k nearest vectors by cosine similarity."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, isqrt, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions import cells
from tallywright.session import ship, written_once

ship(__name__)

RESULTS = 3  # fixed value: results returned per query
MAX_QUERIES = 2048
SLICE_ROWS = 50_000
QUERY_ROWS = 32_768  # queries that meet a slice in one task, at most
PIVOTS = 256
_SLACK = 1e-9  # far more than a bound or a rounded score can be off
_SCORE_DIGITS = 12  # equal vectors must tie, whatever block they are scored in
_BLOCK_CELLS = 4_000_000
_DEALT_ROWS = 256  # each comes out once per bin it asks for
_SCHEMA = "query_id bigint, vec_id bigint, score double"


def _normalised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and which rows have a direction at all."""
    length = np.sqrt((vectors * vectors).sum(axis=1))
    usable = np.isfinite(length) & (length > 0)
    return vectors / np.where(usable, length, 1.0)[:, None], usable


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """An array column as a matrix; its vectors must all have the same width."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    width = width if width is not None else int(lengths[0]) if len(lengths) else 0
    if (lengths != width).any():
        raise ValueError(f"vectors must have {width} elements")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), width)


class _Best:
    """The best k corpus vectors per query among the batches seen so far."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> None:
        self.query_ids, self.k = query_ids, k
        self.queries, self.usable = _normalised(queries)
        self.scores = np.full((len(query_ids), k), -np.inf)
        self.ids = np.zeros((len(query_ids), k), dtype=np.int64)

    def add(self, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Vectors that all queries meet, or those in the given rows."""
        rows = np.arange(len(self.query_ids)) if rows is None else rows
        # ascending ids: the first of equal scores is then the smaller id
        by_id = np.argsort(ids, kind="stable")
        ids, vectors = ids[by_id], vectors[by_id]
        step = max(1, _BLOCK_CELLS // max(1, len(rows)))
        for start in range(0, len(ids), step):
            block, usable = _normalised(vectors[start : start + step])
            self._merge(ids[start : start + step][usable], block[usable], rows)

    def _merge(self, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray) -> None:
        scores = np.round(self.queries[rows] @ vectors.T, _SCORE_DIGITS)
        every = np.arange(len(scores))
        best, names = [self.scores[rows]], [self.ids[rows]]
        for _ in range(min(self.k, len(ids))):
            place = scores.argmax(axis=1)
            best.append(scores[every, place][:, None])
            names.append(ids[place][:, None])
            scores[every, place] = -np.inf
        best, names = np.hstack(best), np.hstack(names)
        order = np.lexsort((names, -best), axis=1)[:, : self.k]
        self.scores[rows] = np.take_along_axis(best, order, axis=1)
        self.ids[rows] = np.take_along_axis(names, order, axis=1)

    def table(self) -> dict[str, np.ndarray]:
        found = (self.scores > -np.inf) & self.usable[:, None]
        return {
            "query_id": np.repeat(self.query_ids, found.sum(axis=1)),
            "vec_id": self.ids[found],
            "score": self.scores[found],
        }


def _vector_column(table: pa.Table, name: str) -> pa.Array:
    whole = table[name].combine_chunks()
    # an empty chunked array stays chunked
    return pa.array([], whole.type) if isinstance(whole, pa.ChunkedArray) else whole


def _vectors(df: DataFrame, id_column: str, vector: str, prefix: str) -> DataFrame:
    return df.select(
        cells.name(id_column).cast("bigint").alias(f"{prefix}_id"),
        cells.name(vector).alias(f"{prefix}_vec"),
    ).filter(F.col(f"{prefix}_vec").isNotNull())


def topk_similar(
    queries: DataFrame,
    corpus: DataFrame,
    query_id: str,
    query_vector: str,
    corpus_id: str,
    corpus_vector: str,
    k: int = RESULTS,
    max_queries: int = MAX_QUERIES,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """(query_id, vec_id, score, rank): the k most similar corpus vectors.

    Exact; equal scores rank by corpus id. Every task scores its part of the
    corpus as matrix products and passes on k rows per query, so pairs never
    become rows. Up to ``max_queries`` queries (read first, to check) are sent
    to every task; more meet only the blocks of the corpus that can hold one of
    their k best, as in ``topk_pruned``. A vector without a direction is never
    found and finds nothing.
    """
    q = _vectors(queries, query_id, query_vector, "q")
    c = _vectors(corpus, corpus_id, corpus_vector, "c")
    head = q.limit(max_queries + 1).toArrow()
    if head.num_rows <= max_queries:
        found = _against_all(head, c, k)
    else:
        found, _ = _pruned(q, c, k, max_queries, slice_rows, PIVOTS)
    return _best(found, k)


def topk_pruned(
    queries: DataFrame,
    corpus: DataFrame,
    query_id: str,
    query_vector: str,
    corpus_id: str,
    corpus_vector: str,
    k: int = RESULTS,
    max_queries: int = MAX_QUERIES,
    slice_rows: int = SLICE_ROWS,
    pivots: int = PIVOTS,
) -> DataFrame:
    """(query_id, vec_id, score, rank, compared): the same rows as ``topk_similar``.

    The corpus is cut into one block per pivot, the nearest to each vector. A query
    first meets the nearest blocks that hold k vectors together. By the triangle
    inequality of angles no vector of a block is nearer to it than the block's bound,
    so blocks whose bound is below the k-th score so far are left out, and the rest
    are met. ``compared`` is the number of corpus vectors that the query met: few
    where the vectors lie in clusters, nearly all where they have no structure.

    The pivots are up to ``pivots`` corpus vectors; whichever they are, the result is
    exact. Blocks are joined to bins, large ones cut into slices, of at most about
    ``slice_rows`` vectors. A bin and up to ``QUERY_ROWS`` of its queries meet in a
    task, ``max_queries`` at a time. There are about twice as many such meetings as
    a shuffle has partitions until those sizes are reached, so what is shuffled
    grows as the input does: a vector goes to the square root of their number.
    """
    found, compared = _pruned(
        _vectors(queries, query_id, query_vector, "q"),
        _vectors(corpus, corpus_id, corpus_vector, "c"),
        k,
        max_queries,
        slice_rows,
        pivots,
    )
    return _best(found, k).join(compared, "query_id")


def _best(found: DataFrame, k: int) -> DataFrame:
    ranked = F.row_number().over(
        Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    )
    return found.withColumn("rank", ranked).filter(F.col("rank") <= k)


def _against_all(head: pa.Table, corpus: DataFrame, k: int) -> DataFrame:
    if not head.num_rows:
        return corpus.sparkSession.createDataFrame([], _SCHEMA)
    ids, vectors = head["q_id"].to_numpy(), _matrix(_vector_column(head, "q_vec"))
    shared = corpus.sparkSession.sparkContext.broadcast((ids, vectors))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(*shared.value, k)
        width = best.queries.shape[1]
        for batch in batches:
            best.add(batch.column(0).to_numpy(), _matrix(batch.column(1), width))
        yield pa.RecordBatch.from_pydict(best.table())

    return corpus.mapInArrow(score, _SCHEMA)


def _angles(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ pivots.T, -1.0, 1.0))


def _placed(corpus: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The corpus vectors with a direction, each in the block of its nearest pivot."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(1), pivots.shape[1])
            unit, usable = _normalised(vectors)
            angles = _angles(unit[usable], pivots)
            block = angles.argmin(axis=1)
            yield pa.RecordBatch.from_pydict(
                {
                    "c_id": batch.column(0).filter(pa.array(usable)),
                    "c_vec": batch.column(1).filter(pa.array(usable)),
                    "block": pa.array(block, pa.int32()),
                    "angle": pa.array(angles[np.arange(len(block)), block]),
                }
            )

    vector = corpus.schema["c_vec"].dataType.simpleString()
    return corpus.mapInArrow(
        place, f"c_id bigint, c_vec {vector}, block int, angle double"
    )


def _pruned(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    max_queries: int,
    slice_rows: int,
    pivots: int,
) -> tuple[DataFrame, DataFrame]:
    """Found rows, of which the best k per query count, and vectors met per query."""
    spark = corpus.sparkSession
    pivots = min(pivots, 1 + isqrt(4 * corpus.count()))  # small corpora take few blocks
    head = corpus.orderBy(F.xxhash64("c_id"), "c_id").limit(pivots).toArrow()
    centres = _matrix(_vector_column(head, "c_vec"))
    centres, usable = _normalised(centres)
    centres = centres[usable]
    if not len(centres):
        if corpus.isEmpty() or queries.isEmpty():
            none = spark.createDataFrame([], "query_id bigint, compared bigint")
            return spark.createDataFrame([], _SCHEMA), none
        # no direction among them: one block, whose bound leaves nothing out
        centres = np.eye(1, centres.shape[1])
    placed = written_once(_placed(corpus, centres), "placed")
    sizes, low, high = (
        np.zeros(len(centres), np.int64),
        np.zeros(len(centres)),
        np.zeros(len(centres)),
    )
    rows = placed.groupBy("block").agg(F.count("*"), F.min("angle"), F.max("angle"))
    for block, n, least, most in rows.collect():  # at most one per pivot
        sizes[block], low[block], high[block] = n, least, most

    def blocks(second: bool):
        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                unit, usable = _normalised(_matrix(batch.column(1), centres.shape[1]))
                angles = _angles(unit, centres)
                # the nearest blocks that hold k vectors together
                order = np.argsort(angles, axis=1, kind="stable")
                before = sizes[order].cumsum(axis=1) - sizes[order]
                chosen = np.zeros(angles.shape, bool)
                np.put_along_axis(chosen, order, before < k, axis=1)
                if second:
                    apart = np.maximum(np.maximum(angles - high, low - angles), 0.0)
                    reached = batch.column(2).to_numpy(zero_copy_only=False)
                    chosen = ~chosen & (np.cos(apart) >= reached[:, None] - _SLACK)
                chosen &= (sizes > 0) & usable[:, None]
                yield pa.RecordBatch.from_pydict(
                    {
                        "q_id": batch.column(0),
                        "q_vec": batch.column(1),
                        "blocks": pa.array(
                            [np.flatnonzero(row) for row in chosen], pa.list_(pa.int32())
                        ),
                        "compared": pa.array(chosen @ sizes, pa.int64()),
                    }
                )

        return choose

    vector = queries.schema["q_vec"].dataType.simpleString()
    schema = f"q_id bigint, q_vec {vector}, blocks array<int>, compared bigint"
    near = written_once(queries.mapInArrow(blocks(False), schema), "near")
    first = written_once(
        _meet(near, placed, sizes, k, max_queries, slice_rows), "first"
    )
    best = _best(first, k).groupBy(F.col("query_id").alias("best_id"))
    reached = best.agg(F.count("*").alias("n"), F.min("score").alias("reached"))
    asked = queries.join(
        reached.filter(F.col("n") == k), F.col("q_id") == F.col("best_id"), "left"
    ).select("q_id", "q_vec", F.coalesce("reached", F.lit(-2.0)).alias("reached"))
    far = written_once(asked.mapInArrow(blocks(True), schema), "far")
    found = first.unionByName(
        _meet(far, placed, sizes, k, max_queries, slice_rows)
    )
    compared = near.select("q_id", "compared").unionByName(far.select("q_id", "compared"))
    compared = compared.groupBy(F.col("q_id").alias("query_id"))
    return found, compared.agg(F.sum("compared").alias("compared"))


def _bins(sizes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per block its first bin and how many it fills.

    Neighbouring blocks share a bin of at most `rows` vectors; a larger one is cut
    into slices, each a bin of its own.
    """
    first, count = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    at = filled = 0
    for block, size in enumerate(sizes.tolist()):
        if filled + size > rows and filled:
            at, filled = at + 1, 0
        first[block] = at
        if size > rows:
            count[block] = ceil(size / rows)
            at += int(count[block])
        else:
            filled += size
    return first, count


def _dealt(asked: DataFrame, first: np.ndarray, count: np.ndarray, schema: str) -> DataFrame:
    """A row per query and bin that it asks for, with the blocks it wants there."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _DEALT_ROWS):
                batch = whole.slice(at, _DEALT_ROWS)
                wanted = batch.column(2)
                block = wanted.flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(batch.num_rows), wanted.value_lengths())
                copies = count[block]
                begin = np.cumsum(copies) - copies
                place = np.repeat(first[block] - begin, copies) + np.arange(copies.sum())
                row, block = np.repeat(row, copies), np.repeat(block, copies)
                if not len(row):
                    continue
                # blocks ascend in each list, and bins with them
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1])
                edges = np.flatnonzero(new)
                offsets = pa.array(np.append(edges, len(row)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row[edges])),
                        batch.column(1).take(pa.array(row[edges])),
                        pa.ListArray.from_arrays(offsets, pa.array(block, pa.int32())),
                        pa.array(place[edges], pa.int32()),
                    ],
                    ["q_id", "q_vec", "blocks", "bin"],
                )

    return asked.mapInArrow(deal, schema)


def _meet(
    asked: DataFrame,
    placed: DataFrame,
    sizes: np.ndarray,
    k: int,
    max_queries: int,
    slice_rows: int,
) -> DataFrame:
    """The best k of each bin for each query that asks for blocks of it."""
    spark = placed.sparkSession
    asked = asked.where(F.size("blocks") > 0).select("q_id", "q_vec", "blocks")
    wanted = asked.select(F.explode("blocks").alias("block")).groupBy("block").count()
    counts = {r["block"]: r["count"] for r in wanted.collect()}  # at most one per pivot
    if not counts:
        return spark.createDataFrame([], _SCHEMA)
    blocks = len(sizes)
    asks = np.array([counts.get(b, 0) for b in range(blocks)])
    queries = asked.count()
    met = np.where(asks > 0, sizes, 0)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    side = ceil(sqrt(2 * tasks))
    first, count = _bins(met, min(slice_rows, ceil(int(met.sum()) / side)))
    limit = min(QUERY_ROWS, max(max_queries, ceil(queries / side)))
    of_bin = np.zeros(int((first + count).max()), np.int64)
    for block in range(blocks):
        of_bin[first[block] : first[block] + count[block]] += asks[block]
    parts_of = np.maximum(1, -(-np.minimum(of_bin, queries) // limit))

    def looked_up(values: np.ndarray, column: str):
        return F.get(F.array(*[F.lit(v) for v in values.tolist()]), F.col(column))

    def own(column: str, parts):
        return F.pmod(F.xxhash64(column), parts).cast("int")

    vector = asked.schema["q_vec"].dataType.simpleString()
    schema = f"q_id bigint, q_vec {vector}, blocks array<int>, bin int"
    parts = looked_up(parts_of, "bin")
    left = _dealt(asked, first, count, schema).withColumn("part", own("q_id", parts))
    place = looked_up(first, "block") + own("c_id", looked_up(count, "block"))
    right = (
        placed.filter(F.col("block").isin(sorted(counts)))
        .select("c_id", "c_vec", "block", place.cast("int").alias("bin"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))))
    )

    def score(q: pa.Table, c: pa.Table) -> pa.Table:
        found = [{"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)}]
        if q.num_rows and c.num_rows:
            block = c["block"].to_numpy()
            order = np.argsort(block, kind="stable")
            block, ids = block[order], c["c_id"].to_numpy()[order]
            edges = np.searchsorted(block, np.arange(blocks + 1))
            wide = _matrix(_vector_column(q.slice(0, 1), "q_vec")).shape[1]
            vectors = _matrix(_vector_column(c, "c_vec"), wide)[order]
            for at in range(0, q.num_rows, max_queries):
                some = q.slice(at, max_queries)
                best = _Best(some["q_id"].to_numpy(), _matrix(_vector_column(some, "q_vec"), wide), k)
                lists = _vector_column(some, "blocks")
                asks = np.zeros((some.num_rows, blocks), bool)
                asks[np.repeat(np.arange(some.num_rows), lists.value_lengths()), lists.flatten()] = True
                all_ask = asks.all(axis=0)
                common = all_ask[block]
                best.add(ids[common], vectors[common])
                for b in np.flatnonzero(asks.any(axis=0) & ~all_ask & (edges[1:] > edges[:-1])):
                    here = slice(edges[b], edges[b + 1])
                    best.add(ids[here], vectors[here], np.flatnonzero(asks[:, b]))
                found.append(best.table())
        return pa.table({c: np.concatenate([f[c] for f in found]) for c in found[0]})

    return (
        left.groupBy("bin", "part")
        .cogroup(right.groupBy("bin", "part"))
        .applyInArrow(score, _SCHEMA)
    )
