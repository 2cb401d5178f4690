"""Approximate nearest neighbours by a hierarchical k-means tree."""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.llm import tables
from tallywright.session import ship

ship(__name__)

SAMPLE = 20_000
BRANCHES = 8
LEAF_ROWS = 64  # sampled vectors that a leaf holds at most
RECALL = 0.97
_BLOCK = 8192


@dataclass
class Tree:
    """Nodes by number, the root first; leaves have no children."""

    centres: np.ndarray
    children: list[list[int]] = field(default_factory=list)
    visits: int = 1

    @property
    def leaves(self) -> list[int]:
        return [i for i, c in enumerate(self.children) if not c]

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector: down to the nearest child, level by level."""
        node = np.zeros(len(vectors), np.int64)
        pending = [0] if len(vectors) else []
        while pending:
            here = pending.pop()
            below = self.children[here]
            rows = np.flatnonzero(node == here)
            if not below or not len(rows):
                continue
            node[rows] = np.array(below)[_closest(vectors[rows], self.centres[below])]
            pending += below
        return node

    def best_first(self, query: np.ndarray, visits: int) -> list[int]:
        """The first leaves in order of the inner product with their branch's centre.

        The queue holds all branches passed by; the best of them is opened next.
        """
        worth = self.centres @ query
        queue, found = [(0.0, 0)], []
        while queue and len(found) < visits:
            _, here = heapq.heappop(queue)
            if not self.children[here]:
                found.append(here)
            for child in self.children[here]:
                heapq.heappush(queue, (-float(worth[child]), child))
        return found


def _closest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * rows @ centres.T).argmin(axis=1)


def _kmeans(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = rows[np.sort(rng.choice(len(rows), min(k, len(rows)), replace=False))]
    for _ in range(8):
        near = _closest(rows, centres)
        centres = np.stack(
            [rows[near == i].mean(axis=0) if (near == i).any() else centres[i] for i in range(len(centres))]
        )
    return centres


def _grow(rows: np.ndarray, branches: int, leaf_rows: int) -> Tree:
    rng = np.random.default_rng(7)
    width = rows.shape[1] if rows.ndim == 2 else 0
    centres, children = [rows.mean(axis=0) if len(rows) else np.zeros(width)], [[]]
    pending = [(0, rows)]
    while pending:
        here, own = pending.pop()
        if len(own) <= leaf_rows:
            continue
        found = _kmeans(own, branches, rng)
        near = _closest(own, found)
        parts = [i for i in range(len(found)) if (near == i).any()]
        if len(parts) < 2:
            continue
        for i in parts:
            children[here].append(len(centres))
            pending.append((len(centres), own[near == i]))
            centres.append(found[i])
            children.append([])
    return Tree(np.stack(centres), children)


def _calibrated(tree: Tree, rows: np.ndarray, k: int, recall: float) -> int:
    """Leaves to visit so that sampled queries find the wanted share of neighbours."""
    leaf, leaves = tree.assign(rows), len(tree.leaves)
    found = np.zeros(leaves)
    step = max(1, len(rows) // 200)
    for i in range(0, len(rows), step):
        scores = rows @ rows[i]
        scores[i] = -np.inf
        best = np.argsort(-scores, kind="stable")[: min(k, len(rows) - 1)]
        place = {x: p for p, x in enumerate(tree.best_first(rows[i], leaves))}
        for x in leaf[best]:
            found[place[x]] += 1
    share = np.cumsum(found) / max(1.0, found.sum())
    return min(leaves, int(np.searchsorted(share, recall)) + 1)


def usable(vector: Column) -> Column:
    """Whether a vector takes part: no null or non-finite component, not all zero."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


def _dealt(placed: DataFrame, asked: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """Vectors and visiting queries of each leaf in blocks of about `rows` of each.

    Every block of a leaf's vectors meets every block of its queries, as (block, part).
    """

    def blocks(frame: DataFrame) -> Column:
        counts = {r["leaf"]: r["count"] for r in frame.groupBy("leaf").count().collect()}  # a row per leaf
        large = {n: c for n, c in counts.items() if c > rows}
        if not large:
            return F.lit(1).cast("bigint")
        table = F.create_map(*[F.lit(x) for n, c in large.items() for x in (n, -(-c // rows))])
        return F.coalesce(table[F.col("leaf")], F.lit(1)).cast("bigint")

    own = lambda n, salt: F.pmod(F.xxhash64("head", F.lit(salt)), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
    here, there = blocks(placed), blocks(asked)
    return (
        placed.select("*", own(here, "block").alias("block"), every(there).alias("part")),
        asked.select("*", every(here).alias("block"), own(there, "part").alias("part")),
    )


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    sample: int = SAMPLE,
    recall: float = RECALL,
) -> DataFrame:
    """The k vectors of largest inner product with each query, other than its own row.

    Returns query_id, rank (from 1), vec_id, score (the inner product in double
    precision); ties go to the smaller vec_id. Unusable vectors, and rows without a
    key, take no part; all vectors must have one length. Repeated rows and equal
    vectors are separate candidates, but a row never finds its own key.

    Only different vectors are searched: of equal ones the k + 1 smallest keys are
    kept as candidates, which is all that any result can name, so copies cost nothing.
    The tree is grown on at most about `sample` vectors chosen by a hash, which bounds
    its size, and sent to all tasks. Every vector is put in a leaf.
    How many leaves a query visits, best bin first, is calibrated to the wanted
    recall on the sample, whose neighbours lie farther apart than those of all
    vectors. Large leaves are split into blocks, and so are the queries of frequently
    visited ones, so a task compares a bounded number of either.
    """
    rows = vectors.where(usable(F.col(vector_column)) & F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("bigint").alias("vec_id"),
        F.transform(F.col(vector_column).cast("array<double>"), lambda x: x + 0.0).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asked"),
    )
    order = Window.partitionBy("v").orderBy("vec_id")
    held = rows.select("v", "vec_id").distinct().withColumn("copy", F.row_number().over(order)).where(F.col("copy") <= k + 1)
    asking = rows.where("asked").groupBy("v").agg(F.count(F.lit(1)).alias("asked"))
    listed = held.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    distinct = tables.settled(
        listed.join(asking, "v", "left").select(F.col("ids")[0].alias("head"), "ids", "v", F.col("asked").isNotNull().alias("asked")),
        "vectors",
    )
    total = distinct.count()
    share = min(1.0, sample / max(1, total))
    chosen = (
        distinct.where(F.pmod(F.xxhash64("head"), F.lit(1 << 30)) < share * (1 << 30)).select("head", "v").toPandas().sort_values("head")
    )
    base = np.stack(chosen["v"].to_list()) if len(chosen) else np.zeros((0, 1))
    tree = _grow(base, BRANCHES, LEAF_ROWS)
    tree.visits = _calibrated(tree, base, k, recall) if len(base) > 1 else len(tree.leaves)

    def put(batches):
        for batch in batches:
            leaf = tree.assign(_matrix(batch.column("v")))
            yield pa.RecordBatch.from_arrays([batch.column("head"), batch.column("v"), pa.array(leaf)], ["head", "v", "leaf"])

    def visit(batches):
        for batch in batches:
            found = [tree.best_first(q, tree.visits) for q in _matrix(batch.column("v"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("head"), batch.column("v"), pa.array(found, pa.list_(pa.int64()))],
                ["head", "v", "leaves"],
            )

    shape = "head bigint, v array<double>, leaf bigint"
    placed = distinct.select("head", "v").mapInArrow(put, shape)
    asked = tables.settled(
        distinct.where("asked").select("head", "v").mapInArrow(visit, "head bigint, v array<double>, leaves array<bigint>"),
        "visits",
    ).select("head", "v", F.explode("leaves").alias("leaf"))
    placed, asked = _dealt(placed, asked, _BLOCK)
    best = k + 1

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": pd.Series(dtype="int64"), "head": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        corpus, names = np.stack(left["v"].to_list()), left["head"].to_numpy()
        order = np.argsort(names)
        corpus, names = corpus[order], names[order]
        out = []
        for at in range(0, len(right), 512):
            part = right.iloc[at : at + 512]
            scores = np.stack(part["v"].to_list()) @ corpus.T
            kept = min(best, len(names))
            floor = np.partition(scores, -kept, axis=1)[:, -kept]
            row, col = np.nonzero(scores >= floor[:, None] - 1e-9)
            # a score must not depend on the block that it is made in
            queries = np.stack(part["v"].to_list())
            exact = (queries[row] * corpus[col]).sum(axis=1)
            rank = np.lexsort((names[col], -exact, row))
            row, col, exact = row[rank], col[rank], exact[rank]
            within = np.arange(len(row)) - np.searchsorted(row, row)
            take = within < best
            out.append(pd.DataFrame({"query": part["head"].to_numpy()[row[take]], "head": names[col[take]], "score": exact[take]}))
        return pd.concat(out)

    pairs = (
        placed.groupBy("leaf", "block", "part")
        .cogroup(asked.groupBy("leaf", "block", "part"))
        .applyInPandas(compare, "query bigint, head bigint, score double")
    )
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "head")
    top = pairs.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= best)
    # equal vectors share a score: their keys compete one by one
    single = top.join(distinct.select("head", "ids"), "head").select("query", "score", F.explode("ids").alias("vec_id"))
    by_key = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    single = single.withColumn("place", F.row_number().over(by_key)).where(F.col("place") <= best)
    heads = distinct.where("asked").select(F.col("head").alias("query"), "v")
    queries = rows.where("asked").select(F.col("vec_id").alias("query_id"), "v").distinct().join(heads, "v").select("query_id", "query")
    ranked = Window.partitionBy("query_id").orderBy("place")
    return (
        queries.join(single, "query")
        .where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
