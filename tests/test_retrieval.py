"""Nearest vectors against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from tallywright.operators import retrieval


def brute_force(queries, corpus, k):
    found = set()
    for qi, q in queries.items():
        if not any(q):
            continue
        scored = []
        for ci, c in corpus.items():
            length = np.linalg.norm(q) * np.linalg.norm(c)
            if length > 0:
                scored.append((-round(float(np.dot(q, c) / length), 12), ci))
        for rank, (score, ci) in enumerate(sorted(scored)[:k], 1):
            found.add((qi, ci, rank, round(-score, 9)))
    return found


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(7)
    corpus = {i: rng.normal(size=8).tolist() for i in range(400)}
    for i in range(100, 230):  # a third of the corpus are copies of one vector
        corpus[i] = [3.0 * x for x in corpus[5]]
    corpus[7] = [0.0] * 8
    queries = {i: rng.normal(size=8).tolist() for i in range(37)}
    queries[3], queries[4] = corpus[5], [0.0] * 8
    return queries, corpus


def frame(spark, vectors):
    return spark.createDataFrame(list(vectors.items()), "id bigint, v array<double>")


@pytest.mark.parametrize("k", [1, 3, 50])
@pytest.mark.parametrize("limits", [{}, {"max_queries": 5, "slice_rows": 60}])
def test_matches_brute_force(spark, vectors, k, limits):
    queries, corpus = vectors
    found = retrieval.topk_similar(
        frame(spark, queries),
        frame(spark, corpus).repartition(6),
        "id",
        "v",
        "id",
        "v",
        k=k,
        **limits,
    )
    got = {
        (r["query_id"], r["vec_id"], r["rank"], round(r["score"], 9))
        for r in found.collect()
    }
    assert got == brute_force(queries, corpus, k)


def test_small_and_empty_sides(spark, vectors):
    queries, corpus = vectors
    few = dict(list(corpus.items())[:2])
    found = retrieval.topk_similar(
        frame(spark, queries), frame(spark, few), "id", "v", "id", "v", k=3
    )
    assert found.groupBy("query_id").count().select("count").distinct().collect() == [(2,)]
    for q, c in ((frame(spark, queries).limit(0), frame(spark, corpus)),
                 (frame(spark, queries), frame(spark, corpus).limit(0))):
        assert retrieval.topk_similar(q, c, "id", "v", "id", "v").count() == 0


def test_vectors_of_unequal_width_are_refused(spark):
    q = frame(spark, {1: [1.0, 0.0]})
    c = frame(spark, {1: [1.0, 0.0], 2: [1.0, 0.0, 0.0], 3: [1.0]})
    with pytest.raises(Exception, match="vectors must have 2 elements"):
        retrieval.topk_similar(q, c, "id", "v", "id", "v").collect()


@pytest.mark.parametrize("pivots", [1, 6, 400])
def test_pruned_search_is_exact(spark, vectors, pivots):
    queries, corpus = vectors
    sides = frame(spark, queries), frame(spark, corpus).repartition(6), "id", "v", "id", "v"
    found = retrieval.topk_pruned(*sides, k=4, max_queries=5, slice_rows=60, pivots=pivots).collect()
    got = {(r["query_id"], r["vec_id"], r["rank"], round(r["score"], 9)) for r in found}
    assert got == brute_force(queries, corpus, 4)
    assert all(4 <= r["compared"] <= len(corpus) for r in found)


def test_pruning_leaves_far_clusters_out(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    corpus = {i: (centres[i % 20] + 0.05 * rng.normal(size=16)).tolist() for i in range(1000)}
    queries = {i: corpus[i] for i in range(0, 1000, 10)}
    sides = frame(spark, queries), frame(spark, corpus), "id", "v", "id", "v"
    found = retrieval.topk_pruned(*sides, pivots=100, max_queries=30).collect()
    got = {(r["query_id"], r["vec_id"], r["rank"], round(r["score"], 9)) for r in found}
    assert got == brute_force(queries, corpus, 3)
    assert sum(r["compared"] for r in found) < 0.2 * 1000 * len(found)


def test_pruned_search_without_any_direction(spark):
    zeros = frame(spark, {i: [0.0, 0.0] for i in range(5)})
    some = frame(spark, {1: [1.0, 0.0], 2: [0.0, 0.0]})
    late = frame(spark, {**{i: [0.0, 0.0] for i in range(5)}, 9: [0.0, 2.0]})
    assert retrieval.topk_pruned(some, zeros, "id", "v", "id", "v").count() == 0
    for pivots in (1, 2, 9):
        found = retrieval.topk_pruned(some, late, "id", "v", "id", "v", pivots=pivots).collect()
        assert [(r["query_id"], r["vec_id"], r["score"]) for r in found] == [(1, 9, 0.0)]
    assert retrieval.topk_pruned(zeros, late, "id", "v", "id", "v").count() == 0
    assert retrieval.topk_pruned(some.limit(0), late, "id", "v", "id", "v").count() == 0
    assert retrieval.topk_pruned(some, late.limit(0), "id", "v", "id", "v").count() == 0


def test_few_copies_of_vectors_are_shuffled(spark, monkeypatch):
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    rng = np.random.default_rng(11)
    corpus = {i: rng.normal(size=8).tolist() for i in range(800)}  # nothing to leave out
    met, apply = [], PandasCogroupedOps.applyInArrow
    monkeypatch.setattr(
        PandasCogroupedOps,
        "applyInArrow",
        lambda ops, *args: met.append(ops._gd1._df.count() + ops._gd2._df.count()) or apply(ops, *args),
    )
    sides = frame(spark, corpus), frame(spark, corpus), "id", "v", "id", "v"
    found = retrieval.topk_pruned(*sides, pivots=40, max_queries=10).collect()
    got = {(r["query_id"], r["vec_id"], r["rank"], round(r["score"], 9)) for r in found}
    assert got == brute_force(corpus, corpus, 3)
    assert sum(met) < 20 * len(corpus)
