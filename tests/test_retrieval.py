"""Nearest vectors against brute force."""

from __future__ import annotations

import numpy as np

from weftline.operators import retrieval
from weftline.plans import match_queries

SCHEMA_Q, SCHEMA_I = "query long, buckets array<string>, vector array<double>", "id long, bucket string, vector array<double>"


def brute(queries, items, k):
    out = {}
    norm = lambda v: np.array(v) / np.linalg.norm(v)
    good = [(i, b, norm(v)) for i, b, v in items if v and np.linalg.norm(v) > 0]
    for q, buckets, v in queries:
        for b in buckets:
            scored = sorted((-round(float(norm(v) @ w), 12), i) for i, c, w in good if c == b)
            out.update({(q, b, i): -s for s, i in scored[:k]})
    return out


def test_exact_search_and_parts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    items = [(i, "ab"[i % 3 == 0], rng.normal(size=6).round(2).tolist()) for i in range(400)] + [(900 + i, "a", [1.0] + [0.0] * 5) for i in range(30)]
    items += [(990, "a", [0.0] * 6), (991, "b", None), (992, "b", [])]
    queries = [(q, ["a", "b"][: 1 + q % 2], rng.normal(size=6).tolist()) for q in range(9)] + [(50, ["a", "zzz"], [2.0] + [0.0] * 5)]
    q, i = spark.createDataFrame(queries, SCHEMA_Q), spark.createDataFrame(items, SCHEMA_I)
    want = brute(queries, items, 12)
    for part, block in ((20_000, 2000), (37, 3)):
        monkeypatch.setattr(retrieval, "PART_ROWS", part)
        monkeypatch.setattr(retrieval, "BLOCK_ROWS", block)
        got = {(r.query, r.bucket, r.id): r.similarity for r in retrieval.search(q, i, 12).collect()}
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
    # equal vectors: the smallest ids
    assert sorted(x for qq, b, x in want if qq == 50) == list(range(900, 912))
    assert retrieval.search(q.limit(0), i, 3).count() == 0 and retrieval.search(q, i.limit(0), 3).count() == 0
    index = retrieval.Index.fit(retrieval.unit(i.limit(0)), 3)
    assert retrieval.search(q, i.limit(0), 3, index).count() == 0


def test_merge_takes_the_maximum(spark):
    rows = [(1, "a", 7, 0.5), (1, "b", 7, 0.9), (1, "a", 8, 0.6), (1, "b", 9, 0.1)]
    got = [(r.id, r.similarity, r.place) for r in retrieval.merged(spark.createDataFrame(rows, "query long, bucket string, id long, similarity double"), 2).orderBy("place").collect()]
    assert got == [(7, 0.9, 1), (8, 0.6, 2)]


def test_index_looks_into_few_cells_where_vectors_cluster(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 4
    items = [(i, "x", (centres[i % 40] + rng.normal(size=16)).tolist()) for i in range(2000)]
    i = spark.createDataFrame(items, SCHEMA_I)
    q = spark.createDataFrame([(r[0], ["x"], r[2]) for r in items[::50]], SCHEMA_Q)
    index = retrieval.Index.fit(retrieval.unit(i), 10, recall=0.97)
    assert index.probes <= len(index.centres) // 4
    assert retrieval.recall(retrieval.search(q, i, 10, index), retrieval.search(q, i, 10)) >= 0.95


def test_index_reaches_its_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    found, exact = match_queries.nearest_indexed(spark, sf), match_queries.nearest_exact(spark, sf)
    assert retrieval.recall(found, exact) >= 0.95


def test_search_multiplies_in_steps(spark, monkeypatch):
    rng = np.random.default_rng(5)
    items = [(i, "ab"[i % 2], rng.normal(size=4).round(1).tolist()) for i in range(120)]
    queries = [(q, ["a", "b"], rng.normal(size=4).tolist()) for q in range(11)]
    want = brute(queries, items, 7)
    monkeypatch.setattr(retrieval, "STEP_ROWS", 3)
    found = retrieval.search(spark.createDataFrame(queries, SCHEMA_Q), spark.createDataFrame(items, SCHEMA_I), 7)
    got = {(r.query, r.bucket, r.id): r.similarity for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
