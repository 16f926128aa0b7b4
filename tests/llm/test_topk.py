import math

import numpy as np
import pytest

from pairloom.llm import topk


def brute(rows, k=20, every=20, steps=64):
    good = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.setdefault(i, []).append([math.floor(x * steps) for x in v])
    out = {}
    for q, own in good.items():
        if q % every:
            continue
        best = {}
        for query in own:
            for i, vectors in good.items():
                for v in vectors:
                    if i != q and len(v) == len(query):
                        best[i] = max(best.get(i, -(2**63)), sum(a * b for a, b in zip(v, query)))
        near = sorted((-s, i) for i, s in best.items())[:k]
        out[q] = [(i, -s) for s, i in near]
    return {q: near for q, near in out.items() if near}


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.id, r.score))
    return out


@pytest.mark.parametrize("options", [{}, {"components": 1024, "least_rows": 8, "fan": 2}])
def test_table_equals_brute_force(spark, sf_dir, options):
    frame = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in frame.collect()])
    assert found(topk.top_k(frame, **options)) == want


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, 0.0]), (20, [1.0, 1.0]), (20, [1.0, 1.0]), (20, [-1.0, 0.3]), (1, None), (2, []), (3, [0.0, 0.0]),
        (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 0.0]), (7, [2.0, 0.0]),
        (9, [1.0, 0.5]), (9, [1.0, 0.5]), (9, [-3.0, 0.0]), (40, [1.0, 2.0, 3.0]), (10, [1.0, 2.0, 3.5]), (60, [1.0]),
        (-20, [0.015624, -0.015624]), (11, [-0.0, 1e-300]),
    ]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id bigint, embedding array<double>, id string, score string")
    got = found(topk.top_k(frame))
    assert got == brute(rows) and 60 not in got and [i for i, _ in got[20]][0] in (7, 9)
    assert found(topk.top_k(frame, k=2, components=2, least_rows=1, fan=2)) == brute(rows, 2)
    assert topk.top_k(frame.limit(0)).collect() == []


def test_ties_and_hot_rows(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal(8).tolist()
    rows = [(i, base if i % 3 == 0 else rng.standard_normal(8).tolist()) for i in range(400)]
    rows += [(40, rng.standard_normal(8).tolist()) for _ in range(150)] + [(41, base)] * 200
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert found(topk.top_k(frame, components=512, least_rows=16, fan=3)) == brute(rows)


@pytest.mark.parametrize("size", [1, 2**9, 2**20, 2**40, 2**62])
def test_products_are_exact(size):
    rng = np.random.default_rng(size % 97)
    a, b = (rng.integers(-size, size + 1, (7, 33), dtype=np.int64) for _ in range(2))
    want = [[max(-(2**63), min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(p, q)))) for q in b] for p in a]
    assert topk.products(a, b).tolist() == want


def test_huge_scores_are_ordered():
    ids = np.arange(1, 6)
    vectors = np.array([[2**40], [2**61], [2**40], [-(2**61)], [5]])
    counts, near, scores = topk.best_of_block(np.array([2]), np.array([[2**20]]), ids, vectors, 3)
    assert counts.tolist() == [3] and near.tolist() == [1, 3, 5] and scores[0] == 2**60
