import math

import numpy as np
import pytest

from pairloom.llm import neighbours


def brute(rows, k=5, every=50):
    """Every query's k nearest by exact cosine."""
    good = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        good.setdefault(i, []).append(np.array(v, dtype=np.float64))
    out = {}
    for q, own in good.items():
        if q % every:
            continue
        scores = []
        for i, vectors in good.items():
            fit = [(v, query) for v in vectors for query in own if len(v) == len(query)]
            if i != q and fit:
                scores.append((-max(float((v * query).sum() / (math.sqrt((v * v).sum()) * math.sqrt((query * query).sum()))) for v, query in fit), i))
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.id, r.score))
    return out


def recall(got, want):
    hits = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in near}) for q, near in want.items())
    return hits / max(1, sum(map(len, want.values())))


@pytest.mark.parametrize("block", [32768, 100])
def test_recall_on_the_table(spark, sf_dir, block):
    frame = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in frame.collect()])
    got = found(neighbours.nearest(frame, block=block, chunk=4))
    assert recall(got, want) >= 0.95
    assert all(len(near) == 5 for near in got.values())
    for q, near in got.items():
        exact = dict(want[q])
        assert all(abs(exact[i] - s) < 1e-12 for i, s in near if i in exact)
        assert [s for _, s in near] == sorted((s for _, s in near), reverse=True)


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, 0.0]), (50, [1.0, 1.0]), (50, [1.0, 1.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0]),
        (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 0.0]), (7, [2.0, 0.0]), (8, [3.0, 0.0]),
        (9, [1.0, 0.5]), (9, [1.0, 0.5]), (100, [1.0, 2.0, 3.0]), (10, [1.0, 2.0, 3.5]), (150, [1.0]),
    ]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = found(neighbours.nearest(frame))
    want = brute(rows)
    assert {q: [i for i, _ in near] for q, near in got.items()} == {q: [i for i, _ in near] for q, near in want.items() if near}
    assert 150 not in got


def test_every_vector_of_a_query_id_is_asked(spark):
    rng = np.random.default_rng(4)
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [0.01, 1.0]), (2, [1.0, 0.02]), (100, [0.0, 1.0, 1.0]), (100, [-1.0, 0.0])]
    rows += [(1000 + i, [-1.0 - float(x), -1.0]) for i, x in enumerate(rng.random(30)) if (1000 + i) % 50]
    got = found(neighbours.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")))
    want = brute(rows)
    assert [i for i, _ in got[50]][:2] == [1, 2]
    assert {q: [i for i, _ in near] for q, near in got.items()} == {q: [i for i, _ in near] for q, near in want.items()}


def test_copies_and_empty_table(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal(16)
    rows = [(i, (base if i % 3 == 0 else rng.standard_normal(16)).tolist()) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got, want = found(neighbours.nearest(frame)), brute(rows)
    assert [i for i, _ in got[0]] == [i for i, _ in want[0]] == [3, 6, 9, 12, 15]
    assert recall(got, want) >= 0.9
    assert neighbours.nearest(frame.limit(0)).collect() == []
