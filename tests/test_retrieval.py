import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import retrieval as R
from pairloom.session import shared_path


def exact(rows, queries, k, barred=()):
    ids = [i for i, _ in rows]
    data = np.array([v for _, v in rows]) / np.linalg.norm([v for _, v in rows], axis=1, keepdims=True)
    out = {}
    for q, v in queries:
        scores = data @ (np.array(v) / np.linalg.norm(v))
        order = sorted((-s, i) for s, i in zip(scores, ids) if (q, i) not in barred)
        out[q] = [i for _, i in order[:k]]
    return out


def ids_of(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r[0], r["rank"])):
        out.setdefault(r[0], []).append(r[2])
        assert r["rank"] == len(out[r[0]])
    return out


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((12, 16)) * 3
    return [(i, (centres[i % 12] + rng.standard_normal(16)).tolist()) for i in range(900)]


def frame_of(spark, rows):
    return spark.createDataFrame(rows, "id bigint, vector array<double>")


def test_small_tables_are_searched_exactly(spark, clustered):
    table = frame_of(spark, clustered)
    index = R.build_index(table, shared_path(spark, "index"))
    assert index.cells == 1
    queries = clustered[::30]
    assert ids_of(R.search(index, frame_of(spark, queries), 5)) == exact(clustered, queries, 5)


def test_probed_cells_reach_the_recall_and_others_are_not_read(spark, clustered):
    path = shared_path(spark, "index")
    built = R.build_index(frame_of(spark, clustered), path, rows_per_cell=40, part_rows=25)
    index = R.open_index(spark, path)
    assert index.cells == built.cells > 12 and np.array_equal(index.centroids, built.centroids) and index.parts.max() > 1
    queries = clustered[::9]
    found = R.search(index, frame_of(spark, queries), 5, probes=6, chunk=10)
    want = exact(clustered, queries, 5)
    wanted = spark.createDataFrame([(q, i) for q, near in want.items() for i in near], "query_id bigint, id bigint")
    assert 0.9 <= R.recall(found, wanted)
    assert ids_of(R.search(index, frame_of(spark, queries), 5, probes=index.cells, chunk=10)) == want
    assert index.rows(spark).count() == 900
    plan = index.rows(spark, [1, 2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan


def test_barred_pairs_leave_the_next_best(spark, clustered):
    index = R.build_index(frame_of(spark, clustered), shared_path(spark, "index"), rows_per_cell=100, part_rows=30)
    queries = clustered[:6]
    near = exact(clustered, queries, 60)
    barred = {(q, i) for q, found in near.items() for i in found[:50:2]}
    table = spark.createDataFrame(sorted(barred), "query_id bigint, id bigint")
    found = R.search(index, frame_of(spark, queries), 5, probes=99, barred=table, chunk=4)
    assert ids_of(found) == exact(clustered, queries, 5, barred)


def test_odd_vectors_and_empty_tables(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [0.0, 2.0]), (None, [1.0, 1.0]), (8, [3.0, 0.0])]
    index = R.build_index(frame_of(spark, rows), shared_path(spark, "index"))
    assert ids_of(R.search(index, frame_of(spark, [(1, [2.0, 0.1]), (2, None)]), 5)) == {1: [1, 8, 7]}
    empty = R.build_index(frame_of(spark, []), shared_path(spark, "index"))
    assert R.search(empty, frame_of(spark, [(1, [1.0])]), 5).collect() == []
    assert R.search(index, frame_of(spark, []), 5).collect() == []


def test_mined_negatives_skip_positives_of_the_anchor(spark):
    rng = np.random.default_rng(1)
    vectors = {f"t{i}": rng.standard_normal(8).tolist() for i in range(40)}
    rows = [(i, f"t{i % 10}", f"t{10 + i * 7 % 30}") for i in range(80)]
    frame = spark.createDataFrame(
        [(i, a, p, vectors[a], vectors[p]) for i, a, p in rows],
        "row_key bigint, anchor string, positive string, anchor_vector array<double>, positive_vector array<double>",
    )
    first = {}
    for i, _, p in rows:
        first.setdefault(p, i)
    found = ids_of(R.mined_negatives(frame, 4, shared_path(spark, "mined")))
    passages = [(first[p], vectors[p]) for p in first]
    for i, a, _ in rows:
        own = {(i, first[p]) for _, b, p in rows if a == b}
        assert found[i] == exact(passages, [(i, vectors[a])], 4, own)[i]


def test_top_k_passes_on_k_rows_a_task(spark):
    frame = spark.range(0, 1000, 1, 4).select((F.col("id") % 3).alias("key"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("score"), "id")
    best = R.top_k(frame, ["key"], [F.col("score").desc(), F.col("id")], 5)
    rows = [tuple(r) for r in frame.collect()]
    want = sorted((k, s, i, n + 1) for key in range(3) for n, (k, s, i) in enumerate(sorted([r for r in rows if r[0] == key], key=lambda r: (-r[1], r[2]))[:5]))
    assert sorted(tuple(r) for r in best.collect()) == want
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.rindex("Partial")
