import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators import negatives as N
from pairloom.session import materialise


def triplets(spark, n, copies=1):
    return spark.range(n).select(
        F.col("id").alias("row_key"),
        F.concat(F.lit("a"), F.col("id") % copies).alias("anchor"),
        F.concat(F.lit("p"), "id").alias("positive"),
        F.concat(F.lit("n"), "id").alias("negative"),
    )


@pytest.mark.parametrize("n,m", [(0, 3), (1, 3), (2, 3), (5, 3), (4, 7), (60, 7)])
def test_draws_are_distinct_others(spark, n, m):
    rows = N.random_negatives(triplets(spark, n), m).collect()
    by_key = {}
    for r in rows:
        by_key.setdefault(r["row_key"], []).append(r["neg_key"])
        assert r["neg_positive"] == f"p{r['neg_key']}" and r["neg_negative"] == f"n{r['neg_key']}"
    expected = min(m, n - 1) if n > 1 else 0
    assert len(by_key) == (n if expected else 0)
    for key, drawn in by_key.items():
        assert key not in drawn and len(set(drawn)) == len(drawn) == expected


def test_draws_depend_on_the_seed_only(spark):
    base = sorted(N.random_negatives(triplets(spark, 50), 3).collect())
    assert base == sorted(N.random_negatives(triplets(spark, 50).repartition(7), 3).collect())
    assert base != sorted(N.random_negatives(triplets(spark, 50), 3, seed=1).collect())


def test_same_anchor_can_be_excluded(spark):
    frame = triplets(spark, 40, copies=2)
    rows = N.random_negatives(frame, 6, exclude_same_anchor=True).collect()
    assert rows and all(r["row_key"] % 2 != r["neg_key"] % 2 for r in rows)
    lists = N.candidate_docs(frame, 8, exclude_same_anchor=True).collect()
    assert len(lists) == 40 and all(len(r["docs"]) == 8 for r in lists)


@pytest.mark.parametrize("k", [2, 3, 4, 7, 8, 16])
@pytest.mark.parametrize("n", [1, 2, 30])
@pytest.mark.parametrize("mining", [True, False])
def test_lists_have_exactly_k(spark, n, k, mining):
    rows = N.candidate_docs(triplets(spark, n), k, mining=mining).collect()
    assert len(rows) == n
    for r in rows:
        docs = r["docs"]
        assert len(docs) == k
        assert docs[0]["passage"] == f"p{r['row_key']}" and docs[0]["origin"] == "positive"
        assert docs[1]["passage"] == f"n{r['row_key']}" and docs[1]["origin"] == "negative"
        if n == 30 and mining:
            assert len({d["passage"] for d in docs}) == k
            assert not any(d["origin"] == "repeat" for d in docs)


def test_fill_is_all_or_nothing(spark):
    frame = triplets(spark, 3)
    lists = N.query_lists(frame, 0)
    pool = N.passage_pool(frame, total="n_pool")
    for r in N.fill_candidates(lists, pool, 6).collect():
        assert len({d["passage"] for d in r["docs"]}) == 6
    # Six passages in the pool, two of them the list's own: five cannot be added.
    for r in N.repeat_candidates(N.fill_candidates(lists, pool, 7), 7).collect():
        assert [d["passage"] for d in r["docs"]] == [r["docs"][i % 2]["passage"] for i in range(7)]
        assert [d["origin"] for d in r["docs"]][2:] == ["repeat"] * 5


def test_pool_is_distinct_and_dense(spark):
    frame = triplets(spark, 9).withColumn("negative", F.lit("same"))
    rows = N.passage_pool(frame).collect()
    assert sorted(r["pid"] for r in rows) == list(range(10))
    assert {r["passage"] for r in rows} == {f"p{i}" for i in range(9)} | {"same"}


def test_lists_take_any_passage_type_and_carry_columns(spark):
    frame = triplets(spark, 20).withColumns(
        {"positive": F.array(F.col("row_key") + 0.5), "negative": F.array(-0.5 - F.col("row_key"))}
    )
    rows = N.candidate_lists(frame, 6, carry=["anchor"]).collect()
    assert len(rows) == 120
    assert all(r["anchor"] == "a0" for r in rows)
    assert {r["passage"][0] for r in rows if r["slot"] == 0} == {i + 0.5 for i in range(20)}
    odd = N.candidate_docs(frame, 7).collect()
    assert all(len({d["passage"][0] for d in r["docs"]}) == 7 for r in odd)


def test_stats(spark):
    lists = N.query_lists(triplets(spark, 10), 2)
    exact = N.candidate_stats(lists).first()
    assert tuple(exact) == (10, 6.0, 20)
    rough = N.candidate_stats(lists, approximate=True).first()
    assert rough["n_queries"] == 10 and 18 <= rough["n_passages"] <= 22


def test_fill_copes_with_missing_passages(spark):
    rows = [(i, f"a{i}", f"p{i}", None if i % 2 else f"n{i}") for i in range(12)]
    frame = spark.createDataFrame(rows, "row_key long, anchor string, positive string, negative string")
    lists = N.candidate_lists(frame, 6, m=0).collect()
    for key in range(12):
        found = [r for r in lists if r["row_key"] == key]
        assert sorted(r["slot"] for r in found) == list(range(6))
        assert [r["origin"] for r in sorted(found, key=lambda r: r["slot"])][2:] == ["pool"] * 4


def test_fill_leaves_out_positives_of_the_own_anchor(spark):
    rows = [(i, f"a{i % 3}", f"p{i}", f"n{i}") for i in range(30)]
    frame = spark.createDataFrame(rows, "row_key long, anchor string, positive string, negative string")
    lists = N.candidate_lists(frame, 8, exclude_same_anchor=True).collect()
    own = {a: {r[2] for r in rows if r[1] == a} for a in ("a0", "a1", "a2")}
    assert len(lists) == 240
    for r in lists:
        assert r["slot"] == 0 or r["passage"] not in own[f"a{r['row_key'] % 3}"]


def test_fill_looks_at_the_whole_pool(spark):
    # 60 positives of the own anchor are barred, 15 negatives of other rows are not
    rows = [(i, "a", f"p{i}", f"n{i % 15}") for i in range(60)]
    frame = spark.createDataFrame(rows, "row_key long, anchor string, positive string, negative string")
    for row in N.candidate_docs(frame, 12, exclude_same_anchor=True).collect():
        passages = [d["passage"] for d in row["docs"]]
        assert len(set(passages)) == 12 and not {p for p in passages[1:] if p.startswith("p")}
    short = N.candidate_docs(frame, 17, exclude_same_anchor=True).collect()
    assert all(d["origin"] == "repeat" for r in short for d in r["docs"][2:])


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_ranks_skip_barred_positions(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    rng = random.Random(block)
    pool = spark.createDataFrame([(i, f"p{i}") for i in range(40)], "pid bigint, passage string")
    barred = {a: set(rng.sample(range(40), n)) for a, n in ((1, 0), (2, 1), (3, 20), (4, 39), (5, 12))}
    barred[6] = set(range(10, 35))
    table = spark.createDataFrame([(a, f"p{i}") for a, s in barred.items() for i in s], "anchor bigint, passage string")
    shifts, counts = N._shifts(table, pool)
    assert {r["anchor"]: r["n_barred"] for r in counts.collect()} == {a: len(s) for a, s in barred.items() if s}
    ranks = [(a, a, r, r) for a, s in barred.items() for r in range(40 - len(s))]
    asked = spark.createDataFrame(ranks, "row_key bigint, anchor bigint, step bigint, rank bigint")
    found = {(r["row_key"], r["step"]): r["pid"] for r in N._positions(asked, shifts, "row_key").collect()}
    assert found == {(a, i): p for a, s in barred.items() for i, p in enumerate(sorted(set(range(40)) - s))}


def test_ranks_of_barred_fills_are_computed_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(N, "materialise", lambda df, name: written.append(name) or materialise(df, name))
    rows = [(i, f"a{i % 3}", f"p{i}", f"n{i}") for i in range(30)]
    table = spark.createDataFrame(rows, "row_key long, anchor string, positive string, negative string")
    lists = N.candidate_lists(table, 9, exclude_same_anchor=True).collect()
    assert len(lists) == 270 and {"ranks", "shifts", "barred-blocks"} <= set(written)
    barred = {f"a{k}": {f"p{i}" for i in range(k, 30, 3)} for k in range(3)}
    assert not any(r.slot and r.passage in barred[f"a{r.row_key % 3}"] for r in lists)
