import math

import pytest
from pyspark.sql import functions as F

from pairloom.operators import ordering


def numbers(spark, n, partitions=3):
    return spark.range(0, n, 1, partitions).select(F.col("id").alias("row_key"))


def rank_by_hash(spark, n, seed):
    rows = numbers(spark, n).withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), "row_key"))).collect()
    return {r["row_key"]: i for i, r in enumerate(sorted(rows, key=lambda r: r["h"]))}


@pytest.mark.parametrize("n", [0, 1, 2, 700])
def test_dense_index_is_the_global_rank(spark, n):
    found = ordering.dense_index(numbers(spark, n), total="n").collect()
    assert {r["row_key"]: r["idx"] for r in found} == rank_by_hash(spark, n, "42")
    assert all(r["n"] == n for r in found)


def test_dense_index_ignores_partitioning(spark):
    a = ordering.dense_index(numbers(spark, 500, 1)).collect()
    b = ordering.dense_index(numbers(spark, 500, 7).orderBy(F.col("row_key").desc())).collect()
    assert sorted(a) == sorted(b)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 9, 10, 11, 101, 1234])
def test_split_sizes(spark, n):
    found = ordering.split_exact(numbers(spark, n)).collect()
    held = math.ceil(0.2 * n)
    test = math.ceil(0.5 * held)
    sizes = {s: sum(r["split"] == s for r in found) for s in ("train", "val", "test")}
    assert sizes == {"train": n - held, "val": held - test, "test": test}
    assert len({r["row_key"] for r in found}) == n


def test_split_follows_rank_and_seed(spark):
    rank = rank_by_hash(spark, 1234, "42")
    found = {r["row_key"]: r["split"] for r in ordering.split_exact(numbers(spark, 1234)).collect()}
    assert all((found[k] == "train") == (rank[k] < 1234 - 247) for k in found)
    other = {
        r["row_key"]: r["split"]
        for r in ordering.split_exact(numbers(spark, 1234), seed=7).collect()
    }
    assert other != found


@pytest.mark.parametrize("n", [0, 1, 99, 400, 500])
def test_sample_is_exact(spark, n):
    found = [r["row_key"] for r in ordering.sample_n(numbers(spark, 400), n).collect()]
    rank = rank_by_hash(spark, 400, "42")
    assert sorted(found) == sorted(k for k in rank if rank[k] < n)


def test_exact_split_of_groups(spark):
    rows = numbers(spark, 400).withColumn(
        "anchor", F.when(F.col("row_key") % 3 == 0, 0).otherwise(F.col("row_key") % 100)
    )
    found = ordering.split_exact(rows, group_key="anchor")
    groups = found.groupBy("anchor").agg(F.collect_set("split").alias("splits")).collect()
    assert len(groups) == 100 and all(len(r["splits"]) == 1 for r in groups)
    assert sorted(r["splits"][0] for r in groups) == ["test"] * 10 + ["train"] * 80 + ["val"] * 10
    assert found.count() == 400


def test_hash_split_keeps_groups_and_shares(spark):
    rows = numbers(spark, 5000).withColumn("anchor", F.col("row_key") % 2500)
    found = ordering.split_hash(rows, group_key="anchor")
    assert found.groupBy("anchor").agg(F.countDistinct("split").alias("c")).where("c > 1").isEmpty()
    train = found.where("split = 'train'").count()
    assert 0.77 < train / 5000 < 0.83


def test_versions_share_val_and_test(spark):
    rows = numbers(spark, 620).withColumn(
        "source_kind", F.when(F.col("row_key") < 500, "supervised").otherwise("detailed")
    )
    table = ordering.split_versions(rows)
    sizes = {
        (r["data_version"], r["split"]): r["count"]
        for r in table.groupBy("data_version", "split").count().collect()
    }
    assert sizes == {
        ("supervised_only", "train"): 400, ("supervised_only", "val"): 50,
        ("supervised_only", "test"): 50, ("supervised_with_detailed", "train"): 520,
        ("supervised_with_detailed", "val"): 50, ("supervised_with_detailed", "test"): 50,
    }
    held = table.where("split <> 'train'")
    only = held.where("data_version = 'supervised_only'").select("row_key", "split")
    both = held.where("data_version <> 'supervised_only'").select("row_key", "split")
    assert sorted(only.collect()) == sorted(both.collect())
    # 120 detailed rows at the end of the combined table: the same rows as its last 120.
    added = table.where("source_kind = 'detailed'").select("row_key").collect()
    assert sorted(r["row_key"] for r in added) == list(range(500, 620))


def test_batches_are_full_but_the_last(spark):
    found = ordering.assign_batches(numbers(spark, 103), 10, epoch=1)
    sizes = [r["count"] for r in found.groupBy("batch_id").count().orderBy("batch_id").collect()]
    assert sizes == [10] * 10 + [3]
    again = ordering.assign_batches(numbers(spark, 103), 10, epoch=2)
    assert sorted(found.collect()) != sorted(again.collect())
