import pytest
from pyspark.sql import functions as F

from pairloom.operators import sketches as S
from pairloom.session import materialise


@pytest.fixture(scope="module")
def rows(spark):
    hashed = F.pmod(F.xxhash64("id"), F.lit(9000))
    return spark.range(0, 60_000, 1, 6).select(
        (F.col("id") % 3).alias("split"), (F.col("id") % 7).alias("run"), F.concat(F.lit("t"), hashed).alias("text"),
        F.when(F.col("id") % 11 > 0, F.sqrt("id")).alias("score"),
    )


def check(found, rows, keys):
    exact = rows.groupBy(*keys).agg(F.count_distinct("text").alias("d"), F.sort_array(F.collect_list("score")).alias("all"), F.count("*").alias("n"))
    want = {tuple(r[k] for k in keys): r for r in exact.collect()}
    assert {tuple(r[k] for k in keys) for r in found} == set(want)
    for r in found:
        w = want[tuple(r[k] for k in keys)]
        assert r["n"] == w["n"] and abs(r["n_distinct"] / w["d"] - 1) <= S.DISTINCT_ERROR
        for q, value in zip((0.25, 0.5, 0.75), r["quantiles"]):
            rank = sum(x <= value for x in w["all"]) / len(w["all"])
            assert abs(rank - q) <= S.RANK_ERROR + 1 / len(w["all"])


def test_merged_sketches_stay_within_their_errors(spark, rows):
    stored = materialise(S.sketch(rows, ["split", "run"], "text", "score"), "sketches")
    check(S.estimates(stored).collect(), rows, ["split", "run"])
    check(S.estimates(S.merge_sketches(stored, ["split"])).collect(), rows, ["split"])
    whole = S.estimates(S.merge_sketches(stored, [])).collect()
    check(whole, rows, [])


def test_nulls_and_empty_tables(spark):
    frame = spark.createDataFrame([("a", None, None), ("a", None, None), ("b", "x", 1.5)], "k string, text string, score double")
    found = {r["k"]: (r["n"], r["n_distinct"], r["quantiles"]) for r in S.estimates(S.sketch(frame, ["k"], "text", "score")).collect()}
    assert found == {"a": (2, 0, None), "b": (1, 1, [1.5] * 3)}
    assert S.estimates(S.sketch(frame.limit(0), ["k"], "text", "score")).collect() == []
