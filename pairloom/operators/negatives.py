"""Random negatives, the passage pool and fixed-size candidate lists.

The passage columns may hold text, ids or vectors: nothing here looks inside them, so a
caller that only needs keys or vectors never moves the texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.functions.hashing import hash_bigint, seeded_hash
from pairloom.operators.ordering import dense_index
from pairloom.operators.skew import salted_join
from pairloom.schema import require_columns
from pairloom.session import materialise


def negative_pairs(k: int) -> int:
    """Rows to draw per query so that two passages of each fill a list of k."""
    return max(0, (k - 2) // 2)


def _consecutive(start: Column, count: Column) -> Column:
    """`count` numbers from `start`. Exploding them keeps the hash behind `start` to one
    evaluation per row instead of one per number."""
    return F.when(count > 0, F.sequence(start, start + count - 1)).otherwise(
        F.array().cast("array<bigint>")
    )


def drawn_keys(df: DataFrame, m: int, seed: int | str = 42, key: str = "row_key") -> DataFrame:
    """(row_key, draw, neg_key): min(m, N-1) other rows per row, without replacement.

    Rows get a dense seeded index; row i draws the m positions after a hashed start in the
    circle of the other N-1 rows, and an equi-join on the index turns positions into keys.
    Only keys are moved, and every row is drawn about m times: there are no hot keys.
    """
    indexed = dense_index(require_columns(df, [key]).select(key), key, seed, "idx", total="n")
    others = F.col("n") - 1
    start = F.pmod(hash_bigint(seeded_hash(seed, F.lit("negatives"), key)), others)
    steps = _consecutive(start, F.least(F.lit(m).cast("bigint"), others))
    offset = F.pmod(F.col("step"), others)
    queries = indexed.select(key, "idx", "n", F.posexplode(steps).alias("draw", "step")).select(
        key, "draw", F.pmod(F.col("idx") + 1 + offset, F.col("n")).alias("idx")
    )
    rows = indexed.select("idx", F.col(key).alias("neg_key"))
    return queries.join(rows, "idx").drop("idx")


def random_negatives(
    df: DataFrame, m: int, seed: int | str = 42, key: str = "row_key",
    exclude_same_anchor: bool = False, drawn: DataFrame | None = None,
) -> DataFrame:
    """(row_key, draw, neg_key, neg_positive, neg_negative) for `drawn_keys`.

    `key` must be unique. The passages are joined last and once. `exclude_same_anchor` drops
    draws whose row has the query's anchor, as they may be unlabelled positives. `df` is read
    several times and should be a table; `drawn` may be a written `drawn_keys` table.
    """
    require_columns(df, [key, "anchor", "positive", "negative"])
    drawn = drawn_keys(df, m, seed, key) if drawn is None else drawn
    rows = df.select(
        F.col(key).alias("neg_key"),
        F.col("positive").alias("neg_positive"),
        F.col("negative").alias("neg_negative"),
        F.col("anchor").alias("_neg_anchor"),
    )
    if not exclude_same_anchor:
        return drawn.join(rows.drop("_neg_anchor"), "neg_key")
    own = df.select(key, F.col("anchor").alias("_own_anchor"))
    return (
        drawn.join(rows, "neg_key")
        .join(own, key)
        .where(~F.col("_own_anchor").eqNullSafe(F.col("_neg_anchor")))
        .drop("_own_anchor", "_neg_anchor")
    )


def query_lists(
    df: DataFrame, m: int, seed: int | str = 42, key: str = "row_key",
    exclude_same_anchor: bool = False, carry: Sequence[str] = (),
    drawn: DataFrame | None = None,
) -> DataFrame:
    """(row_key, docs, *carry): positive, negative, then both passages of each drawn row.

    `carry` names columns of the query's own row to keep, which spares a join afterwards. A
    group holds at most m + 1 rows, so collecting it is bounded.
    """
    members = df.select(
        key, F.lit(-1).alias("draw"), F.col("positive").alias("a"), F.col("negative").alias("b"),
        *carry,
    )
    if m > 0:
        rows = random_negatives(df, m, seed, key, exclude_same_anchor, drawn)
        members = members.unionByName(
            rows.select(
                key, "draw", F.col("neg_positive").alias("a"), F.col("neg_negative").alias("b")
            ),
            allowMissingColumns=True,
        )
    # Only the query's own row has the carried values.
    grouped = members.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("draw", "a", "b"))).alias("members"),
        *[F.first(c, ignorenulls=True).alias(c) for c in carry],
    )

    def both(member: Column) -> Column:
        drawn_row = member["draw"] >= 0
        return F.array(
            F.struct(
                member["a"].alias("passage"),
                F.when(drawn_row, F.lit("drawn")).otherwise(F.lit("positive")).alias("origin"),
            ),
            F.struct(
                member["b"].alias("passage"),
                F.when(drawn_row, F.lit("drawn")).otherwise(F.lit("negative")).alias("origin"),
            ),
        )

    return grouped.select(key, F.flatten(F.transform("members", both)).alias("docs"), *carry)


def passage_pool(df: DataFrame, seed: int | str = 42, total: str | None = None) -> DataFrame:
    """(pid, passage): distinct passages numbered 0..P-1 in seeded order.

    Passages are told apart and ordered by their seeded md5, which is all that is indexed.
    Copies combine before the one shuffle of the passages themselves.
    """
    passages = df.select(F.explode(F.array("positive", "negative")).alias("passage"))
    passages = passages.where(F.col("passage").isNotNull())
    hashed = passages.withColumn("_digest", seeded_hash(seed, "passage"))
    index = dense_index(hashed.select("_digest").distinct(), "_digest", None, "pid", total)
    distinct = hashed.groupBy("_digest").agg(F.first("passage").alias("passage"))
    return distinct.join(index, "_digest").drop("_digest")


BLOCK = 4096
"""Pool positions, or ranks among the allowed ones, that are held together at most."""


def _shifts(barred: DataFrame, pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """How ranks among an anchor's allowed pool positions map to positions.

    With the anchor's barred positions b_1 < b_2 < .., the allowed position of rank r is r plus
    the number of those with b_j - (j - 1) <= r. Returns (anchor, at, passed): the number
    `passed` of all barred positions whose `at` = b_j - (j - 1) is not larger, and
    (anchor, n_barred). j is counted within blocks of the pool and over the blocks' sizes, so
    an anchor that bars much of a large pool still makes only small groups.
    """
    places = salted_join(
        barred.select("anchor", "passage"), pool.select("pid", "passage"), ["passage"], ["anchor"]
    )
    blocks = (
        places.groupBy("anchor", F.floor(F.col("pid") / BLOCK).alias("block"))
        .agg(F.sort_array(F.collect_set("pid")).alias("pids"))
    )
    # both results and every join with them read this
    blocks = materialise(blocks, "barred-blocks")
    before = W.partitionBy("anchor").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum(F.size("pids")).over(before), F.lit(0)))
    j = F.col("before") + F.col("place")
    shifts = (
        blocks.select("anchor", "before", F.posexplode("pids").alias("place", "pid"))
        .groupBy("anchor", (F.col("pid") - j).alias("at")).agg(F.max(j + 1).alias("passed"))
    )
    return shifts, blocks.groupBy("anchor").agg(F.sum(F.size("pids")).alias("n_barred"))


def _positions(ranks: DataFrame, shifts: DataFrame, key: str) -> DataFrame:
    """Rows (key, anchor, step, rank) with `pid`, the anchor's allowed pool position of the rank.

    Shifts are held by blocks of ranks; a block also knows what the blocks before it passed.
    Only blocks in which an anchor has shifts or is asked take part.
    """
    ranks = ranks.withColumn("block", F.floor(F.col("rank") / BLOCK))
    held = shifts.groupBy("anchor", F.floor(F.col("at") / BLOCK).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("at", "passed"))).alias("held"), F.max("passed").alias("passed")
    )
    asked = ranks.select("anchor", "block").distinct()
    before = W.partitionBy("anchor").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    table = (
        asked.join(held, ["anchor", "block"], "full")
        .withColumn("before", F.coalesce(F.max("passed").over(before), F.lit(0)))
        .where(F.col("held").isNotNull() | (F.col("before") > 0))
        .select("anchor", "block", "before", "held")
    )
    found = salted_join(ranks, table, ["anchor", "block"], [key, "step"], "left")
    shift = F.aggregate(
        F.coalesce("held", F.expr("array()")), F.coalesce("before", F.lit(0)).cast("bigint"),
        lambda passed, s: F.when(s["at"] <= F.col("rank"), s["passed"]).otherwise(passed),
    )
    return found.select(key, "step", (F.col("rank") + shift).alias("pid"))


def fill_candidates(
    lists: DataFrame, pool: DataFrame, k: int, seed: int | str = 42, key: str = "row_key",
    keys: DataFrame | None = None, barred: DataFrame | None = None,
) -> DataFrame:
    """Add random unused pool passages to lists shorter than k.

    `pool` comes from `passage_pool(..., total="n_pool")`. Each list draws min(P, k)
    consecutive pool positions after a hashed start: at most as many of them as the list has
    entries are its own, so enough remain whenever the whole pool has enough. If fewer
    remain than are missing none is used, and `repeat_candidates` takes over. `keys` may name
    the lists to draw for, which spares looking for the short ones; with `barred` it also has
    their `anchor`, not null, and passages that `barred` (anchor, passage) names for it are
    not used: positions are then drawn by their rank among the P that are allowed.
    """
    if keys is None:
        keys = lists.where(F.size("docs") < k)
    n_pool = pool.agg(F.coalesce(F.max("n_pool"), F.lit(0)).cast("bigint")).scalar()
    if barred is not None:
        shifts, counts = _shifts(barred, pool)
        keys = salted_join(keys.select(key, "anchor"), counts, ["anchor"], [key], "left")
        n_pool = n_pool - F.coalesce("n_barred", F.lit(0))
    start = F.pmod(hash_bigint(seeded_hash(seed, F.lit("fill"), key)), F.when(n_pool > 0, n_pool))
    steps = _consecutive(start, F.least(n_pool, F.lit(k).cast("bigint")))
    anchor = [] if barred is None else ["anchor"]
    found = keys.select(key, *anchor, n_pool.alias("_allowed"), F.explode(steps).alias("step"))
    found = found.withColumn("pid", F.pmod("step", "_allowed")).drop("_allowed")
    if barred is not None:
        # read for the blocks asked for, for hot keys and for the join
        ranks = materialise(found.withColumnRenamed("pid", "rank"), "ranks")
        found = _positions(ranks, materialise(shifts, "shifts"), key)
    drawn = (
        found.join(pool.select("pid", "passage"), "pid").groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct("step", "passage"))).alias("drawn"))
    )
    missing = F.lit(k) - F.size("docs")
    unused = F.filter(
        "drawn",
        lambda d: ~F.exists("docs.passage", lambda own: own.eqNullSafe(d["passage"])),
    )
    added = F.transform(
        F.slice("unused", F.lit(1), F.greatest(missing, F.lit(0))),
        lambda d: F.struct(d["passage"].alias("passage"), F.lit("pool").alias("origin")),
    )
    return (
        lists.join(drawn, key, "left")
        .withColumn("unused", unused)
        .withColumn(
            "docs",
            F.when(
                (missing > 0) & (F.size("unused") >= missing), F.concat("docs", added)
            ).otherwise(F.col("docs")),
        )
        .drop("drawn", "unused")
    )


def _content_ref(passage: Column | str) -> Column:
    """A 128-bit stand-in for a passage of any type, for comparing and joining."""
    passage = F.col(passage) if isinstance(passage, str) else passage
    return F.struct(
        F.xxhash64(passage).alias("high"), F.xxhash64(F.lit(1), passage).alias("low")
    )


def _with_fill(
    lists: DataFrame, df: DataFrame, k: int, m: int, seed: int | str, key: str,
    exclude_same_anchor: bool, drawn: DataFrame | None,
) -> DataFrame:
    """`fill_candidates` that decides on content references and moves only chosen passages."""
    pool = materialise(passage_pool(df, seed, total="n_pool"), "pool")
    refs = pool.withColumn("passage", _content_ref("passage"))
    slim = df.select(
        key, "anchor", _content_ref("positive").alias("positive"),
        _content_ref("negative").alias("negative"),
    )
    slim_lists = query_lists(slim, m, seed, key, exclude_same_anchor, drawn=drawn)
    barred = None
    if exclude_same_anchor:
        # the positives of every row with the query's anchor
        barred = slim.select(F.xxhash64("anchor").alias("anchor"), F.col("positive").alias("passage")).distinct()
    keys = slim.select(key, F.xxhash64("anchor").alias("anchor"))
    filled = fill_candidates(slim_lists, refs, k, seed, key, keys, barred)
    chosen = filled.select(key, F.posexplode("docs").alias("slot", "doc")).where(
        F.col("doc.origin") == "pool"
    )
    added = (
        chosen.select(key, "slot", F.col("doc.passage").alias("ref"))
        .join(pool.select(_content_ref("passage").alias("ref"), "passage"), "ref")
        .groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct("slot", "passage"))).alias("added"))
    )
    docs = F.transform(
        "added", lambda d: F.struct(d["passage"].alias("passage"), F.lit("pool").alias("origin"))
    )
    return lists.join(added, key, "left").withColumn(
        "docs", F.when(F.col("added").isNotNull(), F.concat("docs", docs)).otherwise(F.col("docs"))
    ).drop("added")


def repeat_candidates(lists: DataFrame, k: int) -> DataFrame:
    """Bring every list to exactly k entries: cycle short ones, cut long ones."""
    length = F.size("docs")
    repeated = F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)),
        lambda slot: F.struct(
            F.element_at("docs", F.pmod(slot, length) + 1)["passage"].alias("passage"),
            F.when(slot < length, F.element_at("docs", F.pmod(slot, length) + 1)["origin"])
            .otherwise(F.lit("repeat"))
            .alias("origin"),
        ),
    )
    return lists.withColumn(
        "docs", F.when(length >= k, F.slice("docs", 1, k)).otherwise(repeated)
    )


def candidate_docs(
    df: DataFrame, k: int = 16, m: int | None = None, mining: bool = True,
    seed: int | str = 42, key: str = "row_key", exclude_same_anchor: bool = False,
    carry: Sequence[str] = (),
) -> DataFrame:
    """(row_key, docs, *carry): one list of exactly k candidates per triplet.

    `m` rows are drawn per query (default: enough to reach k). With `mining` short lists are
    filled from the passage pool, otherwise they only repeat. The pool is built, as a table,
    only when lists can be short, which a look at m + 1 input rows decides.
    """
    m = negative_pairs(k) if m is None else m
    may_be_short = 2 + 2 * m < k or exclude_same_anchor
    if not may_be_short and m > 0:
        may_be_short = df.select(key).limit(m + 1).count() <= m
    if not (may_be_short and mining):
        return repeat_candidates(query_lists(df, m, seed, key, exclude_same_anchor, carry), k)
    drawn = materialise(drawn_keys(df, m, seed, key), "drawn") if m > 0 else None
    lists = query_lists(df, m, seed, key, exclude_same_anchor, carry, drawn)
    lists = _with_fill(lists, df, k, m, seed, key, exclude_same_anchor, drawn)
    return repeat_candidates(lists, k)


def explode_lists(
    lists: DataFrame, key: str = "row_key", carry: Sequence[str] = ()
) -> DataFrame:
    """Long form (row_key, slot, passage, origin, *carry)."""
    return lists.select(key, F.posexplode("docs").alias("slot", "doc"), *carry).select(
        key, "slot", "doc.passage", "doc.origin", *carry
    )


def candidate_lists(df: DataFrame, k: int = 16, carry: Sequence[str] = (), **options) -> DataFrame:
    """Candidate lists in long form; slot 0 is the positive, slot 1 the negative."""
    lists = candidate_docs(df, k, carry=carry, **options)
    return explode_lists(lists, options.get("key", "row_key"), carry)


def candidate_stats(lists: DataFrame, approximate: bool = False) -> DataFrame:
    """Queries, mean list length and number of distinct passages.

    The distinct count is exact by default and estimated in one pass when `approximate`.
    """
    sizes = lists.agg(
        F.count(F.lit(1)).alias("n_queries"), F.avg(F.size("docs")).alias("mean_candidates")
    )
    passages = lists.select(F.explode("docs.passage").alias("passage"))
    if approximate:
        n_passages = passages.agg(F.approx_count_distinct("passage")).scalar()
    else:
        n_passages = passages.distinct().agg(F.count(F.lit(1))).scalar()
    return sizes.withColumn("n_passages", n_passages)
