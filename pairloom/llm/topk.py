"""Exact top-k search: tiled matrix products, partial selection per tile, tree merging.

Every component x becomes floor(64 * x); a score is the integer inner product of two such
vectors. Vectors are packed into shards and the queries among them into tiles. A cell is one
tile and one shard: its scores are a matrix product, a slice of queries at a time, and each
query keeps the k best of the shard by partial selection. The lists of a tile then meet in
rounds of a tree, `FAN` shards at a time, so no task ever holds more than a few lists of the
same queries.

Products run in float32 or float64 where the lengths of the vectors bound every partial sum
below the integers that type can hold, else on Python's integers; all three are exact.

Scale: the work is that of the stated search, every query against every row. Rows are dealt
to shards by a hash of their content and equal rows are one row, so a vector or an id that
fills a third of the table makes no large shard. Packed in the narrowest integers, a cell
moves one shard and one tile (2 MB each at 64 small components) for some 10^11 operations,
so the products outweigh the exchange at any size of the table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.session import discard, materialise

STEPS = 64
COMPONENTS = 1 << 21
"""Components in a shard or a tile, hence 32,768 vectors of 64."""
LEAST_ROWS = 1024
"""Rows worth a shard of their own where the table would fill fewer shards than tasks."""
SLICE = 1 << 22
"""Scores computed at once in a cell."""
FAN = 8
_LONG = np.iinfo(np.int64)
_KINDS = ("<i1", "<i2", "<i4", "<i8")
_LIST = "dims int, tile bigint, part bigint, queries binary, counts binary, ids binary, scores binary"


def _narrow(values: np.ndarray) -> tuple[str, bytes]:
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    kind = next(k for k in _KINDS if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return kind, np.ascontiguousarray(values.astype(kind)).tobytes()


def _matrix(row: pd.Series) -> np.ndarray:
    return np.frombuffer(row["matrix"], dtype=row["kind"]).reshape(-1, row["dims"])


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """All inner products of two integer matrices as int64, exactly.

    A product beyond a long is given as the nearest long.
    """
    def length(m: np.ndarray) -> float:
        m = m.astype(np.float64)
        return float(np.sqrt(np.einsum("ij,ij->i", m, m).max(initial=0.0)))

    bound = length(queries) * length(vectors) * 1.0001
    if bound < 2**53:
        kind = np.float32 if bound < 2**24 else np.float64
        return (queries.astype(kind) @ vectors.astype(kind).T).astype(np.int64)
    exact = queries.astype(object) @ vectors.astype(object).T
    return np.clip(exact, _LONG.min, _LONG.max).astype(np.int64)


def _by_id(scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One column per id, the best score of its vectors; `ids` are sorted."""
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    if len(first) == len(ids):
        return scores, ids
    return np.maximum.reduceat(scores, first, axis=1), ids[first]


def best_of_block(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per query the number, ids and scores of its best in a block, flat, best first.

    Ties go to the smaller id; an id counts once; a query's own id takes no part.
    """
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    step = max(1, SLICE // max(1, len(ids)))
    counts, best_ids, best_scores = [], [], []
    for at in range(0, len(queries), step):
        asked = query_ids[at:at + step]
        scores, names = _by_id(products(queries[at:at + step], vectors), ids)
        n = len(names)
        # places from -n to -1: equal scores are told apart by id, and one's own id is last
        places = np.arange(n, dtype=np.int64)
        own = np.searchsorted(names, asked)
        has_own = (own < n) & (names[np.minimum(own, n - 1)] == asked)
        m = min(k + 1, n)
        if max(int(scores.max()), -int(scores.min())) < _LONG.max // (n + 1):
            keys = scores * n - places
            keys[has_own.nonzero()[0], own[has_own]] = _LONG.min
            part = np.argpartition(keys, n - m, axis=1)[:, n - m:] if m < n else np.broadcast_to(places, keys.shape)
            held = np.take_along_axis(keys, part, axis=1)
            chosen = np.take_along_axis(part, np.argsort(-held, axis=1, kind="stable"), axis=1)
        else:
            chosen = np.stack([np.lexsort((places, ~row))[:k + 1] for row in scores])
        valid = chosen != np.where(has_own, own, -1)[:, None]
        valid &= np.cumsum(valid, axis=1) <= k
        counts.append(valid.sum(axis=1))
        best_ids.append(names[chosen[valid]])
        best_scores.append(np.take_along_axis(scores, chosen, axis=1)[valid])
    return np.concatenate(counts), np.concatenate(best_ids), np.concatenate(best_scores)


def merged(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best distinct ids, queries ascending, best first."""
    # the best score of each (query, id) first, then those by score
    order = np.lexsort((~scores, ids, query))
    q, i = query[order], ids[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (q[1:] != q[:-1]) | (i[1:] != i[:-1])
    order = order[new]
    order = order[np.lexsort((ids[order], ~scores[order], query[order]))]
    q = query[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return order[rank < k]


def _list_row(dims, tile, part, queries: bytes, counts, ids, scores) -> pd.DataFrame:
    return pd.DataFrame({
        "dims": [dims], "tile": [tile], "part": [part], "queries": [queries],
        "counts": [counts.astype("<i4").tobytes()], "ids": [ids.astype("<i8").tobytes()],
        "scores": [scores.astype("<i8").tobytes()],
    })


def usable(vectors: DataFrame, id_column: str, vector: str, steps: int) -> DataFrame:
    """id, dims and the integer components of the rows that take part, each kind of row once.

    Left out: rows without id, null and empty vectors, those with a null or non-finite
    component. A component beyond a long counts as the nearest long.
    """
    values = F.col(vector).cast("array<double>")
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(values, lambda x: F.floor(F.least(F.greatest(x * steps, F.lit(-(2.0**63))), F.lit(2.0**63 - 1024))))
    kept = vectors.where(F.col(id_column).isNotNull() & F.coalesce(fine, F.lit(False)) & (F.size(vector) > 0))
    return kept.select(
        F.col(id_column).cast("bigint").alias("id"), F.size(vector).alias("dims"), whole.alias("vector")
    ).distinct()


def _packed(rows: DataFrame, name: str, blocks) -> DataFrame:
    """One row per block of rows: (dims, <name>, kind, ids, matrix), rows by id."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        kind, data = _narrow(np.stack(frame["vector"].to_numpy()))
        return pd.DataFrame({
            "dims": frame["dims"].iloc[:1], name: frame[name].iloc[:1], "kind": [kind],
            "ids": [frame["id"].to_numpy().astype("<i8").tobytes()], "matrix": [data],
        })

    dealt = rows.withColumn(name, F.pmod(F.xxhash64("id", "vector"), blocks).cast("bigint"))
    return dealt.groupBy("dims", name).applyInPandas(
        pack, f"dims int, {name} bigint, kind string, ids binary, matrix binary"
    )


def top_k(
    vectors: DataFrame, k: int = 20, every: int = 20, id_column: str = "vec_id",
    vector: str = "embedding", steps: int = STEPS, components: int = COMPONENTS,
    least_rows: int = LEAST_ROWS, fan: int = FAN,
) -> DataFrame:
    """The k highest scores of every row whose id is divisible by `every`: query_id, rank,
    the other's id and score; all rows are candidates, ties go to the smaller id.

    Vectors are compared with those of the same number of components. Rows with the query's
    own id are no candidates; a query id with several vectors is asked with each, an id that
    repeats counts once per query, with its best score. Fewer candidates than k give fewer
    rows, an empty table none. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = materialise(usable(vectors, id_column, vector, steps), "topk-rows")
    asked = rows.where(F.col("id") % every == 0)
    # a few numbers per length of vector
    sizes = rows.groupBy("dims").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") % every == 0).alias("q"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    full = F.greatest(F.floor(F.lit(components) / F.col("dims")), F.lit(1))
    shard_rows = F.least(full, F.greatest(F.ceil(F.col("n") / tasks), F.lit(least_rows)))
    sizes = materialise(sizes.select(
        "dims", F.greatest(F.ceil(F.col("n") / shard_rows), F.lit(1)).cast("bigint").alias("shards"),
        F.greatest(F.ceil(F.col("q") / full), F.lit(1)).cast("bigint").alias("tiles"),
    ), "topk-sizes")
    shards = materialise(_packed(rows.join(F.broadcast(sizes), "dims"), "shard", F.col("shards")), "topk-shards")
    tiles = materialise(_packed(asked.join(F.broadcast(sizes), "dims"), "tile", F.col("tiles")), "topk-tiles")

    def copied(frame: DataFrame, own: str, other: str, is_tile: bool) -> DataFrame:
        places = F.sequence(F.lit(0).cast("bigint"), F.col(f"{other}s") - 1)
        return frame.join(F.broadcast(sizes), "dims").select(
            "dims", own, F.explode(places).alias(other), "kind", "ids", "matrix", F.lit(is_tile).alias("is_tile")
        )

    cells = copied(tiles, "tile", "shard", True).unionByName(copied(shards, "shard", "tile", False))

    def cell(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        found = {bool(row["is_tile"]): row for _, row in frame.iterrows()}
        if len(found) < 2:
            return pd.DataFrame(columns=[f.split()[0] for f in _LIST.split(", ")])
        tile, shard = found[True], found[False]
        best = best_of_block(
            np.frombuffer(tile["ids"], "<i8"), _matrix(tile), np.frombuffer(shard["ids"], "<i8"), _matrix(shard), k
        )
        return _list_row(key[0], key[1], key[2], tile["ids"], *best)

    lists = cells.groupBy("dims", "tile", "shard").applyInPandas(cell, _LIST)

    def meet(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        counts = [np.frombuffer(c, "<i4") for c in frame["counts"]]
        query = np.concatenate([np.repeat(np.arange(len(c)), c) for c in counts])
        ids = np.concatenate([np.frombuffer(b, "<i8") for b in frame["ids"]])
        scores = np.concatenate([np.frombuffer(b, "<i8") for b in frame["scores"]])
        keep = merged(query, ids, scores, k)
        held = np.bincount(query[keep], minlength=len(counts[0]))
        return _list_row(key[0], key[1], key[2], frame["queries"].iloc[0], held, ids[keep], scores[keep])

    parts = sizes.agg(F.max("shards")).first()[0] or 1
    while parts > 1:
        up = lists.withColumn("_up", F.floor(F.col("part") / fan))
        lists = up.groupBy("dims", "tile", "_up").applyInPandas(meet, _LIST)
        parts = -(-parts // fan)
    lists = materialise(lists, "topk-lists")
    discard(rows, shards, tiles, sizes)

    def spread(frames):
        for frame in frames:
            for _, row in frame.iterrows():
                yield pd.DataFrame({
                    "query_id": np.repeat(np.frombuffer(row["queries"], "<i8"), np.frombuffer(row["counts"], "<i4")),
                    "id": np.frombuffer(row["ids"], "<i8"), "score": np.frombuffer(row["scores"], "<i8"),
                })

    # the lists of a query id that has several vectors meet here
    found = lists.mapInPandas(spread, "query_id bigint, id bigint, score bigint")
    best = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return (
        best.withColumn("rank", F.row_number().over(order).cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "id", "score")
    )
