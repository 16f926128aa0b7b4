"""Approximate nearest neighbours by collision counting.

Vectors are normalised and projected on `projections` fixed random directions; for every
direction the projections of a block of vectors are kept in a sorted array. A query opens a
window around its own projection in each array. A vector collides once for every window it
lies in; those with at least `threshold` collisions are verified with their exact cosine.
The windows grow by `ratio` (virtual rehashing: the arrays stay as they are), and only the
newly covered ends are counted, until they are wide enough for the k-th verified neighbour:
a vector at that distance or nearer then reaches the threshold with high probability.

Scale: vectors are dealt to blocks and queries to chunks by hash; a cell of one block and one
chunk is a task of bounded size that returns k rows per query. All rows are indexed. Work
is that of the stated search, every query against every block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROJECTIONS = 128
REACH = 0.5
"""Half width of a window in units of the distance it is meant for."""
MARGIN = 2.0
"""Standard deviations of the number of collisions allowed below its mean."""
BLOCK = 32768
CHUNK = 2048
_INSIDE = 0.3829249225480262  # P(|z| < 0.5) of a standard normal z


def directions(dims: int, projections: int = PROJECTIONS, seed: int = 11) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([seed, dims])).standard_normal((dims, projections))


def threshold(projections: int = PROJECTIONS) -> int:
    mean = projections * _INSIDE
    return max(1, int(mean - MARGIN * np.sqrt(mean * (1 - _INSIDE))))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def search_block(
    ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int,
    projections: int = PROJECTIONS, ratio: float = 2.0, first: float = 0.1,
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query its place, and the ids and cosines of its k nearest found in the block.

    Rows with the query's own id take no part; ties go to the smaller id.
    """
    least = threshold(projections)
    matrix = directions(vectors.shape[1], projections)
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    units = vectors / norms[:, None]
    projected = (units @ matrix).T
    order = np.argsort(projected, axis=1, kind="stable").astype(np.int32)
    arrays = np.take_along_axis(projected, order, axis=1)
    centres = unit_rows(queries) @ matrix
    n = len(ids)
    for place in range(len(query_ids)):
        query, centre = queries[place], centres[place]
        norm = np.sqrt((query * query).sum())
        counts = np.zeros(n, dtype=np.uint16)
        done = ids == query_ids[place]
        others = n - int(done.sum())
        low = np.array([np.searchsorted(a, c) for a, c in zip(arrays, centre)])
        high = low.copy()
        verified_ids, verified = np.empty(0, dtype=ids.dtype), np.empty(0)
        width = first
        while others:
            new_low = np.array([np.searchsorted(a, c - width) for a, c in zip(arrays, centre)])
            new_high = np.array([np.searchsorted(a, c + width, "right") for a, c in zip(arrays, centre)])
            for row, a, b, c, d in zip(order, new_low, low, high, new_high):
                if a < b:
                    counts[row[a:b]] += 1
                if c < d:
                    counts[row[c:d]] += 1
            low, high = new_low, new_high
            found = np.flatnonzero((counts >= least) & ~done)
            if len(found):
                done[found] = True
                cosines = (vectors[found] * query).sum(axis=1) / (norms[found] * norm)
                verified_ids = np.concatenate([verified_ids, ids[found]])
                verified = np.concatenate([verified, cosines])
            if len(verified) == others:
                break
            if len(verified) >= k:
                kth = np.partition(verified, len(verified) - k)[len(verified) - k]
                wanted = REACH * np.sqrt(max(0.0, 2 - 2 * kth))
                if width >= wanted:
                    break
                width = min(width * ratio, max(wanted, first))
            else:
                width *= ratio
            if (low == 0).all() and (high == n).all():
                break
        best = np.lexsort((verified_ids, -verified))[:k]
        yield place, verified_ids[best], verified[best]


def usable(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """id, vector (doubles) and dims of the rows that take part.

    Left out: rows without id, null and empty vectors, those with a null or non-finite
    component, and zero vectors.
    """
    values = F.col(vector).cast("array<double>")
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists(values, lambda x: x != 0)
    return vectors.where(F.col(id_column).isNotNull() & F.coalesce(fine & nonzero, F.lit(False))).select(
        F.col(id_column).cast("bigint").alias("id"), values.alias("vector"), F.size(vector).alias("dims")
    )


def nearest(
    vectors: DataFrame, k: int = 5, every: int = 50, id_column: str = "vec_id",
    vector: str = "embedding", block: int = BLOCK, chunk: int = CHUNK,
    projections: int = PROJECTIONS,
) -> DataFrame:
    """The k nearest found of every row whose id is divisible by `every`: query_id, rank,
    the neighbour's id and score (cosine in double precision).

    Vectors are compared with those of the same number of components. Rows with the query's
    own id are no candidates; an id that repeats counts once per query, with its best score,
    and a query id with several vectors is asked with each of them. Fewer candidates than k give fewer rows, an empty
    table none.
    """
    rows = usable(vectors, id_column, vector)
    # equal rows ask once, different vectors of one id each
    asked = rows.where(F.col("id") % every == 0).distinct()
    n = rows.agg(F.count(F.lit(1)), F.count_if(F.col("id") % every == 0)).first()
    blocks, chunks = max(1, -(-n[0] // block)), max(1, -(-n[1] // chunk))

    def dealt(frame: DataFrame, own: str, count: int, other: str, copies: int, is_query: bool) -> DataFrame:
        return frame.select(
            "dims",
            F.pmod(F.xxhash64("id", F.lit(own)), F.lit(count)).alias(own),
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(copies - 1).cast("bigint"))).alias(other),
            "id", "vector", F.lit(is_query).alias("is_query"),
        )

    cells = dealt(rows, "_block", blocks, "_chunk", chunks, False).unionByName(
        dealt(asked, "_chunk", chunks, "_block", blocks, True)
    )

    def cell(frame: pd.DataFrame) -> pd.DataFrame:
        asks = frame["is_query"].to_numpy()
        out = {"query_id": [], "id": [], "score": []}
        if asks.any() and not asks.all():
            data = np.stack(frame["vector"].to_numpy())
            ids = frame["id"].to_numpy()
            # a fixed order, whatever order the shuffle gave
            keep, ask = np.flatnonzero(~asks), np.flatnonzero(asks)
            keep, ask = keep[np.argsort(ids[keep], kind="stable")], ask[np.argsort(ids[ask], kind="stable")]
            for place, found, scores in search_block(ids[keep], data[keep], ids[ask], data[ask], k, projections):
                out["query_id"].append(np.full(len(found), ids[ask[place]]))
                out["id"].append(found)
                out["score"].append(scores)
        return pd.DataFrame({
            name: np.concatenate(parts) if parts else np.empty(0, dtype=np.float64 if name == "score" else np.int64)
            for name, parts in out.items()
        })

    found = cells.groupBy("dims", "_block", "_chunk").applyInPandas(cell, "query_id bigint, id bigint, score double")
    best = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return (
        best.withColumn("rank", F.row_number().over(order).cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "id", "score")
    )
