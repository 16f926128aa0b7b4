"""Retrieval: a written index of vectors by cells, the best rows for queries, mined negatives.

Vectors are scaled to unit length and dealt to the nearest of at most `MAX_CELLS` centroids,
which are fitted on a bounded seeded sample; every vector is indexed. A query is compared with
the vectors of its `probes` nearest cells only, so the index is read in the cells asked for.
Cells of any size lie in parts of at most about `PART_ROWS` rows and are asked in chunks of
queries, and each task of one part and one chunk returns k rows a query. A table of fewer than
`rows_per_cell * probes` rows has no more cells than are probed: the answer is then exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.operators.negatives import _content_ref
from pairloom.operators.ordering import sample_n
from pairloom.operators.skew import salted_join
from pairloom.schema import require_columns
from pairloom.session import materialise

MAX_CELLS = 16_384
ROWS_PER_CELL = 4096
SAMPLE_PER_CELL = 64
"""Rows of the fitting sample per cell; at most 2^20 in all."""
PART_ROWS = 32_768
CHUNK = 4096
SCORES = 1 << 22
"""Scores computed at once in a task."""


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key in the given order, numbered from 1 in `rank`.

    Each task keeps k rows a key before the shuffle and passes on no others (Spark's window
    group limit), so a key's size matters to no task. Make the order total for stable results.
    """
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank, place.cast("int")).where(F.col(rank) <= k)


@dataclass(frozen=True)
class VectorIndex:
    """A written index: its folder, the type of its ids, its centroids and the number of
    parts of each cell."""

    path: str
    id_type: str
    centroids: np.ndarray
    parts: np.ndarray

    @property
    def cells(self) -> int:
        return len(self.centroids)

    def rows(self, spark: SparkSession, cells: list[int] | None = None) -> DataFrame:
        """(id, vector, part, cell), of some cells only if named: the others are not read."""
        schema = f"id {self.id_type}, vector array<double>, part int, cell int"
        table = spark.read.schema(schema).parquet(f"{self.path}/vectors")
        return table if cells is None else table.where(F.col("cell").isin(cells))


def unit_vectors(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, vector) scaled to unit length, without rows that have no direction.

    Left out: rows without id, null and empty vectors, zero vectors, and those with a null or
    non-finite component.
    """
    values = F.col(vector).cast("array<double>")
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda total, x: total + x * x))
    found = df.where(F.col(id_column).isNotNull() & F.coalesce(fine, F.lit(False)))
    found = found.select(F.col(id_column).alias("id"), values.alias("_values"), norm.alias("_norm"))
    return found.where(F.col("_norm") > 0).select(
        "id", F.transform("_values", lambda x: x / F.col("_norm")).alias("vector")
    )


def _centroids(sample: np.ndarray, cells: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids by spherical k-means over the sample, begun at distinct rows of it."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(sample, axis=0)
    centres = distinct[rng.choice(len(distinct), min(cells, len(distinct)), replace=False)]
    for _ in range(rounds if len(centres) > 1 else 0):
        nearest = np.concatenate([(part @ centres.T).argmax(axis=1) for part in np.array_split(sample, 1 + len(sample) // 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    return centres


def _nearest_cells(rows: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """Adds `cells`, the places of the nearest centroids, nearest first. Needs no shuffle."""
    probes = min(probes, len(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column("vector")
            matrix = vectors.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            found = []
            for part in np.array_split(matrix, 1 + matrix.shape[0] * len(centroids) // SCORES):
                # an empty index has one cell without direction
                scores = part @ centroids.T if centroids.size else np.zeros((len(part), 1))
                best = np.argpartition(-scores, probes - 1, axis=1)[:, :probes]
                found.append(np.take_along_axis(best, np.argsort(-np.take_along_axis(scores, best, 1), axis=1, kind="stable"), 1))
            cells = np.concatenate(found).astype(np.int32)
            bounds = pa.array(np.arange(b.num_rows + 1) * probes, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), vectors, pa.ListArray.from_arrays(bounds, pa.array(cells.ravel()))], ["id", "vector", "cells"]
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, vector array<double>, cells array<int>")


def build_index(
    df: DataFrame, path: str, id_column: str = "id", vector: str = "vector", seed: int = 42,
    rows_per_cell: int = ROWS_PER_CELL, part_rows: int = PART_ROWS,
) -> VectorIndex:
    """Write the index of all rows of `df` that have a direction, and return it.

    Ids must be unique and vectors equally long. `path` gets the vectors in folders by cell
    and one row per cell with its centroid; `open_index` reads it again.
    """
    spark = df.sparkSession
    rows = materialise(unit_vectors(require_columns(df, [id_column, vector]), id_column, vector), "vectors")
    cells = max(1, min(MAX_CELLS, -(-rows.count() // rows_per_cell)))
    # at most 2^20 rows whatever the table
    sample = sample_n(rows, min(1 << 20, SAMPLE_PER_CELL * cells), "id", seed).toPandas()
    centroids = _centroids(np.stack(sample.sort_values("id")["vector"].to_numpy()), cells, seed) if len(sample) else np.zeros((1, 0))
    dealt = materialise(
        _nearest_cells(rows, centroids, 1).select("id", "vector", F.col("cells")[0].alias("cell")), "dealt"
    )
    sizes = {r["cell"]: r["count"] for r in dealt.groupBy("cell").count().collect()}  # one row per cell
    parts = np.array([max(1, -(-sizes.get(c, 0) // part_rows)) for c in range(len(centroids))])
    kind = rows.schema["id"].dataType.simpleString()
    facts = spark.createDataFrame(
        [(c, int(p), centre.tolist(), kind) for c, (p, centre) in enumerate(zip(parts, centroids))],
        "cell int, parts int, centroid array<double>, id_type string",
    )
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")
    split = dealt.join(F.broadcast(facts.select("cell", "parts")), "cell").select("id", "vector", part, "cell")
    split.repartition("cell", "part").write.partitionBy("cell").parquet(f"{path}/vectors")
    facts.coalesce(1).write.parquet(f"{path}/cells")
    return VectorIndex(path, kind, centroids, parts)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    """A written index; its cells, at most `MAX_CELLS`, are read to the driver."""
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    return VectorIndex(path, cells[0]["id_type"], np.array([r["centroid"] for r in cells]), np.array([r["parts"] for r in cells]))


def search(
    index: VectorIndex, queries: DataFrame, k: int, probes: int = 8, barred: DataFrame | None = None,
    id_column: str = "id", vector: str = "vector", chunk: int = CHUNK,
) -> DataFrame:
    """(query_id, rank, id, score): the k rows of the index nearest to each query by cosine,
    among those of its `probes` nearest cells; ties go to the smaller id.

    `barred` (query_id, id) names pairs that do not count, however many: the k best others are
    found. Queries without a direction get no rows; ids of queries must be unique.
    """
    spark = queries.sparkSession
    asked = unit_vectors(queries, id_column, vector).withColumnRenamed("id", "query_id")
    asked = _nearest_cells(asked.withColumnRenamed("query_id", "id"), index.centroids, probes)
    asked = materialise(asked.select(F.col("id").alias("query_id"), "vector", F.explode("cells").alias("cell")), "asked")
    sizes = {r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}  # one row per cell
    facts = F.broadcast(spark.createDataFrame(
        [(c, -(-n // chunk), int(index.parts[c])) for c, n in sizes.items()], "cell int, chunks int, parts int"
    ))
    rows = index.rows(spark, sorted(sizes))
    id_kind, query_kind = rows.schema["id"].dataType.simpleString(), asked.schema["query_id"].dataType.simpleString()

    def numbers(upto: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(upto) - 1))

    chunk_of = F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int").alias("chunk")
    none_id, none_query = F.lit(None).cast(id_kind).alias("id"), F.lit(None).cast(query_kind).alias("query_id")
    members = rows.join(facts, "cell").select("cell", "part", numbers("chunks").alias("chunk"), "id", none_query, "vector")
    members = members.unionByName(
        asked.join(facts, "cell").select("cell", numbers("parts").alias("part"), chunk_of, none_id, "query_id", "vector")
    )
    if barred is not None:
        places = salted_join(barred.select("query_id", "id"), rows.select("id", "cell", "part"), ["id"], ["query_id"])
        places = places.join(asked.select("query_id", "cell"), ["query_id", "cell"], "left_semi")
        members = members.unionByName(
            places.join(facts, "cell").select("cell", "part", chunk_of, "id", "query_id", F.lit(None).cast("array<double>").alias("vector"))
        )

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        found = frame[frame["query_id"].isna()].sort_values("id")
        asks = frame[frame["id"].isna()].sort_values("query_id")
        pairs = frame[frame["id"].notna() & frame["query_id"].notna()]
        out: dict[str, list] = {"query_id": [], "id": [], "score": []}
        if len(found) and len(asks):
            ids, query_ids = found["id"].to_numpy(), asks["query_id"].to_numpy()
            data = np.stack(found["vector"].to_numpy())
            at = np.searchsorted(query_ids, pairs["query_id"].to_numpy()), np.searchsorted(ids, pairs["id"].to_numpy())
            step = max(1, SCORES // len(ids))
            for low in range(0, len(query_ids), step):
                scores = np.stack(asks["vector"].iloc[low:low + step].to_numpy()) @ data.T
                mine = (at[0] >= low) & (at[0] < low + len(scores))
                scores[at[0][mine] - low, at[1][mine]] = -np.inf
                for query, row in zip(query_ids[low:low + step], scores):
                    if len(row) > k:  # with all that tie with the k-th, the smaller ids are among them
                        best = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
                    else:
                        best = np.arange(len(row))
                    best = best[np.argsort(-row[best], kind="stable")][:k]
                    best = best[np.isfinite(row[best])]
                    out["query_id"].extend([query] * len(best))
                    out["id"].extend(ids[best])
                    out["score"].extend(row[best])
        return pd.DataFrame(out)

    best = members.groupBy("cell", "part", "chunk").applyInPandas(score, f"query_id {query_kind}, id {id_kind}, score double")
    return top_k(best, ["query_id"], [F.col("score").desc(), F.col("id")], k).select("query_id", "rank", "id", "score")


def recall(found: DataFrame, wanted: DataFrame) -> float:
    """Share of the (query_id, id) pairs of an exact answer that a search has found."""
    both = wanted.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("_hit")), ["query_id", "id"], "left")
    row = both.agg(F.count("_hit").alias("hits"), F.count(F.lit(1)).alias("all")).first()
    return row["hits"] / row["all"] if row["all"] else 1.0


def mined_negatives(
    df: DataFrame, k: int, path: str, probes: int = 8, key: str = "row_key",
    anchor_vector: str = "anchor_vector", positive_vector: str = "positive_vector", **options,
) -> DataFrame:
    """(row_key, rank, neg_key, score): for each triplet the k passages nearest to its anchor
    that are positive for no row with that anchor; `neg_key` is the first row that has the
    passage as its positive.

    Equal anchors are asked once and equal passages are indexed once (at `path`), whatever
    number of rows has them. Rows whose anchor or passage has no vector mine nothing, or are
    not mined.
    """
    require_columns(df, [key, "anchor", "positive", anchor_vector, positive_vector])
    rows = materialise(df.select(
        key, _content_ref("anchor").alias("anchor_ref"), _content_ref("positive").alias("positive_ref"),
        F.col(anchor_vector).alias("a"), F.col(positive_vector).alias("p"), F.col("positive").isNotNull().alias("has_positive"),
    ), "mined-rows")
    passages = rows.where("has_positive").groupBy("positive_ref").agg(F.min(F.struct(key, "p")).alias("first"))
    passages = passages.select("positive_ref", F.col(f"first.{key}").alias("id"), F.col("first.p").alias("vector"))
    anchors = rows.groupBy("anchor_ref").agg(F.min(F.struct(key, "a")).alias("first"))
    anchors = anchors.select("anchor_ref", F.col(f"first.{key}").alias("query_id"), F.col("first.a").alias("vector"))
    passages, anchors = materialise(passages, "passages"), materialise(anchors, "anchors")
    barred = rows.where("has_positive").select("anchor_ref", "positive_ref").distinct()
    barred = salted_join(barred, passages.select("positive_ref", "id"), ["positive_ref"], ["anchor_ref"])
    barred = salted_join(barred, anchors.select("anchor_ref", "query_id"), ["anchor_ref"], ["positive_ref"])
    index = build_index(passages, path, **options)
    found = search(index, anchors, k, probes, barred, "query_id")
    answers = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("best"))
    answers = anchors.select("anchor_ref", "query_id").join(answers, "query_id").select("anchor_ref", "best")
    mined = salted_join(rows.select(key, "anchor_ref"), answers, ["anchor_ref"], [key])
    return mined.select(key, F.inline("best")).withColumnRenamed("id", "neg_key")
