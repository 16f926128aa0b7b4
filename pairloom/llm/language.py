"""Language ID by nearest centroids of TF-IDF vectors of byte n-grams.

A text's vector counts its byte trigrams (ASCII letters in lower case, other ASCII bytes as
spaces), hashed to `DIMS` places, weighted by inverse document frequency and normalised.
Each language has several centroids, found by spherical k-means. A text gets the language
of the centroid with the largest cosine; a text that is, for its size, too far from all of its language's
centroids is rejected.

Scale: document frequencies come from all training documents, added up per task and then
by place. The centroids are fitted on at most `sample` distinct texts per language, a documented
bound, one task per language; a text counts once there however many copies it has, and what is
shuffled to count them is a hash per row, combined per task. What is broadcast has one vector of `DIMS` places per
centroid. Prediction is a map.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pairloom.llm.common import batch, key_remainder

DIMS = 8192
UNKNOWN = "und"
HAS_LETTER = r"\p{L}"
_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


@dataclass(frozen=True)
class LanguageModel:
    idf: np.ndarray
    languages: list[str]
    """The language of each centroid."""
    centroids: np.ndarray
    floors: np.ndarray
    """Per centroid the cosine below which its language is rejected, for a text of usual size."""
    sizes: np.ndarray
    """Per centroid the usual number of different trigrams in a text of its language."""


def trigram_counts(texts: list[str | None], dims: int = DIMS) -> np.ndarray:
    """One row of hashed trigram counts per text; trigrams without letters are left out."""
    out = np.zeros((len(texts), dims), dtype=np.float32)
    shift = np.uint32(32 - (dims.bit_length() - 1))
    for row, text in zip(out, texts):
        if not text:
            continue
        data = np.frombuffer(b" " + text.encode("utf-8", "replace") + b" ", dtype=np.uint8)
        folded = _FOLD[data].astype(np.uint32)
        letters = (folded != 32).view(np.uint8)
        grams = folded[:-2] << 16 | folded[1:-1] << 8 | folded[2:]
        useful = letters[:-2] + letters[1:-1] + letters[2:] >= 1
        places = grams[useful] * np.uint32(2654435761) >> shift
        row += np.bincount(places, minlength=dims)
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF vectors of length one; a text without trigrams stays zero."""
    vectors = counts * idf
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    return vectors / np.where(norms > 0, norms, 1)[:, None]


def reach(present: np.ndarray, usual: np.ndarray | float) -> np.ndarray:
    """How near a text with so many different trigrams can be, against one of usual size.

    A text of m trigrams has a cosine of about sqrt(m) to a centroid that has many more; beyond
    the usual size nothing is expected of it.
    """
    return np.sqrt(np.minimum(present / usual, 1.0))


def typical(vectors: np.ndarray, trim: float) -> np.ndarray:
    """The vectors without the share `trim` of them that is least like their mean.

    A few texts under a wrong label are far from all others, so they would take whole centroids.
    """
    near = vectors @ vectors.mean(axis=0)
    return vectors[np.sort(np.argsort(near, kind="stable")[int(len(vectors) * trim) :])]


def cluster(vectors: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means; each new start is the vector farthest from the ones before."""
    starts = [vectors.mean(axis=0)]
    near = vectors @ starts[0]
    chosen: list[int] = []
    for _ in range(min(k, len(vectors))):
        chosen.append(int(np.argmin(near)) if chosen else int(np.argmax(near)))
        near = vectors @ vectors[chosen[-1]] if len(chosen) == 1 else np.maximum(near, vectors @ vectors[chosen[-1]])
    centroids = vectors[chosen]
    for _ in range(rounds):
        nearest = np.argmax(vectors @ centroids.T, axis=1)
        moved = np.stack([
            vectors[nearest == i].mean(axis=0) if (nearest == i).any() else centroids[i]
            for i in range(len(centroids))
        ])
        norms = np.linalg.norm(moved, axis=1)
        centroids = moved / np.where(norms > 0, norms, 1)[:, None]
    return centroids


def document_frequencies(docs: DataFrame, dims: int = DIMS, block: int = 256) -> tuple[int, np.ndarray]:
    """Number of texts and in how many of them each place occurs, over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(dims, dtype=np.int64), 0
        for b in batches:
            for at in range(0, b.num_rows, block):
                texts = b.column(0).slice(at, block).to_pylist()
                total += (trigram_counts(texts, dims) > 0).sum(axis=0)
                rows += len(texts)
        found = np.flatnonzero(total)
        places = np.append(found, dims)
        yield pa.RecordBatch.from_pydict({"place": places, "n": np.append(total[found], rows)})

    counted = docs.select("text").mapInArrow(count, "place bigint, n bigint")
    sums = counted.groupBy("place").agg(F.sum("n").alias("n")).toPandas()  # dims + 1 rows at most
    table = np.zeros(dims + 1, dtype=np.int64)
    table[sums["place"].to_numpy(dtype=np.int64)] = sums["n"].to_numpy(dtype=np.int64)
    return int(table[dims]), table[:dims]


def fit(
    labelled: DataFrame, sample: int = 1000, clusters: int = 3, dims: int = DIMS,
    reject_share: float = 0.2, seed: str = "language", trim: float = 0.02,
) -> LanguageModel:
    """Fit on the rows of `labelled` (text, lang) with a text and a language.

    `sample` bounds the distinct texts per language that centroids are fitted on; document
    frequencies cover all rows. The share `trim` of the sampled texts that is least like the
    language's mean is left out, so up to that share of wrong labels moves no centroid; samples
    below 1 / trim texts are taken whole. A language rejects texts whose cosine is below
    `reject_share` times the smallest cosine within the rest, where cosines are divided by
    what a text of that size can reach (`reach`).
    """
    labelled = labelled.where(F.col("text").rlike(HAS_LETTER) & F.col("lang").isNotNull())
    labelled = labelled.select("text", "lang")
    n, frequencies = document_frequencies(labelled, dims)
    idf = (np.log((1 + n) / (1 + frequencies)) + 1).astype(np.float32)
    # copies of a text share its hash, so they are counted and drawn as one text
    unit = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "text")), 1, 12), 16, 10).cast("double") / float(1 << 48)
    hashed = labelled.withColumn("_unit", unit)
    distinct = hashed.select("lang", "_unit").groupBy("lang", "_unit").agg(F.lit(1).alias("_one"))
    counts = distinct.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per language
    if not counts:
        return LanguageModel(idf, [], np.zeros((0, dims), dtype=np.float32), np.zeros(0), np.zeros(0))
    texts = F.element_at(F.create_map(*[F.lit(x) for row in counts for x in (row["lang"], row["n"])]), F.col("lang"))
    order = Window.partitionBy("lang").orderBy("_unit")
    # about 1.5 times the bound pass the filter on the hash, the window keeps the bound
    chosen = (
        hashed.where(F.col("_unit") * texts <= 1.5 * sample + 10)
        .groupBy("lang", "_unit").agg(F.min("text").alias("text"))
        .withColumn("_place", F.row_number().over(order))
        .where(F.col("_place") <= sample)
        .select("lang", "text")
    )

    def fit_language(key: tuple[str], rows: pd.DataFrame) -> pd.DataFrame:
        texts = sorted(rows["text"])
        vectors = weighted(trigram_counts(texts, dims), idf)
        vectors = vectors[vectors.any(axis=1)]
        if not len(vectors):
            return pd.DataFrame({"lang": [], "centroid": [], "floor": [], "usual": []})
        vectors = typical(vectors, trim)
        centroids = cluster(vectors, clusters)
        present = np.count_nonzero(vectors, axis=1)
        usual = float(np.median(present))
        floor = float(((vectors @ centroids.T).max(axis=1) / reach(present, usual)).min()) * reject_share
        return pd.DataFrame({
            "lang": key[0],
            "centroid": [c.astype("<f4").tobytes() for c in centroids],
            "floor": floor,
            "usual": usual,
        })

    fitted = chosen.groupBy("lang").applyInPandas(fit_language, "lang string, centroid binary, floor double, usual double")
    found = sorted(fitted.toPandas().itertuples(index=False), key=lambda r: (r.lang, bytes(r.centroid)))
    centroids = [np.frombuffer(r.centroid, dtype="<f4") for r in found]
    return LanguageModel(
        idf, [r.lang for r in found],
        np.stack(centroids) if found else np.zeros((0, dims), dtype=np.float32),
        np.array([r.floor for r in found]),
        np.array([r.usual for r in found]),
    )


def predict(docs: DataFrame, model: LanguageModel, block: int = 256) -> DataFrame:
    """Rows of `docs` as struct `row` with lang_pred, score and rejected.

    A text that is null or has no letter is `und` with score 0 and rejected, as are all texts
    if no language was learned. Others get a learned language even when they are rejected.
    Ties go to the language that sorts first. Text is the only column that is looked at.
    """
    schema = T.StructType([
        T.StructField("row", T.StructType(docs.schema.fields)),
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("rejected", T.BooleanType()),
    ])
    arrow = to_arrow_schema(schema)
    columns, idf = model.centroids.T.copy(), model.idf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            languages, scores, rejected = [], [], []
            known = b.column(2).to_pylist()
            for at in range(0, b.num_rows, block):
                texts = [t if k and len(columns[0]) else None for t, k in zip(b.column(1).slice(at, block).to_pylist(), known[at : at + block])]
                counts = trigram_counts(texts, len(idf))
                present = np.count_nonzero(counts, axis=1)
                near = weighted(counts, idf) @ columns if len(columns[0]) else None
                for i, text in enumerate(texts):
                    if text is None:
                        languages.append(UNKNOWN)
                        scores.append(0.0)
                        rejected.append(True)
                        continue
                    best = int(np.argmax(near[i]))
                    languages.append(model.languages[best])
                    scores.append(float(np.clip(near[i, best], 0, 1)))
                    rejected.append(bool(scores[-1] < model.floors[best] * reach(present[i], model.sizes[best])))
            yield batch({"row": b.column(0), "lang_pred": languages, "score": scores, "rejected": rejected}, arrow)

    return docs.select(
        F.struct(*docs.columns).alias("row"),
        F.col("text").alias("_text"),
        F.coalesce(F.col("text").rlike(HAS_LETTER), F.lit(False)).alias("_known"),
    ).mapInArrow(run, schema)


def held_out(folds: int = 5) -> Column:
    return held_out_of("doc_id", folds)


def held_out_of(column: str, folds: int = 5) -> Column:
    return key_remainder(column, folds) == 0
