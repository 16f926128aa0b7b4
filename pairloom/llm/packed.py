"""Postings in packed rows: many (key, owner) pairs of one bucket in one row.

A task gathers its pairs, deals them to buckets by key and writes one row of byte strings per
bucket, so a pair costs its own bytes and no row of its own. Owners are listed once per row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "bucket int, keys binary, places binary, owners binary, sizes binary"
_NAMES = ("bucket", "keys", "places", "owners", "sizes")


def bucket_count(spark: SparkSession) -> int:
    """As many buckets as the session has shuffle partitions, which is set to suit the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def few_buckets(spark: SparkSession) -> int:
    """Half of that, for postings whose owners are listed again in every bucket."""
    return max(16, bucket_count(spark) // 2)


def small_places(places: np.ndarray, owners: int) -> bytes:
    return places.astype("<u2" if owners <= 1 << 16 else "<u4").tobytes()


def read_places(blob: bytes, owners: int) -> np.ndarray:
    return np.frombuffer(blob, dtype="<u2" if owners <= 1 << 16 else "<u4")


def pack(
    keys: np.ndarray, owners: np.ndarray, owner_ids: np.ndarray, owner_sizes: np.ndarray,
    buckets: int, by: np.ndarray | None = None,
) -> Iterator[pa.RecordBatch]:
    """Rows of pairs (keys[i], owner_ids[owners[i]]), dealt by `by` or else by the key.

    A pair that occurs twice is written once.
    """
    order = np.lexsort((owners, keys))
    keys, owners = keys[order], owners[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
    keys, owners = keys[new], owners[new]
    bucket = ((keys if by is None else by[order][new]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    keys, owners, bucket = keys[order], owners[order], bucket[order]
    cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
    rows: dict[str, list] = {n: [] for n in _NAMES}
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if a == b:
            continue
        mine, places = np.unique(owners[a:b], return_inverse=True)
        rows["bucket"].append(int(bucket[a]))
        rows["keys"].append(keys[a:b].tobytes())
        rows["places"].append(small_places(places, len(mine)))
        rows["owners"].append(owner_ids[mine].tobytes())
        rows["sizes"].append(owner_sizes[mine].astype("<u4").tobytes())
    if rows["bucket"]:
        yield pa.RecordBatch.from_pydict(
            {"bucket": pa.array(rows["bucket"], pa.int32())}
            | {n: pa.array(rows[n], pa.binary()) for n in _NAMES[1:]}
        )


def unpack(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of a bucket by key and owner: keys, owners (places), their ids and sizes."""
    ids = np.frombuffer(b"".join(frame["owners"]), dtype="<u8")
    sizes = np.frombuffer(b"".join(frame["sizes"]), dtype="<u4")
    counts = [len(o) // 8 for o in frame["owners"]]
    shift = np.cumsum([0, *counts])[:-1]
    owner_ids, first, back = np.unique(ids, return_index=True, return_inverse=True)
    keys = np.frombuffer(b"".join(frame["keys"]), dtype="<u8")
    owners = np.concatenate([
        back[s + read_places(p, n).astype(np.int64)] for s, n, p in zip(shift, counts, frame["places"])
    ]).astype(np.int64)
    order = np.lexsort((owners, keys))
    keys, owners = keys[order], owners[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
    return keys[new], owners[new], owner_ids, sizes[first]


def by_bucket(packed: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return packed.groupBy("bucket").applyInPandas(function, schema)
