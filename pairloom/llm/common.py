"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def one_space(column: Column) -> Column:
    """Each run of ASCII white space becomes one space."""
    return F.regexp_replace(column, SPACES, " ")


def word_count(column: Column) -> Column:
    return F.regexp_count(column, F.lit(WORD)).cast("bigint")


def key_remainder(column: str, modulus: int) -> Column:
    """crc32 of a key as text, modulo `modulus`; a missing key counts as the empty text."""
    key = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(F.encode(key, "utf-8")) % modulus


def batch(columns: dict[str, Iterable], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) for f in schema], schema=schema
    )


class TextBatch:
    """The texts of an Arrow column as one byte array, with word and document bounds.

    `data` holds the UTF-8 bytes with A-Z in lower case, texts separated by one space;
    `starts` and `ends` bound the words, `first[i]:first[i + 1]` are the words of text i.
    """

    _TABLE = np.arange(256, dtype=np.uint8)
    _TABLE[65:91] += 32
    _IS_SPACE = np.zeros(256, dtype=bool)
    _IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

    def __init__(self, texts: list[str | None]):
        raw = [t.encode("utf-8", "replace") if t else b"" for t in texts]
        self.data = self._TABLE[np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)]
        sizes = np.fromiter((len(r) + 1 for r in raw), dtype=np.int64, count=len(raw))
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        space = self._IS_SPACE[self.data]
        inside = ~space
        change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            change = np.concatenate([[0], change])
        self.starts, self.ends = change[0::2], change[1::2]
        self.first = np.searchsorted(self.starts, offsets)


_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUES = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RNG.integers(2**62, 2**63)) * 8 + 5 & (2**64 - 1)
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        steps = np.full(n, np.uint64(base))
        steps[:1] = 1
        return np.multiply.accumulate(steps)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept for the next batch."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = _POWERS[base] = _powers(base, max(n, 1 << 16))
    return known[:n]


def word_hashes(texts: TextBatch, block: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of all words: polynomial sums over random values of the bytes.

    Equal words hash alike in every batch; two words meet with probability about 2^-60.
    """
    starts, ends = texts.starts, texts.ends
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            stop = max(at + 1, int(np.searchsorted(ends, starts[at] + block, side="right")))
            low, high = int(starts[at]), int(ends[stop - 1])
            n = high - low
            sums = np.zeros(n + 1, dtype=np.uint64)
            values = _BYTE_VALUES[texts.data[low:high]]
            values *= powers(_BASE, n)
            np.cumsum(values, out=sums[1:])
            a, b = starts[at:stop] - low, ends[at:stop] - low
            out[at:stop] = (sums[b] - sums[a]) * powers(_BASE_INVERSE, n + 1)[a]
            at = stop
        return mix64(out)


def text_slices(texts: list[str | None], size: int = 4 << 20) -> Iterator[list[str | None]]:
    """The texts in runs of about `size` characters, to bound what is computed at once."""
    held, total = [], 0
    for text in texts:
        held.append(text)
        total += len(text or "") + 1
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held
