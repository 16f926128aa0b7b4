"""Substring dedup by hashing of lines, sentences or paragraphs.

Texts are cut into units, units are normalised (lower case, runs of white space as one space,
trimmed) and digested, and of each group of equal units the earliest one stays: the one in
the document with the smallest doc_id, and there the first. The others are removed; all
offsets are code points of the original text. With `lines`, whole lines are units as well,
however short: menus, footers and runs of short sentences repeat as lines, while a sentence
that repeats within different lines is found by its own digest.

Scale: one narrow row per unit (digest, place) is shuffled twice: combined into a count and
the smallest doc_id per digest before the first shuffle, so that a line found in a third of
all documents is one row per task, and for the join with the digests that repeat, in which
adaptive execution splits hot digests. Texts move once, to meet their removed spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pairloom.llm.common import batch, text_or_empty
from pairloom.session import materialise

# a unit ends behind its break
BREAKS = {
    "line": re.compile(r"\n"),
    "sentence": re.compile(r"\n|(?<=[.!?])[\x20\x09-\x0D]+"),
    "paragraph": re.compile(r"\n[\x20\x09\r]*\n\s*"),
}
MIN_WORDS = 5


def units_of(text: str, unit: str, min_words: int) -> Iterator[tuple[int, int, bytes]]:
    """Start, end and digest of each unit of at least `min_words` words."""
    start = 0
    for end in [*(m.end() for m in BREAKS[unit].finditer(text)), len(text)]:
        words = text[start:end].lower().split()
        if len(words) >= max(1, min_words):
            yield start, end, hashlib.blake2b(" ".join(words).encode("utf-8", "replace"), digest_size=16).digest()
        start = end


def with_lines(text: str, unit: str, min_words: int) -> Iterator[tuple[int, int, bytes]]:
    """The units of `units_of` and all lines that are not blank; a line that is a unit counts
    once, with the farther end."""
    found: dict[tuple[int, bytes], int] = {}
    for name, least in ((unit, min_words), ("line", 1)):
        for start, end, digest in units_of(text, name, least):
            found[start, digest] = max(end, found.get((start, digest), 0))
    for (start, digest), end in found.items():
        yield start, end, digest


def apart(spans: list[dict]) -> list[dict]:
    """The spans by start, without those inside others; an overlap goes to the earlier span."""
    out, at = [], 0
    for one in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if one["end"] > at:
            out.append(one | {"start": max(at, one["start"])})
            at = one["end"]
    return out


def repeated_units(
    docs: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS, lines: bool = False
) -> DataFrame:
    """Units to remove: doc_id, text_key, start, end and keep_id, the document that keeps one."""
    units_in = with_lines if lines else units_of
    key = T.StructField("doc_id", docs.schema["doc_id"].dataType)
    schema = T.StructType([
        key, T.StructField("text_key", T.LongType()), T.StructField("digest", T.BinaryType()),
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    ])
    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in arrow}
            for doc_id, text_key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                for start, end, digest in units_in(text.as_py(), unit, min_words):
                    for name, value in zip(out, (doc_id, text_key, digest, start, end)):
                        out[name].append(value)
            yield batch(out, arrow)

    units = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("text_key"), text_or_empty().alias("text")).mapInArrow(cut, schema)
    units = materialise(units, "units")
    groups = (
        units.groupBy("digest")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("doc_id").alias("keep_id"))
        .where(F.col("_n") > 1)
        .drop("_n")
    )
    repeats = materialise(units.join(groups, "digest"), "repeated_units")
    first = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    # rows that repeat a document share its places
    place = F.dense_rank().over(Window.partitionBy("digest").orderBy("text_key", "start"))
    inside = repeats.where(first).withColumn("_place", place).where(F.col("_place") > 1).drop("_place")
    return repeats.where(~first).unionByName(inside).drop("digest")


def line_dedup(
    docs: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS, lines: bool = False
) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, kept_text, and `removed`, an array of
    (start, end, keep_id) by start.

    A null text counts as empty. Units of fewer than `min_words` words are left alone; `lines`
    adds whole lines of any number of words, and spans inside others are not listed. Rows
    that repeat both doc_id and text are one document and lose the same units. Rows without
    doc_id rank last. Other columns are ignored, an empty table gives an empty result.
    """
    removed = (
        repeated_units(docs, unit, min_words, lines)
        .groupBy("doc_id", "text_key")
        .agg(F.array_sort(F.collect_set(F.struct("start", "end", "keep_id"))).alias("removed"))
        .withColumnsRenamed({"doc_id": "_doc_id", "text_key": "_text_key"})
    )
    texts = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("_key"), text_or_empty().alias("text"))
    joined = texts.join(
        removed, (F.col("_key") == F.col("_text_key")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")), "left"
    )
    span = T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
        T.StructField("keep_id", docs.schema["doc_id"].dataType),
    ])
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_chars", T.LongType()),
        T.StructField("kept_text", T.StringType()), T.StructField("removed", T.ArrayType(span)),
    ])
    arrow = to_arrow_schema(schema)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, spans = b.column(1).to_pylist(), [apart(s or []) for s in b.column(2).to_pylist()]
            kept = []
            for text, gone in zip(texts, spans):
                parts, at = [], 0
                for one in gone:
                    parts.append(text[at : one["start"]])
                    at = one["end"]
                kept.append("".join(parts) + text[at:])
            yield batch({
                "doc_id": b.column(0), "n_chars": [len(t) for t in texts],
                "kept_text": kept, "removed": spans,
            }, arrow)

    return joined.select("doc_id", "text", "removed").mapInArrow(keep, schema)
