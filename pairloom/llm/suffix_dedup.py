"""Substring dedup with suffix arrays: remove what a string of `length` bytes repeats.

Every such string holds an anchor, a shorter string chosen by its content alone, so equal
strings hold equal anchors. What lies around an anchor is its context, wide enough for all
the strings that hold it.

1. Fingerprints of anchors and contexts are dealt to buckets. Anchors that occur once are
   dropped, contexts that occur more than once are repeated as a whole. What is left are
   anchors with several contexts: of each such context one occurrence is asked for.
2. These contexts are cut from the texts and dealt to shards by anchor. A shard's suffix
   array is built by induced sorting; from the common prefixes of neighbours in it come the
   strings that occur at two places at least. The contexts of an anchor that has more of them
   than fit a piece are not gathered: their strings of `length` bytes, all of which hold the
   anchor, are dealt to shards by digest and equal digests are counted there.
3. Per document the repeated places are united and removed.

Scale: fingerprints travel in packed rows; copies of a text are one text throughout, however
many there are. Texts move once; of those without a repeated anchor nothing is kept, the
others are written once and meet their spans. Buckets and shards follow
`spark.sql.shuffle.partitions`. A task builds its arrays for pieces of `PIECE_BYTES` at most,
and its shard holds no anchor beyond that; the strings of crowded anchors spread evenly.
Fingerprints have 44 and 64 bits: unequal anchors that meet cost time only, unequal contexts,
strings of crowded anchors or texts would have to meet with probability 2^-64 a pair to
change a result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm import packed
from pairloom.llm.anchors import anchors, gram_hashes
from pairloom.llm.common import _BASE, _BASE_INVERSE, _BYTE_VALUES, mix64, powers, text_or_empty
from pairloom.llm.suffixes import common_prefixes, suffix_array
from pairloom.session import materialise

LENGTH = 200
WIDTH = 100
FLUSH_BYTES = 4 << 20
FLUSH_STRINGS = 1 << 18
PIECE_BYTES = 2 << 20
_POSTINGS = {"anchor": "<u8", "context": "<u8", "at": "<u4", "sides": "<u4", "place": "<u4"}


def _blob(array: np.ndarray, kind: str) -> bytes:
    return zlib.compress(np.ascontiguousarray(array.astype(kind)).tobytes(), 1)


def _array(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), dtype=kind)


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for spans of a few hundred bytes."""
    out = np.empty(len(starts), dtype=np.uint64)
    block, at = 1 << 21, 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            stop = max(at + 1, int(np.searchsorted(starts, starts[at] + block)))
            low, high = int(starts[at]), int(ends[at:stop].max())
            sums = np.zeros(high - low + 1, dtype=np.uint64)
            np.cumsum(_BYTE_VALUES[data[low:high]] * powers(_BASE, high - low), out=sums[1:])
            a, b = starts[at:stop] - low, ends[at:stop] - low
            out[at:stop] = (sums[b] - sums[a]) * powers(_BASE_INVERSE, high - low + 1)[a] + (b - a).astype(np.uint64)
            at = stop
        return mix64(out)


def _postings(docs: DataFrame, length: int, width: int, buckets: int) -> DataFrame:
    """Packed anchors of all texts (text_key, text), dealt by anchor."""
    fringe = length - width
    half = fringe // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[int] = []
        raw: list[bytes] = []
        seen: set[int] = set()
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            data = np.frombuffer(b"".join(raw), dtype=np.uint8)
            bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
            places, marks = anchors(data, bounds, length, width)
            doc = np.searchsorted(bounds, places, side="right") - 1
            low, high = bounds[doc], bounds[doc + 1]
            context = _span_hashes(data, np.maximum(places - fringe, low), np.minimum(places + length, high))
            left = _span_hashes(data, np.maximum(places - fringe + half, low), places)
            right = _span_hashes(data, places + width, np.minimum(places + length - fringe + half, high))
            sides = (left & np.uint64(0xFFFF)) << np.uint64(16) | (right & np.uint64(0xFFFF))
            columns = {"anchor": marks, "context": context, "at": places - low, "sides": sides}
            order = np.lexsort((doc, marks, marks % np.uint64(buckets)))
            bucket = (marks % np.uint64(buckets)).astype(np.int64)[order]
            doc = doc[order]
            cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
            ids = np.array(keys, dtype=np.int64)
            rows: dict[str, list] = {n: [] for n in ("bucket", *_POSTINGS, "owners")}
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if a == b:
                    continue
                mine, place = np.unique(doc[a:b], return_inverse=True)
                rows["bucket"].append(int(bucket[a]))
                for name, column in columns.items():
                    rows[name].append(_blob(column[order[a:b]], _POSTINGS[name]))
                rows["place"].append(_blob(place, "<u4"))
                rows["owners"].append(_blob(ids[mine], "<i8"))
            if rows["bucket"]:
                yield pa.RecordBatch.from_pydict(
                    {"bucket": pa.array(rows.pop("bucket"), pa.int32())}
                    | {n: pa.array(v, pa.binary()) for n, v in rows.items()}
                )

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                data = text.as_py().encode("utf-8", "replace")
                if len(data) < length or key in seen:
                    continue
                keys.append(key)
                raw.append(data)
                seen.add(key)
                held += len(data)
                if held >= FLUSH_BYTES:
                    yield from flush()
                    keys, raw, seen, held = [], [], set(), 0
        if raw:
            yield from flush()

    schema = "bucket int, anchor binary, context binary, at binary, sides binary, place binary, owners binary"
    return docs.select("text_key", "text").mapInArrow(run, schema)


def _read_postings(frame: pd.DataFrame) -> dict[str, np.ndarray]:
    found = {
        n: np.concatenate([_array(b, kind) for b in frame[n]])
        for n, kind in _POSTINGS.items() if n != "place"
    }
    owners = [_array(o, "<i8") for o in frame["owners"]]
    found["owner"] = np.concatenate([o[_array(p, "<u4")] for o, p in zip(owners, frame["place"])])
    return found


def _choose(buckets: int, most: int):
    """Of a bucket's anchors: repeated contexts (1) and contexts to ask for (2), packed by text.
    Anchors with more than `most` contexts to ask for are crowded (4)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        p = _read_postings(frame)
        # of equal postings (copies of one text) one stays
        order = np.lexsort((p["at"], p["owner"], p["context"], p["anchor"]))
        p = {n: v[order] for n, v in p.items()}
        same_anchor = p["anchor"][1:] == p["anchor"][:-1]
        same_context = same_anchor & (p["context"][1:] == p["context"][:-1])
        equal = same_context & (p["owner"][1:] == p["owner"][:-1]) & (p["at"][1:] == p["at"][:-1])
        stay = np.concatenate([[True], ~equal])
        p = {n: v[stay] for n, v in p.items()}
        n = len(p["anchor"])
        new_anchor = np.concatenate([[True], p["anchor"][1:] != p["anchor"][:-1]])
        new_context = new_anchor | np.concatenate([[True], p["context"][1:] != p["context"][:-1]])
        group, context = np.cumsum(new_anchor) - 1, np.cumsum(new_context) - 1
        occurrences = np.bincount(context)
        contexts = np.bincount(group[new_context])
        repeated = (occurrences > 1)[context]
        several = (contexts > 1)[group]
        first = np.flatnonzero(new_context & several)
        # a string that two contexts share lies mostly left or mostly right of the anchor,
        # so the contexts agree on the bytes next to the anchor on that side
        asked = np.zeros(n, dtype=bool)
        for side in (p["sides"] >> 16, p["sides"] & 0xFFFF):
            key = group[first] * (1 << 16) + side[first]
            _, back, count = np.unique(key, return_inverse=True, return_counts=True)
            asked[first[count[back] > 1]] = True
        out: dict[str, list] = {c: [] for c in ("bucket", "owner", "at", "anchor", "kind")}
        wanted = np.flatnonzero(repeated | asked)
        crowded = asked & (np.bincount(group[asked], minlength=n) > most)[group]
        kind = repeated.astype(np.uint8) + 2 * asked + 4 * crowded
        bucket = p["owner"][wanted] % buckets
        by_bucket = np.argsort(bucket, kind="stable")
        wanted, bucket = wanted[by_bucket], bucket[by_bucket]
        cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if a < b:
                at = wanted[a:b]
                out["bucket"].append(int(bucket[a]))
                out["owner"].append(_blob(p["owner"][at], "<i8"))
                out["at"].append(_blob(p["at"][at], "<u4"))
                out["anchor"].append(_blob(p["anchor"][at], "<u8"))
                out["kind"].append(_blob(kind[at], "<u1"))
        return pd.DataFrame(out)

    return run


def _by_text(frame: pd.DataFrame) -> pd.DataFrame:
    """One row per text of a bucket: its anchors by place, and what is known of them."""
    owner = np.concatenate([_array(b, "<i8") for b in frame["owner"]])
    at = np.concatenate([_array(b, "<u4") for b in frame["at"]])
    anchor = np.concatenate([_array(b, "<u8") for b in frame["anchor"]])
    kind = np.concatenate([_array(b, "<u1") for b in frame["kind"]])
    order = np.lexsort((at, owner))
    owner, at, anchor, kind = owner[order], at[order], anchor[order], kind[order]
    cuts = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1, [len(owner)]]).tolist()
    spans = list(zip(cuts[:-1], cuts[1:]))
    return pd.DataFrame({
        "text_key": [int(owner[a]) for a, _ in spans],
        "at": [at[a:b].tobytes() for a, b in spans],
        "anchor": [anchor[a:b].tobytes() for a, b in spans],
        "kind": [kind[a:b].tobytes() for a, b in spans],
        "asks": [bool((kind[a:b] & 6 == 2).any()) for a, b in spans],
        "crowded": [bool((kind[a:b] & 4).any()) for a, b in spans],
    })


def _contexts(texts: DataFrame, length: int, width: int, shards: int) -> DataFrame:
    """Packed contexts that were asked for, without those of crowded anchors, dealt by anchor."""
    fringe = length - width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[tuple]] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows: dict[str, list] = {n: [] for n in ("bucket", "anchor", "owner", "start", "repeated", "size", "bytes")}
            for shard, parts in found.items():
                rows["bucket"].append(shard)
                for i, (name, kind) in enumerate((("anchor", "<u8"), ("owner", "<i8"), ("start", "<u4"), ("repeated", "<u1"))):
                    rows[name].append(np.array([p[i] for p in parts], dtype=kind).tobytes())
                rows["size"].append(np.array([len(p[4]) for p in parts], dtype="<u4").tobytes())
                rows["bytes"].append(zlib.compress(b"".join(p[4] for p in parts), 1))
            yield pa.RecordBatch.from_pydict(
                {"bucket": pa.array(rows.pop("bucket"), pa.int32())}
                | {n: pa.array(v, pa.binary()) for n, v in rows.items()}
            )

        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(5)]
            for key, text, at, anchor, kind in zip(*columns):
                data = text.encode("utf-8", "replace")
                kinds = np.frombuffer(kind, dtype="<u1")
                asked = np.flatnonzero(kinds & 6 == 2)
                for place, mark, known in zip(
                    np.frombuffer(at, dtype="<u4")[asked].tolist(),
                    np.frombuffer(anchor, dtype="<u8")[asked].tolist(), kinds[asked].tolist(),
                ):
                    start = max(0, place - fringe)
                    part = data[start : place + length]
                    found.setdefault(mark % shards, []).append((mark, key, start, known & 1, part))
                    held += len(part) + 64
                if held >= FLUSH_BYTES:
                    yield from flush()
                    found, held = {}, 0
        if found:
            yield from flush()

    schema = "bucket int, anchor binary, owner binary, start binary, repeated binary, size binary, bytes binary"
    return texts.where("asks").select("text_key", "text", "at", "anchor", "kind").mapInArrow(run, schema)


def _strings(texts: DataFrame, length: int, width: int, shards: int) -> DataFrame:
    """Packed digests of the strings in contexts of crowded anchors, dealt by digest."""
    fringe = length - width
    kinds_of = {"digest": "<u8", "owner": "<i8", "at": "<u4", "repeated": "<u1"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(c) for c in zip(*found)]
            shard = (columns[0] % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            columns, shard = [c[order] for c in columns], shard[order]
            cuts = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]])
            rows: dict[str, list] = {n: [] for n in ("bucket", *kinds_of)}
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                rows["bucket"].append(int(shard[a]))
                for column, (name, kind) in zip(columns, kinds_of.items()):
                    rows[name].append(_blob(column[a:b], kind))
            yield pa.RecordBatch.from_pydict(
                {"bucket": pa.array(rows.pop("bucket"), pa.int32())}
                | {n: pa.array(v, pa.binary()) for n, v in rows.items()}
            )

        for b in batches:
            for key, text, at, kind in zip(*[b.column(i).to_pylist() for i in range(4)]):
                data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
                kinds = np.frombuffer(kind, dtype="<u1")
                chosen = kinds & 4 > 0
                places = np.frombuffer(at, dtype="<u4")[chosen].astype(np.int64)
                low, high = np.maximum(places - fringe, 0), np.minimum(places, len(data) - length)
                inside, known = (np.zeros(len(data) + 2, dtype=np.int64) for _ in range(2))
                for marks, mine in ((inside, low <= high), (known, (low <= high) & (kinds[chosen] & 1 > 0))):
                    np.add.at(marks, low[mine], 1)
                    np.add.at(marks, high[mine] + 1, -1)
                starts = np.flatnonzero(np.cumsum(inside) > 0)
                if not len(starts):
                    continue
                digests = gram_hashes(data, length)[starts]
                found.append((digests, np.full(len(starts), key), starts, np.cumsum(known)[starts] > 0))
                held += len(starts)
                if held >= FLUSH_STRINGS:
                    yield from flush()
                    found, held = [], 0
        if found:
            yield from flush()

    schema = "bucket int, digest binary, owner binary, at binary, repeated binary"
    return texts.where("crowded").select("text_key", "text", "at", "kind").mapInArrow(run, schema)


def _match(buckets: int):
    """Of a shard's strings those that occur at two places or are known to, packed by text."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        digest, owner, at, known = (
            np.concatenate([_array(b, kind) for b in frame[n]])
            for n, kind in (("digest", "<u8"), ("owner", "<i8"), ("at", "<u4"), ("repeated", "<u1"))
        )
        order = np.lexsort((at, owner, digest))
        digest, owner, at, known = digest[order], owner[order], at[order], known[order] > 0
        new = np.concatenate([[True], digest[1:] != digest[:-1]])
        place = new | np.concatenate([[True], (owner[1:] != owner[:-1]) | (at[1:] != at[:-1])])
        first = np.flatnonzero(new)
        again = (np.add.reduceat(place.astype(np.int64), first) > 1) | np.logical_or.reduceat(known, first)
        hit = np.flatnonzero(again[np.cumsum(new) - 1] & place & ~known)
        bucket = owner[hit] % buckets
        by_bucket = np.argsort(bucket, kind="stable")
        hit, bucket = hit[by_bucket], bucket[by_bucket]
        cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
        spans = [(a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()) if a < b]
        return pd.DataFrame({
            "bucket": [int(bucket[a]) for a, _ in spans],
            "owner": [_blob(owner[hit[a:b]], "<i8") for a, b in spans],
            "at": [_blob(at[hit[a:b]], "<u4") for a, b in spans],
        })

    return run


def _runs(length: int):
    """Spans of the texts of a bucket that its strings cover."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        owner = np.concatenate([_array(b, "<i8") for b in frame["owner"]])
        at = np.concatenate([_array(b, "<u4") for b in frame["at"]]).astype(np.int64)
        order = np.lexsort((at, owner))
        owner, at = owner[order], at[order]
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (at[1:] > at[:-1] + length)])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        return pd.DataFrame({"text_key": owner[first], "low": at[first], "high": at[last] + length})

    return run


def repeated_strings(
    parts: list[bytes], owners: np.ndarray, starts: np.ndarray, repeated: np.ndarray, length: int
) -> Iterator[tuple[int, int, int]]:
    """Spans (part, from, to) covered by strings that occur at two places at least.

    Part i begins at `starts[i]` of text `owners[i]`; a part that is `repeated` is known to
    occur elsewhere as a whole, and no spans are returned for it. The same place of a text
    may lie in several parts.
    """
    sizes = np.array([len(p) for p in parts])
    text = np.frombuffer(b"\xff".join(parts) + b"\xff\xfe", dtype=np.uint8) + np.uint8(2)
    # UTF-8 has no bytes 254 and 255: the separator becomes 1 and the end 0
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    order = suffix_array(text, depth=2 * length)
    shared = common_prefixes(text, order, begin, 2 * length)
    part = np.repeat(np.arange(len(parts)), sizes + 1)
    part = np.append(part, len(parts) - 1)
    inside = np.arange(len(text)) - begin[part]
    valid = (inside + length <= sizes[part])[order]
    alike = shared[order] >= length
    group = np.cumsum(~alike)[valid]
    place = order[valid].astype(np.int64)
    if not len(place):
        return
    names, owner = np.unique(owners, return_inverse=True)
    absolute = owner[part[place]].astype(np.int64) << 36 | (starts[part[place]].astype(np.int64) + inside[place])
    known = repeated[part[place]].astype(bool)
    first = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1])
    least, most = np.minimum.reduceat(absolute, first), np.maximum.reduceat(absolute, first)
    again = (least != most) | np.logical_or.reduceat(known, first)
    counts = np.diff(np.append(first, len(group)))
    hit = np.sort(place[np.repeat(again, counts) & ~known])
    if not len(hit):
        return
    cut = np.concatenate([[True], (hit[1:] > hit[:-1] + 1) | (part[hit[1:]] != part[hit[:-1]])])
    firsts = np.flatnonzero(cut)
    lasts = np.append(firsts[1:], len(hit)) - 1
    for a, b in zip(hit[firsts].tolist(), hit[lasts].tolist()):
        i = int(part[a])
        yield i, a - int(begin[i]), b - int(begin[i]) + length


def _solve(length: int, piece: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        columns = {
            n: np.concatenate([np.frombuffer(b, dtype=k) for b in frame[n]])
            for n, k in (("anchor", "<u8"), ("owner", "<i8"), ("start", "<u4"), ("repeated", "<u1"), ("size", "<u4"))
        }
        data = b"".join(zlib.decompress(b) for b in frame["bytes"])
        ends = np.cumsum(columns["size"].astype(np.int64))
        # rows that repeat a text ask for the same contexts
        identity = [columns[n] for n in ("size", "start", "owner", "anchor")]
        order = np.lexsort(identity)
        new = np.zeros(len(order), dtype=bool)
        new[:1] = True
        for column in identity:
            new[1:] |= column[order][1:] != column[order][:-1]
        order = order[new]
        anchor = columns["anchor"][order]
        cuts = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, [len(anchor)]])
        size = np.concatenate([[0], np.cumsum(columns["size"][order].astype(np.int64))])
        out: dict[str, list] = {"text_key": [], "low": [], "high": []}
        at = 0
        while at < len(cuts) - 1:
            # whole anchors up to the size of a piece
            stop = max(at + 1, int(np.searchsorted(size[cuts], size[cuts[at]] + piece, side="right")) - 1)
            mine = order[cuts[at] : cuts[stop]]
            at = stop
            if len(mine) < 2:
                continue
            parts = [data[e - s : e] for e, s in zip(ends[mine].tolist(), columns["size"][mine].tolist())]
            for i, low, high in repeated_strings(parts, columns["owner"][mine], columns["start"][mine], columns["repeated"][mine], length):
                start = int(columns["start"][mine[i]])
                out["text_key"].append(int(columns["owner"][mine[i]]))
                out["low"].append(start + low)
                out["high"].append(start + high)
        return pd.DataFrame(out).astype("int64")

    return run


def united(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or touching spans."""
    order = np.argsort(low, kind="stable")
    low, reach = low[order], np.maximum.accumulate(high[order])
    new = np.concatenate([[True], low[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    return low[first], reach[np.append(first[1:], len(low)) - 1]


def suffix_dedup(
    docs: DataFrame, length: int = LENGTH, width: int = WIDTH, piece: int = PIECE_BYTES
) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256 and
    `spans`, an array of (low, high), all in UTF-8 bytes of the text.

    A byte is removed if it is covered by a string of `length` bytes that starts anywhere
    else too, in the same text or another; what is removed elsewhere makes no difference.
    A null text counts as empty. Texts shorter than `length` lose nothing; a longer text that
    occurs in two rows is removed whole, also if the rows have the same doc_id or none. Other
    columns are ignored, an empty table gives an empty result. `piece` bounds the bytes of a
    suffix array and changes no result.
    """
    spark = docs.sparkSession
    buckets = packed.bucket_count(spark)
    fringe = length - width
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("text_key", F.xxhash64("text"))
    encoded = F.encode("text", "utf-8")
    narrow = materialise(
        rows.select("doc_id", "text_key", F.length(encoded).cast("bigint").alias("n_bytes"), F.sha2(encoded, 256).alias("sha")),
        "texts",
    )
    chosen = packed.by_bucket(
        _postings(rows, length, width, buckets), _choose(buckets, max(1, piece // (length + fringe))),
        "bucket int, owner binary, at binary, anchor binary, kind binary",
    )
    plan = packed.by_bucket(chosen, _by_text, "text_key bigint, at binary, anchor binary, kind binary, asks boolean, crowded boolean")
    plan = materialise(plan, "anchors")
    copies = materialise(
        narrow.groupBy("text_key").agg(F.count(F.lit(1)).alias("_copies"), F.min("doc_id").alias("_doc_id")), "text_copies"
    )
    one = plan.join(copies, "text_key").withColumnRenamed("text_key", "_text_key")
    same = (F.col("text_key") == F.col("_text_key")) & F.col("doc_id").eqNullSafe(F.col("_doc_id"))
    texts = materialise(
        rows.join(one.hint("shuffle_hash"), same).select("text_key", "text", "at", "anchor", "kind", "asks", "crowded"), "anchored"
    )
    found = packed.by_bucket(
        _contexts(texts, length, width, buckets * 4), _solve(length, piece), "text_key bigint, low bigint, high bigint"
    )
    matched = packed.by_bucket(
        _strings(texts, length, width, buckets * 4), _match(buckets), "bucket int, owner binary, at binary"
    )
    of_crowded = packed.by_bucket(matched, _runs(length), "text_key bigint, low bigint, high bigint")
    spans = found.unionByName(of_crowded).groupBy("text_key").agg(F.collect_list(F.struct("low", "high")).alias("spans"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(5)]
            out: dict[str, list] = {n: [] for n in ("text_key", "n_removed", "kept_sha256", "spans")}
            for key, text, at, kind, more in zip(*columns):
                data = text.encode("utf-8", "replace")
                whole = np.frombuffer(at, dtype="<u4")[np.frombuffer(kind, dtype="<u1") & 1 > 0].astype(np.int64)
                low = np.concatenate([np.maximum(whole - fringe, 0), np.array([s["low"] for s in more or ()], dtype=np.int64)])
                high = np.concatenate([np.minimum(whole + length, len(data)), np.array([s["high"] for s in more or ()], dtype=np.int64)])
                if not len(low):
                    continue
                low, high = united(low, high)
                digest, before = hashlib.sha256(), 0
                for a, z in zip(low.tolist(), high.tolist()):
                    digest.update(data[before:a])
                    before = z
                digest.update(data[before:])
                out["text_key"].append(key)
                out["n_removed"].append(int((high - low).sum()))
                out["kept_sha256"].append(digest.hexdigest())
                out["spans"].append([{"low": a, "high": z} for a, z in zip(low.tolist(), high.tolist())])
            yield pa.RecordBatch.from_pydict({
                "text_key": pa.array(out["text_key"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()),
                "kept_sha256": pa.array(out["kept_sha256"], pa.string()),
                "spans": pa.array(out["spans"], pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))),
            })

    cut = (
        texts.join(spans, "text_key", "left").select("text_key", "text", "at", "kind", "spans")
        .mapInArrow(remove, "text_key bigint, n_removed bigint, kept_sha256 string, spans array<struct<low:bigint,high:bigint>>")
        .dropDuplicates(["text_key"])
    )
    cut = materialise(cut, "cut").withColumnRenamed("text_key", "_text_key")
    copied = copies.where("_copies > 1").select(F.col("text_key").alias("_copied"))
    all_gone = F.col("_copied").isNotNull() & (F.col("n_bytes") >= length)
    nothing = F.expr("cast(array() as array<struct<low:bigint,high:bigint>>)")
    zero = F.lit(0).cast("bigint")
    return (
        narrow.join(cut, F.col("text_key") == F.col("_text_key"), "left")
        .join(copied, F.col("text_key") == F.col("_copied"), "left")
        .withColumn("spans", F.when(all_gone, F.array(F.struct(zero.alias("low"), F.col("n_bytes").alias("high")))).otherwise(F.coalesce("spans", nothing)))
        .select(
            "doc_id", "n_bytes",
            F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
            F.size("spans").cast("bigint").alias("n_spans"),
            F.when(all_gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
            "spans",
        )
    )
