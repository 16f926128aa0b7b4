"""Hierarchical multi-length packing of tokenised documents.

Documents are routed to context-size tiers by their length. A document longer than the
largest tier fills whole windows of it; what is left of it, and every shorter document,
opens a window of the smallest tier that holds it. The gap of a window is filled from
shorter tiers, the longest piece that fits first; when none fits, the shortest piece is cut
to the size of the gap. Every window ends exactly full, so no sequence needs padding: only
the last window of a task is divided into powers of two. Windows of one tier are dealt to
step groups of equal token counts.

Scale: one map over the documents and no shuffle. A task holds one buffer of tokens, and
pieces that did not fill a window wait for the next buffer, so memory does not grow with
the input and a hot source or group of copies needs no special care.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pairloom.llm.common import batch

TIERS = (1024, 512, 256, 128)
END_ID = 0
Piece = tuple[int, int, int]
"""Length, document (its place in the buffer) and first id of a piece."""


def byte_bpe(folder: str | None = None) -> Callable[[str], np.ndarray]:
    """Ids of `byte_bpe_50k.json` as the tokenizers library gives them.

    The same vocabulary is read as ranks by a faster encoder; texts with a special token or
    with letters beyond the Latin blocks, where the two could split differently, go to the
    tokenizers library itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    def place(name: str) -> str:
        return f"{folder}/{name}" if folder else public_tokenizers.path(name)

    with open(place("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding(
        "byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    slow = Tokenizer.from_file(place("byte_bpe_50k.json"))

    def encode(text: str) -> np.ndarray:
        data = text.encode("utf-8", "replace")
        if not data:
            return np.empty(0, dtype="<u4")
        exotic = np.frombuffer(data, dtype=np.uint8).max() >= 0xC9
        if exotic or "<|endoftext|>" in text:
            ids = slow.encode(text, add_special_tokens=False).ids
        else:
            ids = fast.encode_ordinary(text)
        return np.array(ids, dtype="<u4")

    return encode


def fill_windows(
    pool: list[Piece], tiers: Sequence[int], last: bool
) -> Iterator[tuple[int, list[Piece]]]:
    """Windows (size, pieces) made of `pool`, a sorted list that is used up.

    If pieces run out before a window is full, they go back to the pool, or, with `last`,
    into windows of powers of two.
    """
    sizes = sorted(tiers)
    while pool:
        first = pool.pop()
        size = sizes[bisect_left(sizes, first[0])] if first[0] <= sizes[-1] else sizes[-1]
        if first[0] > size:
            insort(pool, (first[0] - size, first[1], first[2] + size))
            yield size, [(size, first[1], first[2])]
            continue
        window, gap = [first], size - first[0]
        while gap and pool:
            at = bisect_right(pool, (gap, np.inf, np.inf)) - 1
            if at >= 0:
                piece = pool.pop(at)
            else:
                whole = pool.pop(0)
                piece = (gap, whole[1], whole[2])
                insort(pool, (whole[0] - gap, whole[1], whole[2] + gap))
            window.append(piece)
            gap -= piece[0]
        if not gap:
            yield size, window
        elif last:
            yield from _powers_of_two(window)
        else:
            for piece in window:
                insort(pool, piece)
            return


def _powers_of_two(window: list[Piece]) -> Iterator[tuple[int, list[Piece]]]:
    left = sum(piece[0] for piece in window)
    window = window[::-1]
    while left:
        size = gap = 1 << (left.bit_length() - 1)
        part = []
        while gap:
            length, doc, start = window.pop()
            used = min(length, gap)
            part.append((used, doc, start))
            if used < length:
                window.append((length - used, doc, start + used))
            gap -= used
        left -= size
        yield size, part


def pack(
    docs: DataFrame, tiers: Sequence[int] = TIERS, folder: str | None = None,
    buffer_tokens: int = 1 << 20, step_tokens: int = 1 << 16, with_ids: bool = False,
) -> DataFrame:
    """Pack all rows of `docs` (doc_id, text) into sequences; one row per piece.

    Columns: doc_id, start (ids of the row's text before the piece), length, ids_crc32,
    doc_tokens, sequence_id, offset (place in the sequence), tier (the sequence's size, a
    power of two, filled exactly), step_group, and with `with_ids` the ids themselves.
    A text is its ids and one `END_ID`; a null or empty text is that single id. A repeated
    row is packed as often as it occurs. A null doc_id is kept as null. An empty table gives
    an empty result. Sequence ids are unique within one run; they follow the partitions.
    """
    fields = [
        T.StructField("doc_id", docs.schema["doc_id"].dataType),
        *[T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group")],
    ]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)
    tiers = tuple(sorted(tiers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(folder)
        number = TaskContext.get().partitionId() << 40
        sequences, steps = 0, dict.fromkeys(range(64), 0)
        pool: list[Piece] = []
        kept: dict[int, tuple[object, np.ndarray]] = {}
        held, place = 0, 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal sequences, kept, held
            out: dict[str, list] = {f.name: [] for f in arrow}
            for size, window in fill_windows(pool, tiers, last):
                offset, level = 0, size.bit_length() - 1
                group = number | level << 32 | steps[level] // max(1, step_tokens // size)
                steps[level] += 1
                for length, doc, start in window:
                    key, ids = kept[doc]
                    part = ids[start : start + length]
                    row = (key, start, length, zlib.crc32(part.tobytes()), len(ids), number | sequences, offset, size, group)
                    for name, value in zip(out, row):
                        out[name].append(value)
                    if with_ids:
                        out["ids"].append(part.astype(np.int32))
                    offset += length
                sequences += 1
            waiting = {piece[1] for piece in pool}
            kept = {doc: kept[doc] for doc in waiting}
            held = sum(len(ids) for _, ids in kept.values())
            if out["start"]:
                yield batch(out, arrow)

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                kept[place] = (key, ids)
                insort(pool, (len(ids), place, 0))
                place += 1
                held += len(ids)
                if held >= buffer_tokens:
                    yield from flush(False)
        yield from flush(True)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
