"""Hierarchical Pitman-Yor language model, seated by Gibbs sampling.

Tokens are words and one end per text. The context of a token are the two words before it, each
told apart by its 64-bit hash. Its restaurant's parent is that of the word before alone, whose
parent is the one without context, over a uniform base of the V training words and one unknown.
A word's customers in a context are its occurrences there, a restaurant's customers are the
tables of its children. Contexts grow with the corpus.

In a Gibbs sweep all customers of a dish leave their tables, and those of its parent, and the
number of tables they take again is drawn given the tables that the other dishes had after the
sweep before: with discount d, t tables of n customers have probability in proportion to the
generalised Stirling number S_d(n, t) times the weights of opening them. Predictive
probabilities are averaged over the samples after burn-in.

Scale: a token goes to the bucket of the word before it, so the restaurants of its context and
of that word lie in one bucket with all their entries and totals. Words that would fill a bucket
(`_crowded_words`) are dealt by both words before; what such a word's restaurant has of each
dish is added up by the dish's owner. After each sweep a bucket tells every word's owner the
tables that the word has there, and the owner draws those of the crowded words' restaurants and
of the root, and answers; they name the words to each other once. Tokens are shuffled once, half of the buckets at a
time; what they were shuffled for is deleted when it is written. The driver gets sums: a few
numbers and two per crowded word, of which there are at most twice as many as buckets. A bucket
with more than `SALT_TOKENS` tokens answers runs of texts in several tasks. Nothing of the
vocabulary passes the driver. Buckets follow `spark.sql.shuffle.partitions`.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pairloom.llm.common import TextBatch, key_remainder, mix64, word_hashes
from pairloom.llm.packed import bucket_count, read_places, small_places
from pairloom.session import discard, discard_path, materialise

END = np.uint64(0x5EED0FE4DEADBEEF)
START = np.uint64(0x0B5E55EDCAFEF00D)
WORD_BITS, BEFORE_BITS = 17, 4
"""Bits of the slots of the word before a token, and of the one before that: they deal tokens to
buckets and name no restaurant."""
PARENTS, CONTEXTS = 1 << WORD_BITS, 1 << (WORD_BITS + BEFORE_BITS)
SALT_TOKENS = 1 << 25
LARGE = 256
"""Most customers of a dish whose tables are drawn from their exact distribution; for more, the
distribution's saddle point is used."""
FLUSH_BYTES = 8 << 20
PARTS, TURNS = 2, 2
"""Tokens are shuffled in `PARTS` parts, of every `PARTS`th bucket, and scored in `TURNS` of each."""


def _blob(array: np.ndarray, kind: str) -> bytes:
    return zlib.compress(np.ascontiguousarray(array.astype(kind)).tobytes(), 1)


def _array(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), dtype=kind)


def _slot(words: np.ndarray, bits: int) -> np.ndarray:
    return (words >> np.uint64(64 - bits)).astype(np.uint32)


def _row(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts as one row of hashes, each after two starts and before its end; the places of
    all tokens, ends included, and their texts' numbers."""
    found = TextBatch(texts)
    words = word_hashes(found)
    counts = np.diff(found.first)
    n = len(texts)
    first = found.first[:-1] + 3 * np.arange(n)
    row = np.full(len(words) + 3 * n, START)
    row[np.arange(len(words)) + np.repeat(3 * np.arange(n) + 2, counts)] = words
    row[first + 2 + counts] = END
    token = np.ones(len(row), dtype=bool)
    token[first] = token[first + 1] = False
    return row, np.flatnonzero(token), np.repeat(np.arange(n), counts + 1)


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of every token, of the word before it and of the one before that, and its text's
    number."""
    row, at, text = _row(texts)
    return row[at], row[at - 1], row[at - 2], text


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hash, slot of the context and text number of every token, ends included."""
    words, before, earlier, text = trigrams(texts)
    return words, _slots(before, earlier), text


def _slots(before: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    return _slot(before, WORD_BITS) << np.uint32(BEFORE_BITS) | _slot(earlier, BEFORE_BITS)


def _dealt(before: np.ndarray, earlier: np.ndarray, crowded: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each context: that of the word before, or of both if that is crowded."""
    bucket = ((_slots(before, earlier) >> np.uint32(BEFORE_BITS)) % np.uint32(buckets)).astype(np.int64)
    if len(crowded):
        many = np.flatnonzero(_lookup(crowded, before)[1])
        bucket[many] = (mix64(mix64(before[many]) ^ earlier[many]) % np.uint64(buckets)).astype(np.int64)
    return bucket


def _slices(b: pa.RecordBatch) -> Iterator[tuple[int, int, list[str | None]]]:
    """Runs of rows with about `FLUSH_BYTES` of text."""
    texts, at, size, held = b.column(0), 0, 0, []
    for i in range(b.num_rows):
        held.append(texts[i].as_py())
        size += len(held[-1] or "") + 1
        if size >= FLUSH_BYTES:
            yield at, i + 1, held
            at, size, held = i + 1, 0, []
    if held:
        yield at, b.num_rows, held


@dataclass
class Entries:
    """The restaurants' entries of some words.

    Entry i of level 2 is (word[i], context[i]) with count[i] customers; entries of level 1 are
    the distinct (word, word before) pairs `pair_word`, `pair_context`, and `pair[i]` is the
    parent of entry i. `pairs` gives the latter three; without them entries are sorted by word
    and context, and the word before is what the context has above `BEFORE_BITS`.
    """

    words: np.ndarray
    word: np.ndarray
    context: np.ndarray
    count: np.ndarray
    pairs: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def __post_init__(self):
        if self.pairs is not None:
            self.pair, self.pair_word, self.pair_context = self.pairs
            return
        # entries are sorted, so those of a parent follow each other
        key = self.word * PARENTS + (self.context >> BEFORE_BITS)
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        self.pair = np.cumsum(new) - 1
        self.pair_word, self.pair_context = key[new] // PARENTS, key[new] % PARENTS


@dataclass
class Totals:
    """Customers and tables of every restaurant, by level from the root (0) up."""

    customers: list[np.ndarray]
    tables: list[np.ndarray]
    discounts: tuple[float, ...] = (0.5, 0.5, 0.5)
    strengths: tuple[float, ...] = (1.0, 1.0, 1.0)
    n_tokens: int = 0
    n_words: int = 0

    def back_off(self, level: int) -> np.ndarray:
        """Mass that a restaurant hands to its parent."""
        return (self.strengths[level] + self.discounts[level] * self.tables[level]) / (
            self.strengths[level] + self.customers[level]
        )

    def own(self, level: int, customers: np.ndarray, tables: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Mass of a dish in its own restaurant."""
        return np.maximum(customers - self.discounts[level] * tables, 0) / (
            self.strengths[level] + self.customers[level][context]
        )

def log_stirling(n: int, discount: float) -> np.ndarray:
    """log S_d(i, t) for i, t up to n: ways to seat i customers at t tables."""
    out = np.full((n + 1, n + 1), -np.inf)
    out[0, 0] = 0
    t = np.arange(1, n + 1)
    for i in range(n):
        stay = np.maximum(i - discount * t, 0)
        with np.errstate(divide="ignore"):
            out[i + 1, 1:] = np.logaddexp(out[i, :-1], np.log(stay) + out[i, 1:])
    return out


def seat(
    customers: np.ndarray, weight: Callable[[np.ndarray, np.ndarray], np.ndarray], discount: float,
    rng: np.random.Generator,
) -> np.ndarray:
    """Tables of each dish after seating its customers; `weight(dishes, tables)` is that of a
    further table of some dishes, given how many they have."""
    tables = np.minimum(customers, 1).astype(np.int64)
    ways = log_stirling(min(LARGE, max(1, int(customers.max(initial=1)))), discount)
    low = 1
    while low < len(ways) - 1:
        high = min(2 * low, LARGE)
        chosen = np.flatnonzero((customers > low) & (customers <= high))
        for at in range(0, len(chosen), max(1, (1 << 20) // high)):
            mine = chosen[at:at + max(1, (1 << 20) // high)]
            n = customers[mine].astype(int)
            top = int(n.max())
            logs = ways[n, 1:top + 1].copy()
            held = np.zeros(len(mine))
            for t in range(1, top):
                held = held + np.log(weight(mine, np.full(len(mine), t)))
                logs[:, t] += held
            logs -= logs.max(axis=1, keepdims=True)
            shares = np.cumsum(np.exp(logs), axis=1)
            tables[mine] = 1 + (shares < (rng.random(len(mine)) * shares[:, -1])[:, None]).sum(axis=1)
        low = high
    crowded = np.flatnonzero(customers > LARGE)
    if len(crowded):
        tables[crowded] = _crowded(customers[crowded], lambda t: weight(crowded, t), discount, rng)
    return tables


def _crowded(
    customers: np.ndarray, weight: Callable[[np.ndarray], np.ndarray], discount: float, rng: np.random.Generator
) -> np.ndarray:
    """Tables of dishes with many customers.

    S_d(n, t) is n! / (d^t t!) times the coefficient of z^n in (1 - (1 - z)^d)^t. At its saddle
    point, y = 1 - z, t tables belong to n (1 - y^d) / (d y^(d - 1) (1 - y)), and a further
    table multiplies the number by (1 - y^d) / (d t). Where that times its weight is one lies
    the mean of the tables after the first, which are close to Poisson.
    """
    low, high = np.full(len(customers), -700.0), np.zeros(len(customers))
    for _ in range(60):
        y = (low + high) / 2
        share = -np.expm1(discount * y)
        t = np.maximum(customers * share / (discount * np.exp((discount - 1) * y) * np.maximum(-np.expm1(y), 1e-300)), 1e-12)
        more = weight(t) * share > discount * t
        low, high = np.where(more, y, low), np.where(more, high, y)
    return np.clip(1 + rng.poisson(t), 1, customers)


def _weights(
    totals: Totals, level: int, context: np.ndarray, own: np.ndarray, parent: np.ndarray,
    customers: np.ndarray, tables: np.ndarray, grand: np.ndarray,
) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Weight of a further table of a level's dishes, whose `own` tables are taken away.

    `customers` and `tables` are those of the same dish in the parent context `parent`, and
    `grand` is what the parent hands on: its back-off times its own parent's probability.
    """
    d, up = totals.discounts[level], level - 1
    free = totals.strengths[level] + d * (totals.tables[level][context] - own)
    others = customers - own
    room = totals.strengths[up] + totals.customers[up][parent] - own

    def weight(dishes: np.ndarray, t: np.ndarray) -> np.ndarray:
        shared = np.where(others[dishes] > 0, tables[dishes], np.minimum(t, 1))
        mass = np.maximum(others[dishes] + t - totals.discounts[up] * shared, 0) / (room[dishes] + t)
        return (free[dishes] + d * t) * (mass + grand[dishes])

    return weight


def _seat_contexts(
    e: Entries, top: np.ndarray, middle: np.ndarray, below: np.ndarray, p0: np.ndarray, totals: Totals,
    rng: np.random.Generator,
) -> np.ndarray:
    """New tables of the entries of level 2; `below` are the customers of their parents, `p0`
    are the words' probabilities without context."""
    back = totals.back_off(1)[e.pair_context] * p0[e.pair_word]
    parent = e.pair_context[e.pair]
    return seat(
        e.count, _weights(totals, 2, e.context, top, parent, below[e.pair], middle[e.pair], back[e.pair]),
        totals.discounts[2], rng,
    )


def _seat_pairs(
    customers: np.ndarray, middle: np.ndarray, context: np.ndarray, root: np.ndarray, bottom: np.ndarray,
    totals: Totals, rng: np.random.Generator,
) -> np.ndarray:
    """New tables of entries of level 1, whose words have `root` customers at `bottom` tables
    without context."""
    handed = np.full(len(customers), totals.back_off(0)[0] / (totals.n_words + 1))
    none = np.zeros(len(customers), dtype=int)
    return seat(
        customers, _weights(totals, 1, context, middle, none, root, bottom, handed), totals.discounts[1], rng
    )


def _seat_root(customers: np.ndarray, bottom: np.ndarray, totals: Totals, rng: np.random.Generator) -> np.ndarray:
    free = totals.strengths[0] + totals.discounts[0] * (totals.tables[0][0] - bottom)
    base = 1 / (totals.n_words + 1)
    return seat(customers, lambda dishes, t: (free[dishes] + totals.discounts[0] * t) * base, totals.discounts[0], rng)


def _word_shares(root: np.ndarray, bottom: np.ndarray, totals: Totals) -> np.ndarray:
    """Probabilities of words without context."""
    return totals.own(0, root, bottom, np.zeros(len(root), dtype=int)) + totals.back_off(0) / (totals.n_words + 1)


def sweep(
    entries: Entries, state: list[np.ndarray], totals: Totals, rng: np.random.Generator
) -> list[np.ndarray]:
    """Tables per entry of levels 0, 1, 2 after one Gibbs sweep over all restaurants."""
    e, (bottom, middle, top) = entries, state
    below = np.bincount(e.pair_word, middle, len(e.words))
    p0 = _word_shares(below, bottom, totals)
    top = _seat_contexts(e, top, middle, np.bincount(e.pair, top, len(e.pair_word)), p0, totals, rng)
    customers = np.bincount(e.pair, top, len(e.pair_word)).astype(np.int64)
    middle = _seat_pairs(customers, middle, e.pair_context, below[e.pair_word], bottom[e.pair_word], totals, rng)
    customers = np.bincount(e.pair_word, middle, len(e.words)).astype(np.int64)
    return [_seat_root(customers, bottom, totals, rng), middle, top]


def _lookup(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), max(0, len(table) - 1))
    return at, (table[at] == keys) if len(table) else np.zeros(len(keys), dtype=bool)


def _crowded_words(docs: DataFrame, buckets: int) -> np.ndarray:
    """Sorted hashes of the words that would take the better part of a bucket.

    A slice of texts lists its words that have a share of 1 / (2 `buckets`) there; those whose
    listed occurrences are that share of all tokens are taken, so a word with twice the share
    is never missed.
    """
    share = 1 / (2 * buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, texts in _slices(b):
                before = trigrams(texts)[1]
                names, counts = np.unique(before, return_counts=True)
                many = counts >= share * len(before)
                yield pa.RecordBatch.from_pydict({
                    "word": pa.array([None, *names[many].astype(np.int64).tolist()], pa.int64()),
                    "n": pa.array([len(before), *counts[many].tolist()], pa.int64()),
                })

    listed = docs.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    listed = materialise(listed, "crowded")
    tokens = listed.where("word IS NULL").select("n").first()
    found = listed.where(F.col("word").isNotNull() & (F.col("n") >= share * tokens["n"])).collect() if tokens else []
    discard(listed)
    return np.sort(np.array([r["word"] for r in found], dtype=np.int64).astype(np.uint64))


def _pack(places: np.ndarray, below: int) -> bytes:
    return zlib.compress(small_places(places, below), 1)


def _unpack(blob: bytes, below: int) -> np.ndarray:
    return read_places(zlib.decompress(blob), below).astype(np.int64)


def _posting_rows(docs: DataFrame, crowded: np.ndarray, buckets: int, part: int) -> DataFrame:
    """Tokens of a part of the buckets, by bucket and run of texts: the words' hashes, and in
    order of (word before, the one before that) the places of the three words and the text.

    The row of bucket 0 also lists the run's texts. `digest` is that of all the run's tokens.
    """
    key = docs.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("bucket", T.IntegerType()), T.StructField("run", T.LongType()), T.StructField("digest", T.LongType()),
        T.StructField("texts", T.IntegerType()),
        *[T.StructField(n, T.BinaryType()) for n in ("held", "names", "before", "earlier", "words", "places")],
        T.StructField("doc_ids", T.ArrayType(key)), T.StructField("held_out", T.ArrayType(T.BooleanType())),
        T.StructField("n_tokens", T.ArrayType(T.LongType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            ids, held = b.column(1).to_pylist(), b.column(2).to_pylist()
            for start, stop, texts in _slices(b):
                row, at, text = _row(texts)
                digest = int(np.bitwise_xor.reduce(mix64(row + np.arange(len(row), dtype=np.uint64))) >> np.uint64(12))
                lengths = np.bincount(text, minlength=len(texts)).tolist()
                bucket = _dealt(row[at - 1], row[at - 2], crowded, buckets)
                names, back = np.unique(row, return_inverse=True)
                mine = np.flatnonzero(bucket % PARTS == part)
                at = at[mine]
                v, u, w = back[at - 1], back[at - 2], back[at]
                bucket, text = bucket[mine], text[mine]
                order = np.argsort(bucket << 48 | v << 24 | u) if len(names) < 1 << 24 else np.lexsort((u, v, bucket))
                bucket, v, u, w, text = bucket[order], v[order], u[order], w[order], text[order]
                cuts = np.searchsorted(bucket, np.arange(buckets + 1))
                used, place = np.zeros(len(names), dtype=bool), np.zeros(len(names), dtype=np.int64)
                flags = np.packbits(np.array(held[start:stop], dtype=bool)).tobytes()
                for i in range(part, buckets, PARTS):
                    if i and cuts[i] == cuts[i + 1]:
                        continue
                    at = slice(cuts[i], cuts[i + 1])
                    used[v[at]] = used[u[at]] = used[w[at]] = True
                    some = np.flatnonzero(used)
                    used[some], place[some] = False, np.arange(len(some))
                    yield pa.RecordBatch.from_pylist([{
                        "bucket": i, "run": number, "digest": digest, "texts": len(texts), "held": flags,
                        "names": names[some].tobytes(),
                        "before": _pack(np.diff(place[v[at]], prepend=0), len(some)),
                        "earlier": _pack(place[u[at]], len(some)), "words": _pack(place[w[at]], len(some)),
                        "places": _pack(text[at], len(texts)),
                        "doc_ids": ids[start:stop] if i == 0 else None,
                        "held_out": held[start:stop] if i == 0 else None,
                        "n_tokens": lengths if i == 0 else None,
                    }], schema=arrow)
                number += 1

    arrow = to_arrow_schema(schema)
    return docs.select("text", "doc_id", "held_out").mapInArrow(run, schema)


_STRUCTURE = (
    "owners", "crowded_parents", "crowded_numbers", "parent_pairs", "parent_contexts", "pair_words", "pair_sizes", "ranks", "counts",
)
_BUCKET = "bucket int, " + ", ".join(f"{n} binary" for n in _STRUCTURE) + ", tokens bigint, state array<binary>"
_TOLD = "bucket int, owner int, numbers array<binary>, shared array<binary>, state array<binary>, samples array<array<binary>>, kind string"
_OWNER = (
    "owner int, bucket int, numbers array<binary>, shared array<binary>, sums array<bigint>, asking array<int>, sizes array<int>"
    ", places array<binary>, pairs array<binary>, pair_parents binary, pair_words binary, state array<binary>, kind string"
)


def _columns(schema: str) -> list[str]:
    return [x.partition(" ")[0] for x in schema.split(", ")]


def _build_schema(id_type: str) -> str:
    return _BUCKET + (
        ", sums array<bigint>, owner int, names binary, numbers array<binary>, shared array<binary>"
        ", run bigint, digest bigint, texts int, entries binary, places binary"
        f", doc_ids array<{id_type}>, held_out array<boolean>, n_tokens array<bigint>, kind string"
    )


def _frame(rows: list[dict], schema: str) -> pd.DataFrame:
    """Rows that lack some of the columns."""
    whole = {"bigint": "Int64", "int": "Int32"}
    out = {}
    for column in schema.split(", "):
        name, kind = column.split(" ", 1)
        values = [r.get(name) for r in rows]
        out[name] = pd.array(values, dtype=whole[kind]) if kind in whole else pd.Series(values, dtype=object)
    return pd.DataFrame(out)


def _build(crowded: np.ndarray, owners: int, schema: str):
    """A bucket's row of entries; per run of texts a row of its tokens, as entries and texts; and
    what the owners of its words must know at first.

    Entries are those of all tokens; only tokens of texts to learn count. They lie in order of
    (word before, word, the word before that): contexts are told by their rank among those of
    the word before.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        names = [np.frombuffer(n, dtype="<u8") for n in frame["names"]]
        words, back = np.unique(np.concatenate(names), return_inverse=True)
        shift = np.cumsum([0, *(len(n) for n in names)])
        of_run = [back[a:b] for a, b in zip(shift, shift[1:])]
        u, w = (
            np.concatenate([m[_unpack(x, len(m))] for m, x in zip(of_run, frame[n])]).astype(np.int64) for n in ("earlier", "words")
        )
        v = np.concatenate([m[np.cumsum(_unpack(x, len(m)))] for m, x in zip(of_run, frame["before"])]).astype(np.int64)
        texts = [_unpack(x, n) for x, n in zip(frame["places"], frame["texts"])]
        learned = np.concatenate([
            ~np.unpackbits(np.frombuffer(h, dtype=np.uint8), count=n).astype(bool)[t] for h, n, t in zip(frame["held"], frame["texts"], texts)
        ])
        contexts, context = np.unique(v << 32 | u, return_inverse=True)
        pairs, pair = np.unique(v << 32 | w, return_inverse=True)
        keys, entry = np.unique(pair.astype(np.int64) << 32 | context, return_inverse=True)
        del u, v, w, pair, context
        count = np.bincount(entry[learned], minlength=len(keys))
        parents = np.unique(pairs >> 32)
        used, pair_words = np.unique(pairs & 0xFFFFFFFF, return_inverse=True)
        # words in order of their owners
        words_used = words[used]
        owner = (words_used % np.uint64(owners)).astype(np.int64)
        order = np.argsort(owner, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        pair_words = rank[pair_words]
        first = np.searchsorted(contexts >> 32, parents)
        pair, context = keys >> 32, keys & 0xFFFFFFFF
        parent = np.searchsorted(parents, pairs >> 32)
        below = np.bincount(pair, np.minimum(count, 1), len(pairs)).astype(np.int64)
        number, is_crowded = _lookup(crowded, words[parents])
        own = below[~is_crowded[parent]]
        row = {
            "kind": "bucket", "bucket": int(frame["bucket"].iloc[0]),
            "owners": _blob(np.bincount(owner, minlength=owners), "<u4"),
            "crowded_parents": _blob(np.flatnonzero(is_crowded), "<u4"), "crowded_numbers": _blob(number[is_crowded], "<u4"),
            "parent_pairs": _blob(np.bincount(parent, minlength=len(parents)), "<u4"),
            "parent_contexts": _blob(np.diff(np.append(first, len(contexts))), "<u4"),
            "pair_words": _blob(pair_words, "<u4"), "pair_sizes": _blob(np.bincount(pair, minlength=len(pairs)), "<u4"),
            "ranks": _blob(context - first[parent[pair]], "<u4"), "counts": _blob(count, "<u4"),
            "tokens": len(entry), "sums": [int((x == n).sum()) for x in (own, count) for n in (1, 2)],
            "state": [_blob(np.minimum(count, 1), "<u4"), _blob(np.minimum(below, 1), "<u4")],
        }
        cuts = np.cumsum([0, *(len(t) for t in texts)])
        rows = [row]
        for r, t, a, b in zip(frame.itertuples(index=False), texts, cuts, cuts[1:]):
            mine = entry[a:b]
            order_of_run = np.argsort(mine, kind="stable")
            rows.append({
                "kind": "run", "bucket": row["bucket"], "run": int(r.run), "digest": int(r.digest), "texts": int(r.texts),
                "entries": _blob(np.diff(mine[order_of_run], prepend=0), "<u4"), "places": _pack(t[order_of_run], int(r.texts)),
                "doc_ids": r.doc_ids, "held_out": r.held_out, "n_tokens": r.n_tokens,
            })
        mine = Bucket(SimpleNamespace(**row))
        mine.read(row["state"])
        learned = np.bincount(mine.e.word, mine.e.count, mine.n_words)
        for m in mine.messages():
            a, b = mine.cuts[m["owner"]], mine.cuts[m["owner"] + 1]
            pairs_told = mine.shared[mine.shared_cuts[m["owner"]]:mine.shared_cuts[m["owner"] + 1]]
            told = mine.number[mine.e.pair_context[pairs_told]], mine.e.pair_word[pairs_told] - a
            rows.append(m | {
                "kind": "names", "bucket": row["bucket"], "names": words_used[order[a:b]].tobytes(),
                "numbers": [*m["numbers"], _blob(learned[a:b], "<u4")], "shared": [*m["shared"], *(_blob(x, "<u4") for x in told)],
            })
        return _frame(rows, schema)

    return run


@dataclass
class Known:
    """What all buckets know after a sweep: sums over the root, those of crowded words'
    restaurants, and what the first state settles."""

    customers: int = 0
    tables: int = 0
    crowded_customers: np.ndarray | None = None
    crowded_tables: np.ndarray | None = None
    discounts: tuple[float, ...] = (0.5, 0.5, 0.5)
    n_tokens: int = 0
    n_words: int = 0

    def totals(self, customers: list[np.ndarray], tables: list[np.ndarray]) -> Totals:
        """With those of further levels."""
        return Totals(
            [np.array([self.customers]), *customers], [np.array([self.tables]), *tables], self.discounts,
            n_tokens=self.n_tokens, n_words=self.n_words,
        )


class Bucket:
    """A bucket's entries and their state: tables of level 2 and 1, and of its words the
    customers and tables without context and how often they were learned. For pairs of a
    crowded word (`shared`), customers and tables are those of all buckets. Words lie in the
    order of their owners."""

    def __init__(self, row):
        def read(name: str) -> np.ndarray:
            return _array(getattr(row, name), "<u4").astype(np.int64)

        self.cuts = np.cumsum([0, *read("owners")])
        self.n_words = int(self.cuts[-1])
        per_parent, contexts = read("parent_pairs"), read("parent_contexts")
        self.n_parents, self.n_contexts = len(per_parent), int(contexts.sum())
        pair_context, pair_word = np.repeat(np.arange(self.n_parents), per_parent), read("pair_words")
        pair = np.repeat(np.arange(len(pair_word)), read("pair_sizes"))
        first = np.cumsum(contexts) - contexts
        context = first[pair_context[pair]] + read("ranks")
        self.e = Entries(np.arange(self.n_words), pair_word[pair], context, read("counts"), (pair, pair_word, pair_context))
        self.crowded_parents = read("crowded_parents")
        self.number = np.full(self.n_parents, -1)
        self.number[self.crowded_parents] = read("crowded_numbers")
        is_shared = self.number[pair_context] >= 0
        self.shared, self.own = np.flatnonzero(is_shared), np.flatnonzero(~is_shared)
        self.shared = self.shared[np.argsort(pair_word[self.shared], kind="stable")]
        self.shared_cuts = np.searchsorted(pair_word[self.shared], self.cuts)

    def read(self, state: list[bytes]) -> None:
        self.top, self.middle, *rest = (_array(x, "<u4").astype(np.int64) for x in state)
        self.root, self.bottom, self.learned, shared = rest or (*np.zeros((3, self.n_words), dtype=np.int64), None)
        self.below = np.bincount(self.e.pair, self.top, len(self.e.pair_word)).astype(np.int64)
        self.mine = self.below[self.shared]
        if shared is not None:
            self.below[self.shared] = shared

    def written(self) -> list[bytes]:
        return [_blob(x, "<u4") for x in (self.top, self.middle, self.root, self.bottom, self.learned, self.below[self.shared])]

    def messages(self) -> Iterator[dict]:
        """To each owner of some of the words: what the root and the crowded words' restaurants
        get from here."""
        word = self.e.pair_word[self.own]
        root = np.bincount(word, self.middle[self.own], self.n_words)
        for i in np.flatnonzero(np.diff(self.cuts)).tolist():
            some = slice(self.shared_cuts[i], self.shared_cuts[i + 1])
            yield {
                "owner": i, "numbers": [_blob(root[self.cuts[i]:self.cuts[i + 1]], "<u4")],
                "shared": [_blob(self.mine[some], "<u4")],
            }

    def take(self, owners: list[int], numbers: list[list[bytes]], shared: list[list[bytes]]) -> None:
        """The owners' answers, in the order of what they were told."""
        for i, own, some in zip(owners, numbers, shared):
            at = slice(self.cuts[i], self.cuts[i + 1])
            self.root[at], self.bottom[at], self.learned[at] = (_array(x, "<u4") for x in own)
            pairs = self.shared[self.shared_cuts[i]:self.shared_cuts[i + 1]]
            self.below[pairs], self.middle[pairs] = (_array(x, "<u4") for x in some)

    def totals(self, known: Known) -> Totals:
        e = self.e
        customers = np.bincount(e.pair_context, self.below, self.n_parents)
        tables = np.bincount(e.pair_context, self.middle, self.n_parents)
        at = self.number[self.crowded_parents]
        customers[self.crowded_parents] = known.crowded_customers[at]
        tables[self.crowded_parents] = known.crowded_tables[at]
        return known.totals(
            [customers, np.bincount(e.context, e.count, self.n_contexts)], [tables, np.bincount(e.context, self.top, self.n_contexts)]
        )

    def draw(self, known: Known, rng: np.random.Generator) -> None:
        e, totals = self.e, self.totals(known)
        p0 = _word_shares(self.root, self.bottom, totals)
        self.top = _seat_contexts(e, self.top, self.middle, self.below, p0, totals, rng)
        below = np.bincount(e.pair, self.top, len(e.pair_word)).astype(np.int64)
        word = e.pair_word[self.own]
        self.middle[self.own] = _seat_pairs(
            below[self.own], self.middle[self.own], e.pair_context[self.own], self.root[word], self.bottom[word], totals, rng
        )
        self.below, self.mine = below, below[self.shared]

    def probabilities(self, known: Known) -> np.ndarray:
        """Of each entry's word in its context."""
        e, totals = self.e, self.totals(known)
        p0 = _word_shares(self.root, self.bottom, totals)
        p1 = totals.own(1, self.below, self.middle, e.pair_context) + totals.back_off(1)[e.pair_context] * p0[e.pair_word]
        return totals.own(2, e.count, self.top, e.context) + totals.back_off(2)[e.context] * p1[e.pair]


def _numbers(blobs) -> list[np.ndarray]:
    return [_array(x, "<u4").astype(np.int64) for x in blobs]


def _owned(row: dict, names: list, state: list[np.ndarray], crowded: int) -> pd.DataFrame:
    """An owner's row, answers to all buckets that have some of its words, and sums."""
    root, bottom, learned, below, middle = state
    rows = [row | {"kind": "owner", "state": [_blob(x, "<u4") for x in state]}]
    for bucket, at, some in names:
        rows.append({
            "kind": "answer", "owner": row["owner"], "bucket": bucket,
            "numbers": [_blob(x[at], "<u4") for x in (root, bottom, learned)], "shared": [_blob(x[some], "<u4") for x in (below, middle)],
        })
    sums = [root.sum(), bottom.sum(), (learned > 0).sum(), learned.sum()]
    sums += [(x == n).sum() for x in (below, root) for n in (1, 2)]
    parents = _array(row["pair_parents"], "<u4")
    sums += [*np.bincount(parents, below, crowded), *np.bincount(parents, middle, crowded)]
    rows.append({"kind": "sums", "owner": row["owner"], "sums": [int(x) for x in sums]})
    return _frame(rows, _OWNER)


def _first_owned(crowded: int):
    """Owners' words and pairs, with one table for each that was learned."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("bucket")
        names = [np.frombuffer(n, dtype="<u8") for n in frame["names"]]
        words, back = np.unique(np.concatenate(names), return_inverse=True)
        cuts = np.cumsum([0, *(len(n) for n in names)])
        tables, learned = (np.concatenate(x) for x in zip(*map(_numbers, frame["numbers"])))
        told = [_numbers(x) for x in frame["shared"]]
        mine, parent, place = (np.concatenate(x) for x in zip(*told))
        ends = np.cumsum([0, *(len(x[0]) for x in told)])
        keys = parent * len(words) + back[place + np.repeat(cuts[:-1], np.diff(ends))]
        pairs, pair = np.unique(keys, return_inverse=True)
        pair_parent, pair_word = pairs // len(words), pairs % len(words)
        below = np.bincount(pair, mine, len(pairs)).astype(np.int64)
        middle = np.minimum(below, 1)
        root = (np.bincount(back, tables, len(words)) + np.bincount(pair_word, middle, len(words))).astype(np.int64)
        learned = np.bincount(back, learned, len(words)).astype(np.int64)
        asking = frame["bucket"].tolist()
        parts = [(n, back[a:b], pair[c:d]) for n, a, b, c, d in zip(asking, cuts, cuts[1:], ends, ends[1:])]
        row = {
            "owner": int(frame["owner"].iloc[0]), "asking": asking, "sizes": [len(words), len(pairs)],
            "places": [_blob(x, "<u4") for _, x, _ in parts], "pairs": [_blob(x, "<u4") for _, _, x in parts],
            "pair_parents": _blob(pair_parent, "<u4"), "pair_words": _blob(pair_word, "<u4"),
        }
        return _owned(row, parts, [root, np.minimum(root, 1), learned, below, middle], crowded)

    return run


def _own(number: int, known: Known, crowded: int, seed: int):
    """Seats the crowded words' restaurants and then the root for an owner's words."""

    def run(key: tuple, frame: pd.DataFrame, messages: pd.DataFrame) -> pd.DataFrame:
        row = {n: frame[n].iloc[0] for n in ("owner", "asking", "sizes", "places", "pairs", "pair_parents", "pair_words")}
        row["owner"] = int(row["owner"])
        rng = np.random.Generator(np.random.PCG64([seed, number, row["owner"], 1]))
        n_words, n_pairs = row["sizes"]
        parts = [(int(n), a, b) for n, a, b in zip(row["asking"], _numbers(row["places"]), _numbers(row["pairs"]))]
        told = {int(n): (_numbers(x)[0], _numbers(y)[0]) for n, x, y in zip(messages["bucket"], messages["numbers"], messages["shared"])}
        root, below = np.zeros(n_words, dtype=np.int64), np.zeros(n_pairs, dtype=np.int64)
        for bucket, at, some in parts:
            # a bucket names a word or pair once
            root[at] += told[bucket][0]
            below[some] += told[bucket][1]
        old_root, old_bottom, learned, _, old_middle = _numbers(frame["state"].iloc[0])
        parent, word = _numbers([row["pair_parents"], row["pair_words"]])
        totals = known.totals([known.crowded_customers], [known.crowded_tables])
        middle = _seat_pairs(below, old_middle, parent, old_root[word], old_bottom[word], totals, rng)
        root += np.bincount(word, middle, n_words).astype(np.int64)
        return _owned(row, parts, [root, _seat_root(root, old_bottom, totals, rng), learned, below, middle], crowded)

    return run


def _sums(rows: DataFrame) -> list[int]:
    """The arrays `sums` added up place by place."""
    found = rows.where(F.col("sums").isNotNull()).select(F.posexplode("sums").alias("at", "n"))
    return [int(r["n"]) for r in found.groupBy("at").agg(F.sum("n").alias("n")).orderBy("at").collect()]


def _answered(frame: pd.DataFrame, told: pd.DataFrame) -> tuple[Bucket, list[list[bytes]]]:
    """A bucket in the state it was left in, with the owners' answers, and its kept samples."""
    row = next(frame.itertuples(index=False))
    mine = Bucket(row)
    left = told[told["kind"] == "state"]
    mine.read(list(left["state"].iloc[0]) if len(left) else row.state)
    answers = told[told["kind"] == "answer"]
    mine.take(*(answers[n].astype(int).tolist() if n == "owner" else answers[n].tolist() for n in ("owner", "numbers", "shared")))
    return mine, [list(x) for x in left["samples"].iloc[0]] if len(left) else []


def _step(number: int, known: Known, keep: bool, seed: int):
    """A bucket's next state, and what it tells owners; the state before, which their answers
    complete, is kept as a sample."""

    def run(key: tuple, frame: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return _frame([], _TOLD)
        bucket = int(frame["bucket"].iloc[0])
        mine, samples = _answered(frame, told)
        if keep:
            samples.append(mine.written())
        mine.draw(known, np.random.Generator(np.random.PCG64([seed, number, bucket, 0])))
        rows = [{"kind": "state", "bucket": bucket, "state": mine.written(), "samples": samples}]
        return _frame(rows + [m | {"kind": "message", "bucket": bucket} for m in mine.messages()], _TOLD)

    return run


def _kind(table: DataFrame, kind: str) -> DataFrame:
    return table.where(F.col("kind") == kind)


def train(
    docs: DataFrame, burn_in: int = 1, samples: int = 2, seed: int = 17, buckets: int | None = None
) -> tuple[list[DataFrame], DataFrame, list[Known]]:
    """The model of the texts in `docs` that are not held out: tables with a row per bucket of its
    entries and rows of the tokens of all texts; what completes the buckets, by bucket: their
    samples and state, and the owners' answers to it; and what all buckets know in each sample.
    Discounts come from counts of counts of the first state."""
    buckets = buckets or model_buckets(docs)
    crowded = _crowded_words(docs, buckets)
    schema = _build_schema(docs.schema["doc_id"].dataType.simpleString())
    parts = [
        materialise(
            _posting_rows(docs, crowded, buckets, part).groupBy("bucket").applyInPandas(_build(crowded, owner_count(buckets), schema), schema),
            "restaurants", ["kind"],
        )
        for part in range(PARTS)
    ]
    table = reduce(lambda a, b: a.unionByName(b), parts)
    model = _kind(table, "bucket").select(*_columns(_BUCKET))
    asked = _kind(table, "names").select("owner", "bucket", "names", "numbers", "shared")
    owners = materialise(asked.groupBy("owner").applyInPandas(_first_owned(len(crowded)), _OWNER), "owners", ["kind"])
    for part in parts:
        discard_path(docs.sparkSession, f"{part._scratch_path}/kind=names")
    first, entries, states = _sums(_kind(owners, "sums")), _sums(_kind(table, "bucket")), None
    if not first:
        return parts, _told(owners, None), [Known(crowded_customers=np.zeros(0), crowded_tables=np.zeros(0))]

    def discount(once: int, twice: int) -> float:
        return float(np.clip(once / max(1.0, once + 2 * twice), 0.1, 0.95))

    discounts = discount(first[6], first[7]), discount(first[4] + entries[0], first[5] + entries[1]), discount(*entries[2:])

    def learned(sums: list[int]) -> Known:
        n = 8 + len(crowded)
        return Known(sums[0], sums[1], np.array(sums[8:n]), np.array(sums[n:]), discounts, first[3], first[2])

    known, kept = learned(first), []
    for number in range(burn_in + samples):
        step = _step(number, known, number > burn_in, seed)
        drawn = model.groupBy("bucket").cogroup(_told(owners, states).groupBy("bucket")).applyInPandas(step, _TOLD)
        old, states = states, materialise(drawn, "states", ["kind"])
        messages = _kind(states, "message").select("owner", "bucket", "numbers", "shared")
        seated = _kind(owners, "owner").groupBy("owner").cogroup(messages.groupBy("owner"))
        last, owners = owners, materialise(
            seated.applyInPandas(_own(number, known, len(crowded), seed), _OWNER), "owners", ["kind"]
        )
        discard(last, *([old] if old is not None else []))
        known = learned(_sums(_kind(owners, "sums")))
        if number >= burn_in:
            kept.append(known)
    return parts, _told(owners, states), kept or [known]


def _told(owners: DataFrame, states: DataFrame | None) -> DataFrame:
    """By bucket, the owners' answers and the state that they complete."""
    columns = _columns(_TOLD)
    answers = _kind(owners, "answer").select("bucket", "owner", "numbers", "shared", "kind")
    if states is None:
        none = {"state": "array<binary>", "samples": "array<array<binary>>"}
        return answers.withColumns({n: F.lit(None).cast(t) for n, t in none.items()}).select(*columns)
    left = _kind(states, "state").select("bucket", "state", "samples", "kind")
    return answers.unionByName(left, allowMissingColumns=True).select(*columns)


def owner_count(buckets: int) -> int:
    """Every bucket has a row for every owner in an exchange, so owners are fewer."""
    return max(8, -(-buckets // 8))


def model_buckets(docs: DataFrame) -> int:
    """Twice the shuffle partitions: a bucket's entries are worked on as a whole."""
    return min(1 << 16, 2 * bucket_count(docs.sparkSession))


def _answer(kept: list[Known]):
    """Sums per text of a bucket's tokens: base, score and known tokens."""

    def run(key: tuple, rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        mine, samples = _answered(rows[rows["kind"] == "bucket"], told)
        p = np.zeros(len(mine.e.word))
        for known, state in zip(kept, [*samples, mine.written()]):
            mine.read(state)
            p += mine.probabilities(known)
        log = np.log10(p / len(kept))
        n = kept[0].n_tokens + kept[0].n_words + 1
        base = np.log10((mine.learned + 1) / n)[mine.e.word]
        known = (mine.learned > 0)[mine.e.word]
        out: dict[str, list] = {n: [] for n in _SUMS}
        for r in rows[rows["kind"] == "run"].itertuples(index=False):
            texts = int(r.texts)
            entry, places = np.cumsum(_array(r.entries, "<u4").astype(np.int64)), _unpack(r.places, texts)
            out["run"].append(int(r.run))
            out["digest"].append(int(r.digest))
            out["at"].append(int(r.bucket))
            out["base"].append(np.bincount(places, base[entry], texts).astype("<f8").tobytes())
            out["score"].append(np.bincount(places, log[entry], texts).astype("<f8").tobytes())
            out["known"].append(_blob(np.bincount(places, known[entry], texts), "<u4"))
            for name in ("doc_ids", "held_out", "n_tokens"):
                out[name].append(getattr(r, name))
        return pd.DataFrame({name: pd.Series(values, dtype=None if values else object) for name, values in out.items()})

    return run


_SUMS = ("run", "digest", "at", "base", "score", "known", "doc_ids", "held_out", "n_tokens")


def _added(frame: pd.DataFrame) -> pd.DataFrame:
    """The sums of a run's texts over some buckets."""
    if frame["digest"].nunique() > 1:
        raise ValueError("the texts came in other runs when they were read again; write them to a table first")
    # the same order whatever order the parts came in
    parts, listed = frame.sort_values("at"), frame[frame["doc_ids"].notna()]
    sums = {k: sum(np.frombuffer(x, dtype="<f8") for x in parts[k]).tobytes() for k in ("base", "score")}
    known = _blob(sum(_array(x, "<u4").astype(np.int64) for x in parts["known"]), "<u4")
    row = {"run": int(frame["run"].iloc[0]), "digest": int(frame["digest"].iloc[0]), "at": int(parts["at"].iloc[0])} | sums | {"known": known}
    row |= {n: listed[n].iloc[0] if len(listed) else None for n in ("doc_ids", "held_out", "n_tokens")}
    return pd.DataFrame({n: pd.Series([x], dtype=None if isinstance(x, int) else object) for n, x in row.items()})


def _gather(train_tokens: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        row = _added(frame).iloc[0]
        return pd.DataFrame({
            "doc_id": pd.Series(list(row["doc_ids"]), dtype=object), "held_out": list(row["held_out"]),
            "n_tokens": list(row["n_tokens"]), "n_known": _array(row["known"], "<u4").astype(np.int64),
            "train_tokens": train_tokens, "base_score": np.frombuffer(row["base"], dtype="<f8"),
            "score": np.frombuffer(row["score"], dtype="<f8"),
        })

    return run


def score(docs: DataFrame, folds: int = 7, fold: int = 2, burn_in: int = 1, samples: int = 2) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score and score, both log10 probabilities of the whole text.

    Learned are the texts whose crc32 of doc_id as text, modulo `folds`, is not `fold`; a
    missing doc_id counts as empty text there. A null or empty text is its end alone. Rows
    that repeat are learned and scored as often as they occur. Words not learned share the
    unknown word's probability. Without training texts every probability is 1. Other columns
    are ignored; an empty table gives an empty result.
    """
    key = docs.schema["doc_id"].dataType
    marked = docs.select("doc_id", "text", (key_remainder("doc_id", folds) == fold).alias("held_out"))
    buckets = model_buckets(docs)
    parts, told, kept = train(marked, burn_in, samples, buckets=buckets)
    id_type = key.simpleString()
    sums = (
        "run bigint, digest bigint, at int, base binary, score binary, known binary"
        f", doc_ids array<{id_type}>, held_out array<boolean>, n_tokens array<bigint>"
    )
    # a bucket with many tokens answers in several tasks
    salts = F.array(*[F.lit(1 + n // SALT_TOKENS) for n in _bucket_tokens(parts, buckets)])
    of_bucket = F.get(salts, F.col("bucket"))
    all_salts = F.sequence(F.lit(0), of_bucket - 1)
    own_salt = F.array(F.pmod(F.xxhash64("run"), of_bucket).cast("int"))
    found = []
    for part, rows in enumerate(parts):
        rows = rows.where(F.col("kind") != "names").drop("sums", "owner", "names", "numbers", "shared")
        for turn in range(TURNS):
            some = F.floor(F.col("bucket") / PARTS) % TURNS == turn
            asked = rows.where(some).withColumn("salt", F.explode(F.when(F.col("kind") == "bucket", all_salts).otherwise(own_salt)))
            mine = told.where(some & (F.col("bucket") % PARTS == part)).withColumn("salt", F.explode(all_salts))
            answers = asked.groupBy("bucket", "salt").cogroup(mine.groupBy("bucket", "salt")).applyInPandas(_answer(kept), sums)
            found.append(materialise(answers.groupBy("run").applyInPandas(_added, sums), "scores"))
    discard(*parts)
    return reduce(lambda a, b: a.unionByName(b), found).groupBy("run").applyInPandas(
        _gather(kept[0].n_tokens),
        f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    )


def _bucket_tokens(parts: list[DataFrame], buckets: int) -> list[int]:
    out = [0] * buckets
    for part in parts:
        for r in _kind(part, "bucket").select("bucket", "tokens").collect():
            out[r["bucket"]] = int(r["tokens"])
    return out
