"""N-gram Jaccard join with prefix trees, and the groups it links.

Texts become sets of distinct 64-bit shingle hashes. Equal sets are one class, so copies
are never paired. The exact join at similarity `percent`/100 runs in four steps, each of
which loses no link:

1. Of the smallest shingles of two linked sets in any common order, a fifth of a set and
   `SPARE` percent more, at least about `SPARE` percent of the set are common. Taken in hash
   order, these shingles are dealt to buckets; classes that share fewer with any others
   leave, among them most texts that only have some lines or a passage in common.
2. For the others the shingles that occur in more than one class are found and counted. A
   class with too many shingles of its own cannot be linked and leaves.
3. Taken from the rarest up, the shared shingles give prefixes that only texts which are
   really alike have in common: their connected classes are candidate groups.
4. A candidate group stores its sets, ordered from the most frequent shingle down, in a trie
   with one node per shared run. A set walks the trie once, adding up the overlap it shares
   with all sets below a node, and leaves a subtree when the remaining lengths cannot reach
   the overlap that is needed, when its lengths do not fit, or when all sets below are
   connected with it already.

Scale: texts are read twice and moved at most once; shingles travel in packed rows. Buckets
follow `spark.sql.shuffle.partitions`. Groups above `limit` classes are joined block against
block in several tasks. Two different shingles or sets are taken as equal with probability
2^-64 a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pairloom.llm import packed
from pairloom.llm.common import TextBatch, batch, mix64, text_or_empty, text_slices, word_hashes
from pairloom.llm.graph import components
from pairloom.session import discard, materialise

WORDS = 5
PERCENT = 80
SPARE = 10
LIMIT = 4096
FLUSH = 1_500_000
_ROTATE = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[str | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a short text is one shingle."""
    for part in text_slices(texts):
        yield from _shingle_sets(TextBatch(part), words)


def _shingle_sets(texts: TextBatch, words: int) -> Iterator[np.ndarray]:
    hashes = word_hashes(texts)
    with np.errstate(over="ignore"):
        n = max(0, len(hashes) - words + 1)
        rolled = np.zeros(n, dtype=np.uint64)
        for i in range(words):
            rolled = rolled * _ROTATE + hashes[i : i + n]
        rolled = mix64(rolled)
        for a, b in zip(texts.first[:-1].tolist(), texts.first[1:].tolist()):
            if b - a >= words:
                yield np.unique(rolled[a : b - words + 1])
            elif b > a:
                one = np.uint64(b - a)
                for h in hashes[a:b]:
                    one = one * _ROTATE + h
                yield mix64(np.array([one], dtype=np.uint64))
            else:
                yield hashes[:0]


def set_class(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little") >> 1


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def sure_overlap(n: int) -> int:
    """How many common shingles the samples of two sets of `n` and more are to have."""
    return max(1, n * SPARE // 100)


def sample_length(n: int, percent: int) -> int:
    """Sets of n and m shingles with the overlap o that links them have min(l) common ones
    among their n - o + l and m - o + l smallest, and o is at least `percent` of either."""
    return min(n, prefix_length(n, percent) - 1 + sure_overlap(n))


def least_shared(n: int, percent: int) -> int:
    """Common shingles of a set's sample with that of the smallest set it can be linked to."""
    return sure_overlap(-(-n * percent // 100))


def linked(overlap, n, m, percent: int):
    """Whether sets of n and m with that overlap link; numbers or arrays."""
    return 100 * overlap >= percent * (n + m - overlap)


class Trie:
    """Sets of ordered numbers as a tree with one node per shared run.

    Sets are kept in lexical order, so the sets below a node are a range, and those that end
    at it come first. Nodes are numbered level by level: the children of a node are a range
    too, and a walk advances through a level at a time.
    """

    def __init__(self, sets: list[list[int]], sizes: list[int]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i])
        self.sets = [sets[i] for i in self.order]
        self.sizes = np.array([sizes[i] for i in self.order], dtype=np.int64)
        lengths = np.array([len(s) for s in self.sets], dtype=np.int64)
        spans, rows, flat = [(0, len(self.sets), 0)], [], []
        for low, high, depth in spans:  # grows while it is read
            first, last, end = self.sets[low], self.sets[high - 1], depth
            most = min(len(first), len(last))
            while end < most and first[end] == last[end]:
                end += 1
            at = low
            while at < high and len(self.sets[at]) == end:
                at += 1
            child, ended = len(spans), at - low
            while at < high:
                token, stop = self.sets[at][end], at + 1
                while stop < high and self.sets[stop][end] == token:
                    stop += 1
                spans.append((at, stop, end))
                at = stop
            below = slice(low, high)
            rows.append((
                len(flat), len(flat) + end - depth, low, high, ended, child, len(spans) - child,
                self.sizes[below].min(), self.sizes[below].max(), lengths[below].max() - end,
                first[end - 1] if end > depth else -1,
            ))
            flat.extend(first[depth:end])
        self.flat = np.array(flat, dtype=np.int64)
        (self.start, self.end, self.low, self.high, self.ended, self.child, self.children, self.least,
         self.most, self.rest, self.last) = np.array(rows, dtype=np.int64).T

    def links(self, percent: int) -> np.ndarray:
        """The smallest place (in lexical order) that each set is connected with."""
        joined = np.arange(len(self.sets))
        changes = np.arange(len(self.sets))  # how often `joined` has changed up to each place
        known = np.zeros(int(self.flat.max()) + 1 if len(self.flat) else 1, dtype=bool)
        shared = np.zeros(len(self.flat) + 1, dtype=np.int64)
        for place, numbers in enumerate(self.sets):
            size, mine = int(self.sizes[place]), joined[place]
            if joined[0] == mine and changes[-1] == changes[0]:
                break
            own = np.array(numbers, dtype=np.int64)
            known[own] = True
            np.cumsum(known[self.flat], out=shared[1:])
            known[own] = False
            nodes, overlap = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
            met: list[np.ndarray] = []
            while len(nodes):
                overlap = overlap + shared[self.end[nodes]] - shared[self.start[nodes]]
                left = len(own) - np.searchsorted(own, self.last[nodes], side="right")
                reach = overlap + np.minimum(left, self.rest[nodes])
                low, high = self.low[nodes], self.high[nodes]
                apart = (joined[low] != mine) | (changes[high - 1] != changes[low])
                fits = (100 * self.most[nodes] >= percent * size) & (percent * self.least[nodes] <= 100 * size)
                open_ = apart & fits & linked(reach, size, self.least[nodes], percent)
                nodes, overlap = nodes[open_], overlap[open_]
                ends = np.flatnonzero(self.ended[nodes])
                if len(ends):
                    counts = self.ended[nodes[ends]]
                    found = _ranges(self.low[nodes[ends]], counts)
                    near = linked(np.repeat(overlap[ends], counts), size, self.sizes[found], percent)
                    met.append(joined[found[near & (found != place)]])
                counts = self.children[nodes]
                nodes, overlap = _ranges(self.child[nodes], counts), np.repeat(overlap, counts)
            others = np.unique(np.concatenate([*met, [mine]]))
            if len(others) > 1:
                joined[np.isin(joined, others)] = others[0]
                changes[1:] = np.cumsum(joined[1:] != joined[:-1])
                changes[0] = 0
        return joined


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers starts[i], starts[i] + 1, ... of each range, one after the other."""
    before = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) + np.repeat(starts - before, counts)


def _packed_shingles(frame: DataFrame, words: int, percent: int, buckets: int, prefix_only: bool) -> DataFrame:
    """Packed (shingle, class) pairs of the texts in column `text`; with a column `class`,
    texts of another class are left out."""
    checked = "class" in frame.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        sizes: dict[int, int] = {}
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            ids = np.fromiter(held, dtype=np.uint64, count=len(held))
            keys = list(held.values())
            owners = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            yield from packed.pack(
                np.concatenate(keys), owners, ids, np.fromiter(sizes.values(), dtype=np.int64), buckets
            )

        for b in batches:
            wanted = b.column(1).to_pylist() if checked else None
            for i, found in enumerate(shingle_sets(b.column(0).to_pylist(), words)):
                if not len(found):
                    continue
                own = set_class(found)
                if own in held or (checked and wanted[i] != own):
                    continue
                sizes[own] = len(found)
                held[own] = found[: sample_length(len(found), percent)].copy() if prefix_only else found
                total += len(held[own])
                if total >= FLUSH:
                    yield from flush()
                    held, sizes, total = {}, {}, 0
        if held:
            yield from flush()

    return frame.mapInArrow(run, packed.SCHEMA)


def text_classes(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Per row of `docs`: doc_id, text_key, n_shingles and class (null for an empty set)."""
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("text_key", T.LongType()),
        T.StructField("n_shingles", T.LongType()), T.StructField("class", T.LongType()),
    ])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, classes = [], []
            for found in shingle_sets(b.column(2).to_pylist(), words):
                sizes.append(len(found))
                classes.append(set_class(found) if len(found) else None)
            yield batch({
                "doc_id": b.column(0), "text_key": b.column(1), "n_shingles": sizes, "class": classes,
            }, arrow)

    return docs.select("doc_id", F.xxhash64(text_or_empty()).alias("text_key"), "text").mapInArrow(run, schema)


def _sharing(frame: pd.DataFrame) -> pd.DataFrame:
    """Classes of a bucket with their size and number of shingles that others share."""
    keys, owners, ids, sizes = packed.unpack(frame)
    same = keys[1:] == keys[:-1]
    shared = np.zeros(len(keys), dtype=bool)
    shared[1:] |= same
    shared[:-1] |= same
    found, counts = np.unique(owners[shared], return_counts=True)
    return pd.DataFrame({"class": ids[found].astype(np.int64), "n": sizes[found].astype(np.int64), "shared": counts})


def _shared_shingles(buckets: int):
    """Packs the shingles of a bucket that several classes have, by class; a key is followed
    by its number of classes in `keys`."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        keys, owners, ids, sizes = packed.unpack(frame)
        first = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
        counts = np.diff(np.concatenate([first, [len(keys)]]))
        per_key = np.repeat(counts, counts)
        shared = per_key > 1
        keys, owners, per_key = keys[shared], owners[shared], per_key[shared]
        bucket = (ids % np.uint64(buckets)).astype(np.int64)[owners]
        order = np.lexsort((owners, bucket))
        keys, owners, per_key, bucket = keys[order], owners[order], per_key[order], bucket[order]
        rows = {n: [] for n in ("bucket", "keys", "places", "owners", "sizes")}
        cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a < b:
                mine, places = np.unique(owners[a:b], return_inverse=True)
                rows["bucket"].append(int(bucket[a]))
                rows["keys"].append(keys[a:b].tobytes() + per_key[a:b].astype("<u4").tobytes())
                rows["places"].append(packed.small_places(places, len(mine)))
                rows["owners"].append(ids[mine].tobytes())
                rows["sizes"].append(sizes[mine].astype("<u4").tobytes())
        return pd.DataFrame(rows)

    return run


def _rare_prefixes(percent: int):
    """Per class of a bucket: its shared shingles from the most frequent down, with counts,
    and its prefix of rare ones; classes with too many shingles of their own leave."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        keys, counts, owners, ids, sizes = [], [], [], [], []
        shift = 0
        for k, p, o, s in zip(frame["keys"], frame["places"], frame["owners"], frame["sizes"]):
            n = len(k) // 12
            keys.append(np.frombuffer(k, dtype="<u8", count=n))
            counts.append(np.frombuffer(k, dtype="<u4", offset=8 * n))
            owners.append(packed.read_places(p, len(o) // 8).astype(np.int64) + shift)
            ids.append(np.frombuffer(o, dtype="<u8"))
            sizes.append(np.frombuffer(s, dtype="<u4"))
            shift += len(ids[-1])
        ids, first, back = np.unique(np.concatenate(ids), return_index=True, return_inverse=True)
        sizes = np.concatenate(sizes)[first]
        keys, counts, owners = np.concatenate(keys), np.concatenate(counts), back[np.concatenate(owners)]
        order = np.lexsort((keys, counts, owners))
        keys, counts, owners = keys[order], counts[order], owners[order]
        bounds = np.searchsorted(owners, np.arange(len(ids) + 1))
        out = {n: [] for n in ("class", "n", "shingles", "counts", "prefix")}
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            own = int(sizes[i]) - (b - a)
            rare = prefix_length(int(sizes[i]), percent) - own
            if rare > 0:
                out["class"].append(int(ids[i]))
                out["n"].append(int(sizes[i]))
                out["shingles"].append(keys[a:b][::-1].tobytes())
                out["counts"].append(counts[a:b][::-1].astype("<u4").tobytes())
                out["prefix"].append(keys[a : a + rare].view(np.int64))
        return pd.DataFrame({name: pd.Series(values, dtype=object) for name, values in out.items()})

    return run


def _solve(percent: int):
    """Links (a, b) within the candidate groups of a bucket, found by tries."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out_a, out_b = [], []
        for _, group in frame.groupby(["root", "cell"], sort=False):
            if len(group) < 2:
                continue
            tokens = [np.frombuffer(s, dtype="<u8") for s in group["shingles"]]
            counts = [np.frombuffer(c, dtype="<u4") for c in group["counts"]]
            flat, common = np.concatenate(tokens), np.concatenate(counts)
            values, first, back = np.unique(flat, return_index=True, return_inverse=True)
            rank = np.empty(len(values), dtype=np.int64)
            rank[np.lexsort((values, -common[first].astype(np.int64)))] = np.arange(len(values))
            ends = np.cumsum([len(t) for t in tokens])[:-1]
            sets = [np.sort(part).tolist() for part in np.split(rank[back], ends)]
            trie = Trie(sets, group["n"].tolist())
            classes = group["class"].to_numpy()[trie.order]
            joined = trie.links(percent)
            apart = np.flatnonzero(joined != np.arange(len(joined)))
            out_a.append(classes[apart])
            out_b.append(classes[joined[apart]])
        empty = np.empty(0, dtype=np.int64)
        return pd.DataFrame({
            "a": np.concatenate(out_a) if out_a else empty, "b": np.concatenate(out_b) if out_b else empty,
        })

    return run


def class_links(docs: DataFrame, classes: DataFrame, words: int, percent: int, limit: int) -> DataFrame:
    """A written table of links between classes (a, b) that connect exactly what the exact
    join connects."""
    spark = docs.sparkSession
    buckets = packed.few_buckets(spark)
    samples = _packed_shingles(docs.select("text"), words, percent, buckets, True)
    sharing = packed.by_bucket(samples, _sharing, "class bigint, n bigint, shared bigint")
    # `least_shared` as a column
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / 100) * SPARE / 100))
    alike = materialise(
        sharing.groupBy("class", "n").agg(F.sum("shared").alias("shared"))
        .where(F.col("shared") >= least).select("class"),
        "sharing",
    )
    chosen = (
        classes.join(alike, "class")
        .groupBy("class").agg(F.min(F.struct("doc_id", "text_key")).alias("_one"))
        .select("class", F.col("_one.doc_id").alias("_doc_id"), F.col("_one.text_key").alias("_text_key"))
    )
    texts = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("_key"), "text")
    same = (F.col("_key") == F.col("_text_key")) & F.col("doc_id").eqNullSafe(F.col("_doc_id"))
    whole = texts.join(chosen.hint("shuffle_hash"), same).select("text", "class")
    shared = packed.by_bucket(
        _packed_shingles(whole, words, percent, buckets, False), _shared_shingles(buckets), packed.SCHEMA
    )
    sets = materialise(
        packed.by_bucket(
            shared, _rare_prefixes(percent),
            "class bigint, n bigint, shingles binary, counts binary, prefix array<bigint>",
        ),
        "shingle_sets",
    )
    rare = sets.select("class", F.explode("prefix").alias("shingle"))
    hubs = rare.groupBy("shingle").agg(F.min("class").alias("b"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    groups = components(rare.join(hubs, "shingle").select(F.col("class").alias("a"), "b"))
    members = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    members = materialise(members.withColumnRenamed("node", "class"), "candidate_groups")
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("_size"))
    blocks = F.ceil(F.col("_size") / limit).cast("bigint")
    own = F.pmod(F.xxhash64("class"), F.col("_blocks"))
    # a group of several blocks has a cell for every two blocks; a class goes to all its cells
    cells = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1),
        lambda other: F.least(F.col("_own"), other) * F.col("_blocks") + F.greatest(F.col("_own"), other),
    )
    dealt = (
        members.join(sizes, "root").withColumn("_blocks", blocks).withColumn("_own", own)
        .select("class", "root", F.explode(cells).alias("cell"))
        .join(sets.drop("prefix"), "class")
        .withColumn("bucket", F.pmod(F.xxhash64("root", "cell"), F.lit(buckets * 4)).cast("int"))
    )
    links = materialise(packed.by_bucket(dealt, _solve(percent), "a bigint, b bigint"), "links")
    discard(alike, sets, members)
    return links


def jaccard_groups(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, limit: int = LIMIT
) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, text_key (a hash of
    the text) and kept.

    Texts link when the Jaccard similarity of their shingle sets is at least `percent`/100;
    component_id is the smallest doc_id reachable by links. A null, empty or blank text has
    no shingles and is linked with nothing, not even with its like: its component is its own
    doc_id and it is kept. Equal sets always link. Of a component the document that names it
    is kept; of several rows with that doc_id those with the smallest text_key, hence rows
    that repeat doc_id and text are kept together. Rows without doc_id link like others and
    name a component only if all its rows lack one. Other columns are ignored; an empty
    table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    classes = materialise(text_classes(docs, words), "classes")
    filled = classes.where(F.col("class").isNotNull())
    roots = components(class_links(docs, filled, words, percent, limit)).withColumnsRenamed({"node": "class"})
    rooted = filled.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    least = rooted.groupBy("root").agg(F.min(place).alias("_least"))
    grouped = rooted.join(least, "root").select(
        "doc_id", "n_shingles", F.col("_least.doc_id").alias("component_id"), "text_key",
        (place == F.col("_least")).alias("kept"),
    )
    empty = classes.where(F.col("class").isNull()).select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_key", F.lit(True).alias("kept")
    )
    return grouped.unionByName(empty)


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs` that are kept; of rows that repeat doc_id and text one, empty ones
    excepted."""
    groups = materialise(jaccard_groups(docs, words, percent), "jaccard_groups")
    kept = groups.where("kept").groupBy("doc_id", "text_key").agg(
        F.count(F.lit(1)).alias("_copies"), F.max("n_shingles").alias("_n")
    ).withColumnsRenamed({"doc_id": "_doc_id", "text_key": "_text_key"})
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64(text_or_empty()).alias("_key"))
    same = (F.col("_key") == F.col("_text_key")) & F.col("doc_id").eqNullSafe(F.col("_doc_id"))
    joined = rows.join(kept, same)
    repeated = (F.col("_copies") > 1) & (F.col("_n") > 0)
    if not kept.where(repeated).isEmpty():
        place = F.row_number().over(Window.partitionBy("_key", "doc_id").orderBy("_key"))
        first = joined.where(repeated).withColumn("_place", place).where("_place = 1").drop("_place")
        joined = joined.where(~repeated).unionByName(first)
    return joined.select("row.*")
