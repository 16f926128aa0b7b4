"""Interaction audit of text filters by the potential of their removal game.

A document fails some of the five filters; a coalition of filters removes a document that
fails any of them. v(C), the documents a coalition removes, is a game with one player per
filter. Its Hart-Mas-Colell potential is P({}) = 0 and

    P(C) = (v(C) + sum of P(C without i) over the filters i of C) / |C|

computed once over the 32 coalitions, from small to large. A filter's Shapley value is the
potential of all filters minus the potential without that filter. 120 * P is whole for every
coalition (the denominator of P(C) divides |C|!), so everything stays in integers, and
120 times the Shapley value is what the filter removes summed over all 120 orders. The
figures of a step are differences of two coalitions: the filters so far, with and without
the step's own.

Scale: a document becomes one narrow row (doc_id, digest of the text, failures) in one scan,
which is written as its keys are counted before the labels are joined; equal rows combine
before every shuffle. Copies are never joined to each other: documents
with one digest fail the same filters but for the last, so the counts of a digest, less the
rows that hold its smallest doc_id, are what that filter adds. What is left for the game is
at most 32 rows a part.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import SPACES, text_or_empty
from pairloom.operators.skew import salted_join
from pairloom.session import materialise

FILTERS = "ABCDE"
"""Filter i has bit 1 << i in a mask of failures or a coalition."""
SPECIAL = r"[#$%&*|]"
_ORDERS = 120


def failures(text: Column) -> Column:
    """The mask of the filters that look at one text alone: A to D."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")

    def bits(found: Column) -> Column:
        n, distinct = F.size(found), F.size(F.array_distinct(found))
        return F.when(n < 200, 1).otherwise(0) + F.when(100 * distinct < 50 * n, 2).otherwise(0)

    # a lambda's argument is evaluated once, an alias used twice would split the text twice
    by_words = F.element_at(F.transform(F.array(words), bits), 1)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("bigint")
    return (
        by_words
        + F.when(100 * capitals > 3 * F.length(text), 4).otherwise(0)
        + F.when(text.rlike(SPECIAL), 8).otherwise(0)
    ).cast("int")


def _flags(labels: DataFrame, id_column: str) -> DataFrame:
    """One row per labelled document: whether any of its labels calls it good, or toxic."""
    return (
        labels.where(F.col(id_column).isNotNull())
        .groupBy(F.col(id_column).alias("id"))
        .agg(
            F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
            F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"),
        )
    )


def failure_counts(
    docs: DataFrame, labels: DataFrame, part: str = "lang", id_column: str = "doc_id",
    text: str = "text", min_hot_rows: int = 1_000_000,
) -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part by the set of filters they fail.

    `good` and `toxic` count those with such a label. A null part is the empty one, a null
    text the empty text. A row repeats a text if a row with a smaller id has it too; rows
    without an id repeat nothing and are no reason for others to.
    """
    body = text_or_empty(text)
    rows = docs.select(
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.col(id_column).alias("id"),
        F.unhex(F.sha2(F.encode(body, "utf-8"), 256)).alias("digest"),
        failures(body).alias("mask"),
    )
    rows = rows.groupBy("id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    rows = materialise(rows, "failures")
    rows = salted_join(rows, _flags(labels, id_column), ["id"], ["digest", "part"], "left", min_rows=min_hot_rows)
    rows = rows.select(
        "digest", "part", "mask", "id", "n",
        F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"),
    )
    # per text: its counts, and which of its rows comes first
    per_text = rows.groupBy("digest", "mask", "part", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.min("id").alias("first"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))["n"].alias("n_first"),
    )
    group = F.struct("part", "good", "toxic", "n", "first", "nameless", "n_first")
    texts = per_text.groupBy("digest", "mask").agg(F.min("first").alias("least"), F.collect_list(group).alias("groups"))
    # a text has at most four groups a part, however many copies it has
    found = texts.select("mask", "least", F.explode("groups").alias("g")).select("mask", "least", "g.*")
    fresh = F.col("nameless") + F.when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(0)
    last = 1 << (len(FILTERS) - 1)
    split = found.select(
        "part", "good", "toxic",
        F.explode(F.array(
            F.struct(F.col("mask").alias("mask"), fresh.alias("n")),
            F.struct((F.col("mask") + last).alias("mask"), (F.col("n") - fresh).alias("n")),
        )).alias("s"),
    )
    return split.groupBy("part", F.col("s.mask").alias("mask")).agg(
        F.sum("s.n").alias("n"),
        F.sum(F.col("good") * F.col("s.n")).alias("good"),
        F.sum(F.col("toxic") * F.col("s.n")).alias("toxic"),
    )


def _removed(counts: DataFrame) -> DataFrame:
    """Per part arrays over the coalitions 0 to 31: `docs`, `good` and `toxic` they remove."""
    coalitions = range(1 << len(FILTERS))

    def game(column: str) -> Column:
        return F.array(*[
            F.sum(F.when(F.col("mask").bitwiseAND(F.lit(c)) != 0, F.col(column)).otherwise(0)) for c in coalitions
        ])

    alone = F.array(*[F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)) for i in range(len(FILTERS))])
    return counts.groupBy("part").agg(
        F.sum("n").alias("total"), game("n").alias("docs"), game("good").alias("good_of"),
        game("toxic").alias("toxic_of"), alone.alias("alone"),
    )


def potentials(game: Column) -> Column:
    """120 * P of all 32 coalitions; a coalition's subsets have smaller numbers than it."""

    def without(known: Column, c: Column, i: int) -> Column:
        bit = 1 << i
        return F.when(c.bitwiseAND(F.lit(bit)) != 0, F.element_at(known, c - bit + 1)).otherwise(F.lit(0))

    def extend(known: Column, c: Column) -> Column:
        smaller = reduce(lambda a, b: a + b, [without(known, c, i) for i in range(len(FILTERS))])
        value = _ORDERS * F.element_at(game, c + 1) + smaller
        return F.concat(known, F.array(F.floor(value / F.bit_count(c)).cast("bigint")))

    last = (1 << len(FILTERS)) - 1
    return F.aggregate(F.sequence(F.lit(1), F.lit(last)), F.array(F.lit(0).cast("bigint")), extend)


def _steps() -> Column:
    """All 600 steps: (filter_order, step, player, before, after), coalitions as masks."""
    found = []
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[i] for i in order), 0
        for step, i in enumerate(order, 1):
            found.append(f"{name} {step} {i} {before} {before | 1 << i}")
            before |= 1 << i
    cells = F.transform(F.split(F.lit(",".join(found)), ","), lambda s: F.split(s, " "))
    return F.explode(F.transform(cells, lambda s: F.struct(
        s[0].alias("filter_order"), s[1].cast("int").alias("step"), s[2].cast("int").alias("player"),
        s[3].cast("int").alias("before"), s[4].cast("int").alias("after"),
    )))


def audit(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """One row per part, order of the five filters and step, with what the step does.

    (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley); `columns` as in `failure_counts`. Rows that repeat in `docs` count each; a
    document with several labels is good, or toxic, if any says so; labels of no document
    count nowhere. Other columns of both tables are ignored. Without documents there is no
    part and no row.
    """
    games = _removed(failure_counts(docs, labels, **columns)).withColumn("p", potentials(F.col("docs")))
    steps = games.select("*", _steps().alias("s")).select("*", "s.*")

    def of(game: str, coalition: str) -> Column:
        return F.element_at(F.col(game), F.col(coalition) + 1)

    full = (1 << len(FILTERS)) - 1
    removed = of("docs", "after") - of("docs", "before")
    bit = F.element_at(F.array(*[F.lit(1 << i) for i in range(len(FILTERS))]), F.col("player") + 1)
    shapley = F.element_at("p", F.lit(full + 1)) - F.element_at("p", F.lit(full + 1) - bit)
    return steps.select(
        "part", "filter_order", "step",
        (F.col("total") - of("docs", "after")).alias("kept"),
        removed.alias("removed"),
        (F.element_at("docs", bit + 1) - removed).alias("redundant"),
        F.element_at("alone", F.col("player") + 1).alias("unique_fails"),
        (of("good_of", "after") - of("good_of", "before")).alias("good_lost"),
        (of("toxic_of", "after") - of("toxic_of", "before")).alias("toxic_lost"),
        shapley.alias("shapley"),
    )
