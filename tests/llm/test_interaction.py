import re
from itertools import permutations

import pytest
from pyspark.sql import types as T

from pairloom.llm import interaction

LABELS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()),
    T.StructField("toxic", T.IntegerType()), T.StructField("mask", T.StringType()), T.StructField("n", T.StringType()),
])


def failed(row, rows):
    text = row[1] or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = set()
    if len(words) < 200:
        out.add("A")
    if 100 * len(set(words)) < 50 * len(words):
        out.add("B")
    if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text):
        out.add("C")
    if re.search(r"[#$%&*|]", text):
        out.add("D")
    if row[0] is not None and any(r[0] is not None and r[0] < row[0] and (r[1] or "") == text for r in rows):
        out.add("E")
    return out


def brute(rows, labels):
    """Plays all orders document by document."""
    known = {}
    for i, q, t in labels:
        if i is not None:
            old = known.get(i, (False, False))
            known[i] = old[0] or q == 1, old[1] or t == 1
    fails = [(r[2] or "", failed(r, rows), *known.get(r[0], (False, False))) for r in rows]
    out = {}
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        totals = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            gone = set()
            for step, letter in enumerate(order, 1):
                now = {i for i, f in enumerate(mine) if letter in f[1]}
                removed = now - gone
                totals[letter] += len(removed)
                out[part, order, step] = [
                    len(mine) - len(gone | now), len(removed), len(now & gone), sum(f[1] == {letter} for f in mine),
                    sum(mine[i][2] for i in removed), sum(mine[i][3] for i in removed),
                ]
                gone |= now
        for (p, order, step), row in out.items():
            if p == part:
                row.append(totals[order[step - 1]])
    return out


def played(frame):
    return {(r.part, r.filter_order, r.step): list(r)[3:] for r in frame.collect()}


@pytest.fixture(scope="module")
def rows(odd_rows):
    long_text = " ".join(f"w{i}" for i in range(250))
    return [
        *odd_rows, (20, long_text, "en", "a"), (21, long_text, "", "a"), (22, long_text + " #", "en", "b"),
        (23, long_text, "de", "a"), (20, long_text, "de", "a"), (19, long_text + " |", "en", "a"),
        (24, "ABC " * 300, "de", "a"), (25, "ABC " * 300, "de", "a"), (26, "a b " * 120 + "$", None, None),
        (-3, "", "en", "a"), (27, "\x0b\x0c\x1c\u00a0", "en", None),
    ]


def test_odd_rows_equal_brute_force(spark, make_docs, rows):
    labels = [(1, 1, 0), (4, 1, 1), (4, 0, 0), (20, None, 1), (21, 1, None), (23, 1, 1), (25, 0, 1), (None, 1, 1), (99, 1, 1), (19, 5, 1)]
    table = spark.createDataFrame([(*r, "x", "y") for r in labels], LABELS)
    got = played(interaction.audit(make_docs(rows), table))
    assert got == brute(rows, labels)


def test_hot_ids_are_spread(spark, make_docs):
    rows = [(7, f"text {i}", "en", "a") for i in range(60)] + [(i, "same $", "en", "b") for i in range(60)]
    labels = [(7, 1, 1), (8, 1, 0)]
    table = spark.createDataFrame([(*r, "x", "y") for r in labels], LABELS)
    assert played(interaction.audit(make_docs(rows), table, min_hot_rows=10)) == brute(rows, labels)


def test_no_labels_and_no_documents(spark, make_docs, rows):
    table = spark.createDataFrame([], LABELS)
    assert played(interaction.audit(make_docs(rows[:3]), table)) == brute(rows[:3], [])
    assert interaction.audit(make_docs([]), table).collect() == []


def test_potential_of_a_known_game(spark):
    # one unanimous coalition: its two players share one
    game = [1 if c & 5 == 5 else 0 for c in range(32)]
    frame = spark.createDataFrame([(game,)], "game array<bigint>")
    p = frame.select(interaction.potentials(frame["game"]).alias("p")).first().p
    assert [p[31] - p[31 - (1 << i)] for i in range(5)] == [60, 0, 60, 0, 0]
