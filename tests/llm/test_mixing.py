from collections import defaultdict

import pytest

from pairloom.llm import mixing
from plain_rules import words_of


def targets(sizes):
    """Shares by weight, cut at three times the size, the excess shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s: 3 * sizes[s] for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return capped | share
        capped |= over


def check(rows, docs, slack):
    sizes, largest = defaultdict(int), defaultdict(int)
    for _, text, source in docs:
        sizes[source] += len(words_of(text))
        largest[source] = max(largest[source], len(words_of(text)))
    want = targets(sizes)
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.row.source]
        assert r.target == pytest.approx(want[r.row.source])
        assert 0 <= r.times <= 3 and r.size == len(words_of(r.row.text))
        taken[r.row.source] += r.size * r.times
    for source in sizes:
        assert abs(taken[source] - want[source]) <= slack * largest[source] + 1e-6
    assert len(rows) == len(docs)


def test_whole_table(table):
    docs = [(r.doc_id, r.text, r.source) for r in table.collect()]
    rows = mixing.mix(table).collect()
    check(rows, docs, 0.5)
    again = mixing.mix(table.repartition(5)).collect()
    assert sorted((r.doc_id, r.times) for r in again) == sorted((r.doc_id, r.times) for r in rows)


def test_odd_rows(make_docs, odd_rows):
    # the repeated row of source a is taken as one
    check(mixing.mix(make_docs(odd_rows)).collect(), [(r[0], r[1], r[3]) for r in odd_rows], 1.0)


def test_hot_source_and_source_without_words(make_docs):
    docs = [(i, "w " * (i % 9 + 1), "hot") for i in range(400)] + [(1000, " ", "blank"), (1001, "a b", None), (1002, "x", "z")]
    check(mixing.mix(make_docs([(d, t, "en", s) for d, t, s in docs])).collect(), docs, 0.5)


def test_repeated_rows_of_the_mix(make_docs, odd_rows):
    mixed = mixing.mix(make_docs(odd_rows))
    rows = mixing.repeat_rows(mixed)
    assert rows.columns == make_docs([]).columns
    assert rows.count() == sum(r.times for r in mixed.collect())


def test_empty_table(make_docs):
    assert mixing.mix(make_docs([])).collect() == []
