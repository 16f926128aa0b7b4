import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from pairloom.llm import pitman_yor as py
from plain_rules import remainder, words_of


def check(rows, docs):
    tokens = [words_of(t) + [None] for _, t in docs]
    held = [remainder(d, 7) == 2 for d, _ in docs]
    counts = Counter(w for x, h in zip(tokens, held) if not h for w in x)
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (str(d), h, len(x), sum(counts[w] > 0 for w in x), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in x), 6))
        for (d, _), x, h in zip(docs, tokens, held)
    )
    got = sorted(
        (str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows
    )
    assert got == want


def test_odd_rows(make_docs, odd_rows):
    rows = py.score(make_docs(odd_rows)).collect()
    check(rows, [(r[0], r[1]) for r in odd_rows])
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)


def test_beats_the_base_on_texts_not_learned(table):
    rows = py.score(table).collect()
    check(rows, [(r.doc_id, r.text) for r in table.collect()])
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    again = {r.doc_id: r.score for r in py.score(table).collect()}
    assert again == {r.doc_id: r.score for r in rows}


def test_empty_tables(make_docs):
    assert py.score(make_docs([])).collect() == []
    held = next(i for i in range(100) if remainder(i, 7) == 2)
    rows = py.score(make_docs([(held, "a b")])).collect()
    assert [(r.n_known, r.train_tokens, r.base_score, r.score) for r in rows] == [(0, 0, 0.0, 0.0)]


def entries_of(rng, words=40, contexts=6, n=3000):
    word = np.minimum(rng.geometric(0.1, n) - 1, words - 1)
    context = rng.integers(0, contexts, n) * 3 + word % 3
    keys, counts = np.unique(word * py.CONTEXTS + context, return_counts=True)
    names = np.arange(words, dtype=np.uint64)
    return py.Entries(names, keys // py.CONTEXTS, keys % py.CONTEXTS, counts)


def totals_of(e, state, before):
    below = np.bincount(e.pair, state[2], len(e.pair_word))
    root = np.bincount(e.pair_word, state[1], len(e.words))
    return py.Totals(
        [root.sum()[None], np.bincount(e.pair_context, below, py.PARENTS), np.bincount(e.context, e.count, py.CONTEXTS)],
        [state[0].sum()[None].astype(float), np.bincount(e.pair_context, state[1], py.PARENTS), np.bincount(e.context, state[2], py.CONTEXTS)],
        n_tokens=int(e.count.sum()), n_words=len(e.words),
    )


def test_probabilities_sum_to_one_and_tables_fit():
    rng = np.random.default_rng(3)
    e = entries_of(rng)
    state = [np.minimum(np.bincount(e.word, minlength=len(e.words)), 1), np.ones(len(e.pair_word), int), np.ones(len(e.word), int)]
    totals = totals_of(e, state, None)
    for _ in range(3):
        state = py.sweep(e, state, totals, rng)
        totals = totals_of(e, state, totals)
    assert (state[2] >= 1).all() and (state[2] <= e.count).all()
    below = np.bincount(e.pair, state[2], len(e.pair_word))
    root = np.bincount(e.pair_word, state[1], len(e.words))
    assert (state[1] <= below).all() and (state[1] >= 1).all()
    base = 1 / (len(e.words) + 1)
    p0 = totals.own(0, root, state[0], np.zeros(len(root), int)) + totals.back_off(0) * base
    assert np.isclose(p0.sum() + totals.back_off(0)[0] * base, 1)
    for context in np.unique(e.context):
        p1 = totals.back_off(1)[context >> py.BEFORE_BITS] * p0
        mine = e.pair_context == context >> py.BEFORE_BITS
        p1[e.pair_word[mine]] += totals.own(1, below, state[1], e.pair_context)[mine]
        p2 = totals.back_off(2)[context] * p1
        mine = e.context == context
        p2[e.word[mine]] += totals.own(2, e.count, state[2], e.context)[mine]
        unknown = totals.back_off(2)[context] * totals.back_off(1)[context >> py.BEFORE_BITS] * totals.back_off(0)[0] * base
        assert np.isclose(p2.sum() + unknown, 1)


@pytest.mark.parametrize("customers", [2, 3, 40, 256, 300, 2000])
@pytest.mark.parametrize("weight,discount", [(2.0, 0.5), (0.01, 0.5), (40.0, 0.8), (3000.0, 0.3)])
def test_tables_follow_their_distribution(customers, weight, discount):
    rng = np.random.default_rng(1)
    n = 4000
    logs = py.log_stirling(customers, discount)[customers, 1:] + np.arange(customers) * math.log(weight)
    shares = np.exp(logs - logs.max())
    mean = (shares * np.arange(1, customers + 1)).sum() / shares.sum()
    tables = py.seat(np.full(n, customers), lambda dishes, t: np.full(len(dishes), weight), discount, rng)
    assert abs(tables.mean() - mean) < 0.03 * mean


def test_contexts_are_the_two_words_before():
    words, context, doc = py.tokens(["a b c", None, "x a b c", "b c"])
    assert len(words) == 4 + 1 + 5 + 3 and doc.tolist() == [0] * 4 + [1] + [2] * 5 + [3] * 3
    parent = context >> py.BEFORE_BITS
    assert parent[0] == parent[4] == parent[5] == parent[10] and words[3] == words[4] == words[9] == py.END
    assert context[3] == context[9] == context[12] and context[2] == context[8] and parent[2] == parent[11]
    assert parent[1] == parent[7] and parent[0] != parent[1] != parent[2]
    many = py.tokens([" ".join(f"w{i}" for i in range(20_000))])[1]
    assert len(np.unique(many)) > 19_000 and many.max() < py.CONTEXTS


def plain_sampler(pairs, sweeps, rng, discounts, strength=1.0):
    """One-by-one Gibbs seating of (word, parent, context) customers; mean tables per level."""
    vocabulary = len({w for w, _, _ in pairs})
    rooms = {}  # (level, context) -> {word: [sizes of tables]}

    def probability(level, chain, word):
        if level < 0:
            return 1 / (vocabulary + 1)
        room = rooms.get((level, chain[level]), {})
        sizes, tables = room.get(word, []), sum(map(len, room.values()))
        total = sum(sum(s) for s in room.values())
        back = (strength + discounts[level] * tables) * probability(level - 1, chain, word)
        return (max(0, sum(sizes) - discounts[level] * len(sizes)) + back) / (strength + total)

    def add(level, chain, word):
        if level < 0:
            return
        room = rooms.setdefault((level, chain[level]), {})
        sizes, tables = room.setdefault(word, []), sum(map(len, room.values()))
        new = (strength + discounts[level] * tables) * probability(level - 1, chain, word)
        weights = [s - discounts[level] for s in sizes] + [new]
        at = rng.choice(len(weights), p=np.array(weights) / sum(weights))
        if at == len(sizes):
            sizes.append(1)
            add(level - 1, chain, word)
        else:
            sizes[at] += 1

    def remove(level, chain, word):
        if level < 0:
            return
        sizes = rooms[level, chain[level]][word]
        at = rng.choice(len(sizes), p=np.array(sizes) / sum(sizes))
        sizes[at] -= 1
        if not sizes[at]:
            sizes.pop(at)
            remove(level - 1, chain, word)

    chains = [((0, parent, context), word) for word, parent, context in pairs]
    for chain, word in chains:
        add(2, chain, word)
    means = []
    for sweep in range(sweeps):
        for chain, word in chains:
            remove(2, chain, word)
            add(2, chain, word)
        if sweep >= sweeps // 3:
            means.append([sum(len(s) for (l, _), room in rooms.items() if l == level for s in room.values()) for level in range(3)])
    return np.mean(means, axis=0)


def test_tables_agree_with_a_sequential_sampler():
    rng = np.random.default_rng(9)
    e = entries_of(rng, words=8, contexts=4, n=240)
    state = [np.minimum(np.bincount(e.word, minlength=len(e.words)), 1), np.ones(len(e.pair_word), int), np.ones(len(e.word), int)]
    means = []
    for sweep in range(400):
        totals = totals_of(e, state, None)
        state = py.sweep(e, state, totals, rng)
        if sweep >= 50:
            means.append([s.sum() for s in state])
    pairs = [(w, c >> py.BEFORE_BITS, c) for w, c, n in zip(e.word.tolist(), e.context.tolist(), e.count.tolist()) for _ in range(n)]
    want = plain_sampler(pairs, 60, rng, (0.5, 0.5, 0.5))
    assert np.abs(np.mean(means, axis=0) / want - 1).max() < 0.2


def test_repeated_texts_score_apart(make_docs):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(3000)]
    def text():
        return " ".join(rng.choice(words, 80))
    rows = [(i, text(), "en", "a") for i in range(300)]
    rows += [(1000 + i, rows[i][1], "en", "a") for i in range(0, 300, 10)]
    rate = {r.doc_id: r.score / r.n_tokens for r in py.score(make_docs(rows)).collect() if not r.held_out}
    twice = [v for d, v in rate.items() if d % 10 == 0 and d < 300 and remainder(d + 1000, 7) != 2]
    once = [v for d, v in rate.items() if d % 10 and d < 300]
    assert min(twice) > max(once)


def test_buckets_may_be_salted(table, monkeypatch):
    want = {r.doc_id: r.score for r in py.score(table).collect()}
    monkeypatch.setattr(py, "SALT_TOKENS", 500)
    assert {r.doc_id: r.score for r in py.score(table).collect()} == want


def test_text_taken_at_once_is_bounded():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * (1 << 20)] * 12})
    found = list(py._slices(batch))
    assert len(found) > 1 and sum(len(texts) for _, _, texts in found) == 12
    assert [a for a, _, _ in found] == [0, *(b for _, b, _ in found[:-1])]


def plain_first_scores(docs):
    """Scores of the first state, one table per entry, by plain counts of words and word pairs."""
    texts = [(["<1>", "<2>", *words_of(t), None], remainder(d, 7) == 2) for d, t in docs]
    grams = [[(x[i - 2], x[i - 1], x[i]) for i in range(2, len(x))] for x, _ in texts]
    c2 = Counter(g for x, (_, held) in zip(grams, texts) if not held for g in x)
    c1 = Counter((v, w) for _, v, w in c2)
    c0 = Counter(w for _, w in c1)
    counts = [c0, c1, c2]

    def discount(c):
        n = Counter(c.values())
        return min(0.95, max(0.1, n[1] / max(1, n[1] + 2 * n[2])))

    d = [discount(c) for c in counts]
    rooms = [Counter(), Counter(), Counter()], [Counter(), Counter(), Counter()]
    for level, c in enumerate(counts):
        for g, n in c.items():
            context = g[:level] if level else ()
            rooms[0][level][context] += n
            rooms[1][level][context] += 1

    def probability(level, g):
        if level < 0:
            return 1 / (len(c0) + 1)
        dish, context = (g[2 - level:], g[2 - level:2]) if level else (g[2], ())
        n, size, tables = counts[level][dish], rooms[0][level][context], rooms[1][level][context]
        own = max(0, n - d[level] * min(n, 1))
        return (own + (1 + d[level] * tables) * probability(level - 1, g)) / (1 + size)

    return [sum(math.log10(probability(2, g)) for g in x) for x in grams]


def texts_with_a_crowded_word(rng, n=120):
    words = [f"w{i}" for i in range(400)]
    return [(i, " ".join("the" if rng.random() < 0.4 else rng.choice(words) for _ in range(30)), "en", "a") for i in range(n)]


def test_contexts_are_told_apart_by_whole_words(make_docs):
    """Also contexts whose slots meet, and those of words that fill buckets."""
    rows = texts_with_a_crowded_word(np.random.default_rng(4))
    docs = make_docs(rows)
    marked = docs.selectExpr("doc_id", "text", "false AS held_out")
    assert py.trigrams(["the"])[0][0] in py._crowded_words(marked, 16)
    want = plain_first_scores([r[:2] for r in rows])
    got = {r.doc_id: r.score for r in py.score(docs, burn_in=0, samples=0).collect()}
    assert [round(got[r[0]], 6) for r in rows] == [round(x, 6) for x in want]
    # more words before one word than slots for them
    before = [f"u{i}" for i in range(200)]
    rows = [(i, f"{u} the x{i}", "en", "a") for i, u in enumerate(before)]
    got = {r.doc_id: r.score for r in py.score(make_docs(rows), burn_in=0, samples=0).collect()}
    assert np.allclose([got[i] for i in range(len(rows))], plain_first_scores([r[:2] for r in rows]))


def test_buckets_and_owners_seat_like_one_sampler(make_docs):
    """Mean tables of crowded and other words' restaurants against one sweep after another."""
    rng = np.random.default_rng(5)
    rows = [r for r in texts_with_a_crowded_word(rng, 60) if remainder(r[0], 7) != 2]
    marked = make_docs(rows).selectExpr("doc_id", "text", "false AS held_out")
    found = [py.train(marked, burn_in=5, samples=1, seed=s, buckets=16)[2][-1] for s in (1, 2)]
    words, before, earlier, _ = py.trigrams([r[1] for r in rows])
    names, w = np.unique(words, return_inverse=True)
    parents, v = np.unique(before, return_inverse=True)
    contexts, c = np.unique(v << 32 | np.unique(earlier, return_inverse=True)[1], return_inverse=True)
    pairs, pair = np.unique(v << 32 | w, return_inverse=True)
    keys, first, count = np.unique(pair << 32 | c, return_index=True, return_counts=True)
    e = py.Entries(names, w[first], c[first], count, (pair[first], pairs & 0xFFFFFFFF, pairs >> 32))
    state = [np.ones(len(names), int), np.ones(len(pairs), int), np.ones(len(keys), int)]
    means = []
    for number in range(30):
        below = np.bincount(e.pair, state[2], len(pairs))
        root = np.bincount(e.pair_word, state[1], len(names))
        totals = py.Totals(
            [root.sum()[None], np.bincount(e.pair_context, below, len(parents)), np.bincount(e.context, e.count, len(contexts))],
            [state[0].sum()[None], np.bincount(e.pair_context, state[1], len(parents)), np.bincount(e.context, state[2], len(contexts))],
            found[0].discounts, n_tokens=int(count.sum()), n_words=len(names),
        )
        if number >= 10:
            means.append([root.sum(), state[0].sum()])
        state = py.sweep(e, state, totals, rng)
    mean = np.mean(means, axis=0)
    for known in found:
        assert (known.n_tokens, known.n_words) == (len(words), len(names))
        assert abs(known.customers / mean[0] - 1) < 0.05 and abs(known.tables / mean[1] - 1) < 0.1


def test_other_runs_are_not_taken_together(make_docs):
    frame = pd.DataFrame({"digest": [1, 2], "doc_ids": [[1], None], "at": [0, 1]})
    with pytest.raises(ValueError):
        py._gather(1)(frame)
