import random
from collections import Counter, defaultdict

import pytest

from pairloom.llm import jaccard
from plain_rules import words_of


def brute(docs, words=5, percent=80):
    sets = []
    for _, text in docs:
        w = words_of(text)
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    inverted, parent = defaultdict(list), list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, own in enumerate(sets):
        common = Counter(j for s in own for j in inverted[s])
        for j, n in common.items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for s in own:
            inverted[s].append(i)
    least = defaultdict(lambda: None)
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None and (least[find(i)] is None or doc_id < least[find(i)]):
            least[find(i)] = doc_id
    return sorted(((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=str)


def found(frame):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in frame.collect()), key=str)


def near_copies(n, seed, length=60, edits=2, bases=4):
    rng = random.Random(seed)
    made = [[f"w{rng.randrange(10_000)}" for _ in range(length)] for _ in range(bases)]
    passage = [f"p{i}" for i in range(40)]
    out = []
    for i in range(n):
        words = list(rng.choice(made))
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(100_000)}"
        if rng.random() < 0.3:
            words += passage[: rng.randrange(40)]
        out.append((i, " ".join(words)))
    return out


def test_odd_rows(make_docs, odd_rows):
    docs = [(r[0], r[1]) for r in odd_rows]
    assert found(jaccard.jaccard_groups(make_docs(docs))) == brute(docs)


@pytest.mark.parametrize("limit", [4096, 7])
def test_near_copies_in_whole_groups_and_in_blocks(make_docs, limit):
    docs = near_copies(150, 3)
    assert found(jaccard.jaccard_groups(make_docs(docs), limit=limit)) == brute(docs)


def test_other_similarity(make_docs):
    docs = near_copies(80, 9, edits=8)
    assert found(jaccard.jaccard_groups(make_docs(docs), words=3, percent=60)) == brute(docs, 3, 60)


def test_whole_table(table):
    docs = [(r.doc_id, r.text) for r in table.collect()]
    assert found(jaccard.jaccard_groups(table)) == brute(docs)


def test_empty_table(make_docs):
    assert jaccard.jaccard_groups(make_docs([])).collect() == []


def test_keep_one_leaves_one_of_each_group(make_docs, odd_rows):
    kept = sorted(((r.doc_id, r.text) for r in jaccard.keep_one(make_docs(odd_rows)).collect()), key=str)
    groups = jaccard.jaccard_groups(make_docs(odd_rows)).collect()
    filled = {r.component_id for r in groups if r.n_shingles}
    empty = [(r[0], r[1]) for r in odd_rows if not words_of(r[1])]
    assert len(kept) == len(filled) + len(empty)
    assert [d for d, t in kept if words_of(t)].count(4) == 1


def test_samples_of_linked_sets_share_enough():
    rng = random.Random(8)
    for _ in range(3000):
        n = rng.randint(1, 60)
        own = set(rng.sample(range(100), n))
        other = set(own)
        for _ in range(rng.randint(0, n // 3 + 1)):
            other ^= {rng.randrange(100)}
        if not other or not jaccard.linked(len(own & other), n, len(other), 80):
            continue
        samples = [set(sorted(s)[: jaccard.sample_length(len(s), 80)]) for s in (own, other)]
        shared = len(samples[0] & samples[1])
        assert shared >= jaccard.least_shared(n, 80) and shared >= jaccard.least_shared(len(other), 80)


def test_trie_joins_like_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        bases = [sorted(rng.sample(range(30), rng.randint(1, 14))) for _ in range(3)]
        sets = []
        for _ in range(rng.randint(2, 14)):
            one = set(rng.choice(bases))
            for _ in range(rng.randint(0, 3)):
                one ^= {rng.randrange(30)}
            sets.append(sorted(one) or [0])
        sizes = [len(s) + rng.randint(0, 2) for s in sets]
        trie = jaccard.Trie(sets, sizes)
        joined = trie.links(80)
        root = {i: trie.order[joined[place]] for place, i in enumerate(trie.order)}
        parent = list(range(len(sets)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i in range(len(sets)):
            for j in range(i):
                if jaccard.linked(len(set(sets[i]) & set(sets[j])), sizes[i], sizes[j], 80):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
        for i in range(len(sets)):
            for j in range(i):
                assert (root[i] == root[j]) == (find(i) == find(j))
