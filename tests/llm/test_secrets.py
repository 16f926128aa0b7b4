import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairloom.llm import secrets

PARTS = [
    "password", "PassWd", "token", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH0123", "api_key", "apikey",
    "deadbeefdeadbeef0123456789abcdef", "secret", "eyJhbGciOiJ", ".", "abcdefgh1", "ghp_", "\n", ",", "é", "日",
    "0123456789abcdef0123456789", "-----BEGIN RSA PRIVATE KEY-----",
]


def brute(text):
    found = []
    for order, rule in enumerate(secrets.RULES):
        for m in rule.exact().finditer(text):
            if len(m[rule.group]) >= rule.least:
                found.append((m.start(), order, m.end(), rule.kind))
    return [(k, s, e) for s, _, e, k in sorted(found)]


@pytest.fixture(scope="module")
def automata():
    return secrets._compiled(secrets.RULES)


def run(text, automata, length):
    search, anchored = automata
    data = text.encode() + b"\0"
    found = set()
    for low, high in secrets.find_stretches(np.frombuffer(data, dtype=np.uint8), search, length).tolist():
        found.update(secrets.spans_in(data[low:high], low, secrets.RULES, anchored))
    return found


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14), st.sampled_from([4, 64]))
def test_spans_equal_the_regexes(parts, length):
    text = "".join(parts)
    if "a" not in CACHE:
        CACHE["a"] = secrets._compiled(secrets.RULES)
    want = {
        (m.start(), i, m.end())
        for i, rule in enumerate(secrets.RULES)
        for m in re.finditer(rule.pattern.encode(), text.encode(), re.IGNORECASE if rule.any_case else 0)
    }
    assert run(text, CACHE["a"], length) == want


CACHE = {}


@pytest.mark.parametrize("part", [
    "eyJ", "eyJa ", "eyJ token=", "some words ", "token=", "token= ", "AKIA", "-----BEGIN ", "f", "deadbeef ", "ghp_", "password:", "eyJa.", "日 ",
    "secret='", "-----BEGIN PRIVATE ",
])
def test_long_texts_take_linear_time(automata, part):
    text = part * (1_000_000 // len(part.encode()))
    begun = time.perf_counter()
    got = run(text, automata, 256)
    assert time.perf_counter() - begun < 8
    want = {
        (m.start(), i, m.end()) for i, rule in enumerate(secrets.RULES)
        for m in re.finditer(rule.pattern.encode(), text[:3000].encode(), re.IGNORECASE if rule.any_case else 0)
    }
    near = len(text[:3000].encode()) - 300
    assert {f for f in got if f[2] < near} == {f for f in want if f[2] < near}


def test_minimal_automaton_is_smaller_than_the_subsets(automata):
    anchored = automata[1]
    table = anchored.moves.reshape(-1, anchored.classes) // anchored.classes
    # no two states are alike: same marks and same moves
    rows = {(int(m), *map(int, row)) for m, row in zip(anchored.accepts, table)}
    assert len(rows) == len(table)


def test_odd_rows_and_planted_secrets(make_docs, odd_rows):
    rows = [(r[0], r[1]) for r in odd_rows] + [
        (100, 'é password = "abc" token:secret=longenough1 AKIA1234 ' + "0a" * 16 + " end"),
        (101, "x" * 5000 + "AKIAABCDEFGHIJKL" + "日" * 10 + "token=12345678"),
        (102, "f" * 100_000), (103, "password=" * 2000), (104, "eyJ" * 2000), (105, "eyJ" * 40 + "." + "eyJ" * 50 + ".token=eyJ" + "x" * 40),
        (106, "eyJab.eyJ.token=eyJcd " * 200), (107, "words and eyJ words " * 400 + "token=12345678"),
    ]
    found = secrets.scan(make_docs(rows)).collect()
    got = sorted((str(r.doc_id), [(s.kind, s.start, s.end) for s in r.secrets]) for r in found)
    assert got == sorted((str(d), brute(t or "")) for d, t in rows)


def test_whole_table(table):
    texts = {r.doc_id: r.text for r in table.collect()}
    for r in secrets.scan(table).collect():
        assert [(s.kind, s.start, s.end) for s in r.secrets] == brute(texts[r.doc_id])


def test_empty_table(make_docs):
    assert secrets.scan(make_docs([])).collect() == []
