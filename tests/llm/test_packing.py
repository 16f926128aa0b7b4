import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pairloom.llm.packing import byte_bpe, fill_windows, pack


def wanted_ids():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def check_pieces(rows, docs):
    ids_of = wanted_ids()
    left = defaultdict(list)
    for doc_id, text in docs:
        left[doc_id].append(ids_of(text))
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
        assert zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32
        assert len(r.ids) == r.length
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and at & (at - 1) == 0 and at == parts[0].tier
    assert set(pieces) == set(left)
    for doc_id, texts in left.items():
        parts = sorted(pieces[doc_id], key=lambda r: r.start)
        if len(texts) == 1:
            assert [i for r in parts for i in r.ids] == texts[0]
            assert [r.start for r in parts] == np.cumsum([0, *(r.length for r in parts[:-1])]).tolist()
            assert {r.doc_tokens for r in parts} == {len(texts[0])}
        else:
            assert sum(r.length for r in parts) == sum(map(len, texts))


def test_odd_rows(make_docs, odd_rows):
    rows = pack(make_docs(odd_rows), with_ids=True).collect()
    check_pieces(rows, [(r[0], r[1]) for r in odd_rows])


def test_whole_table_in_small_buffers(table):
    docs = [(r.doc_id, r.text) for r in table.collect()]
    check_pieces(pack(table, with_ids=True, buffer_tokens=3000).collect(), docs)


def test_empty_table(make_docs):
    assert pack(make_docs([])).collect() == []


def test_step_groups_hold_equal_tokens(table):
    rows = pack(table, step_tokens=2048).collect()
    groups = defaultdict(dict)
    for r in rows:
        groups[r.step_group][r.sequence_id] = r.tier
    for sizes in groups.values():
        assert len(set(sizes.values())) == 1 and sum(sizes.values()) <= 2048


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_fast_encoder_gives_the_same_ids(text):
    if "e" not in CACHE:
        CACHE["e"], CACHE["w"] = byte_bpe(), wanted_ids()
    text = text.encode("utf-8", "replace").decode()
    assert CACHE["e"](text).tolist() == CACHE["w"](text)[:-1]


CACHE = {}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3000), max_size=40), st.booleans())
def test_windows_are_full(lengths, last):
    pool = sorted((n, i, 0) for i, n in enumerate(lengths))
    total = sum(lengths)
    seen = 0
    for size, window in fill_windows(pool, (1024, 512, 256, 128), last):
        assert sum(p[0] for p in window) == size and size & (size - 1) == 0
        seen += size
    assert seen + sum(p[0] for p in pool) == total
    assert not (last and pool)


def test_windows_prefer_whole_pieces():
    pool = sorted([(700, 0, 0), (300, 1, 0), (24, 2, 0), (90, 3, 0)])
    first = next(fill_windows(pool, (1024, 512, 256, 128), False))
    assert first == (1024, [(700, 0, 0), (300, 1, 0), (24, 2, 0)])
