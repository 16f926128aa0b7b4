import hashlib
import random
from collections import Counter

import numpy as np

from pairloom.llm import suffix_dedup as sd
from pairloom.llm.anchors import anchors
from pairloom.llm.suffixes import common_prefixes, suffix_array


def brute(docs, length):
    raw = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(x[i : i + length] for _, x in raw for i in range(len(x) - length + 1))
    out = []
    for doc_id, x in raw:
        gone = np.zeros(len(x) + 1, dtype=bool)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(x, gone) if not g)
        spans = int((gone[:-1] & ~gone[1:]).sum())
        out.append((doc_id, len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(frame):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in frame.collect()), key=str)


def test_odd_rows(make_docs, odd_rows):
    rows = [(r[0], r[1]) for r in odd_rows if r[0] not in (7, 8)]
    passage = " ".join(f"word{i * i % 97}" for i in range(60))
    rows += [
        (30, "head " + passage + " tail"), (31, passage), (32, "é" * 150 + passage + "é" * 150),
        (33, "Sich " * 120 + "enauen " * 90), (34, "!" * 700), (35, "Sich " * 41), (35, "x" + "Sich " * 45),
    ]
    assert found(sd.suffix_dedup(make_docs(rows))) == brute(rows, 200)


def test_short_strings(make_docs):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(60)))) for i in range(60)]
    rows += [(100 + i, "abcabcab" * rng.randrange(1, 6)) for i in range(6)]
    assert found(sd.suffix_dedup(make_docs(rows), length=12, width=6)) == brute(rows, 12)


def test_whole_table(table):
    assert found(sd.suffix_dedup(table)) == brute([(r.doc_id, r.text) for r in table.collect()], 200)


def test_empty_table(make_docs):
    assert sd.suffix_dedup(make_docs([])).collect() == []


def test_suffix_arrays_and_common_prefixes():
    rng = random.Random(1)
    for _ in range(400):
        text = np.array([rng.randint(1, rng.choice([1, 2, 3, 8])) for _ in range(rng.randint(1, 60))] + [0], dtype=np.uint8)
        data = text.tobytes()
        order = suffix_array(text)
        assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
        shared = common_prefixes(text, order, np.array([0]), 64)
        for a, b in zip(order[:-1], order[1:]):
            want = next((i for i, (x, y) in enumerate(zip(data[a:], data[b:])) if x != y))
            assert shared[b] == want


def test_repeated_strings_like_brute_force():
    rng = random.Random(2)
    for _ in range(1000):
        docs = [bytes(rng.choice(b"ab") for _ in range(rng.randint(8, 40))) for _ in range(rng.randint(1, 3))]
        cut = {}
        for _ in range(rng.randint(2, 6)):
            doc = rng.randrange(len(docs))
            start = rng.randrange(len(docs[doc]) - 6)
            cut[doc, start] = docs[doc][start : start + rng.randint(6, 12)]
        owners, starts = (np.array(x) for x in zip(*cut))
        parts = list(cut.values())
        got = {
            (i, k)
            for i, a, b in sd.repeated_strings(parts, owners, starts, np.zeros(len(parts)), 6)
            for k in range(a, b - 5)
        }
        places = {}
        for i, p in enumerate(parts):
            for k in range(len(p) - 5):
                places.setdefault(p[k : k + 6], set()).add((owners[i], starts[i] + k))
        assert got == {(i, k) for i, p in enumerate(parts) for k in range(len(p) - 5) if len(places[p[k : k + 6]]) > 1}


def test_equal_strings_hold_equal_anchors():
    rng = random.Random(7)
    texts = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(20, 90))) for _ in range(20)] + [b"xy" * 50, b"xy" * 40]
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    places, marks = anchors(data, bounds, 8, 4, block=37)
    by_string = {}
    for a, b in zip(bounds[:-1], bounds[1:]):
        for i in range(a, b - 7):
            mine = {int(m) for p, m in zip(places, marks) if i <= p <= i + 4}
            assert mine
            by_string.setdefault(data[i : i + 8].tobytes(), []).append(mine)
    assert all(set.intersection(*found) for found in by_string.values())


def crowd(rng, n=60):
    """A passage in every text, with another neighbourhood in each, some of them alike."""
    passage = "".join(rng.choice("abcdefgh ") for _ in range(260))
    own = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(150, 400))) for _ in range(n)]
    rows = [(i, own[i] + passage + own[(i + 1) % n if i % 7 else 0]) for i in range(n)]
    return rows + [(n, rows[3][1]), (n + 1, rows[4][1][50:] + "x"), (n + 2, "é" * 130 + passage), (n + 3, None)]


def test_crowded_anchors_are_dealt_by_string(make_docs):
    rows = crowd(random.Random(5))
    want = brute(rows, 200)
    for piece in (300, 3000, sd.PIECE_BYTES):
        assert found(sd.suffix_dedup(make_docs(rows), piece=piece)) == want
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(60)))) for i in range(60)]
    rows += [(100 + i, "abcabcab" * rng.randrange(1, 6)) for i in range(6)]
    assert found(sd.suffix_dedup(make_docs(rows), length=12, width=6, piece=40)) == brute(rows, 12)


def test_no_anchor_asks_for_more_than_a_piece(make_docs):
    rows, most = crowd(random.Random(5)), 10
    docs = make_docs(rows).selectExpr("coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS text_key")
    chosen = sd._choose(1, most)(sd._postings(docs, 200, 100, 1).toPandas())
    anchor = np.concatenate([sd._array(b, "<u8") for b in chosen["anchor"]])
    kind = np.concatenate([sd._array(b, "<u1") for b in chosen["kind"]])
    asked = Counter(anchor[kind & 2 > 0].tolist())
    assert max(asked.values()) > most
    assert set(anchor[kind & 4 > 0].tolist()) == {a for a, n in asked.items() if n > most}
    plan = sd._by_text(chosen).merge(docs.toPandas().drop_duplicates(), on="text_key")
    packed = sd._contexts(docs.sparkSession.createDataFrame(plan), 200, 100, 1).toPandas()
    gathered = Counter(np.concatenate([np.frombuffer(b, dtype="<u8") for b in packed["anchor"]]).tolist())
    assert gathered and max(gathered.values()) <= most
