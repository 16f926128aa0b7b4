from collections import defaultdict

import pytest

from pairloom.llm import line_dedup as ld
from pairloom.llm.catalog import QUERIES


def brute(docs, unit, min_words):
    """Kept text and removed spans; rows that repeat doc_id and text are one document."""
    groups = defaultdict(list)
    for doc_id, text in dict.fromkeys((d, t or "") for d, t in docs):
        for start, end, _ in ld.units_of(text, unit, min_words):
            key = " ".join(text[start:end].lower().split())
            groups[key].append((doc_id is None, doc_id or 0, text, start, end))
    gone = defaultdict(set)
    for places in groups.values():
        copies = len(places)
        if copies > 1:
            places.sort(key=lambda p: (p[0], p[1]))
            lowest = [p for p in places if p[:2] == places[0][:2]]
            for p in places:
                if p not in lowest:
                    gone[None if p[0] else p[1], p[2]].add((p[3], p[4]))
            if len({(p[2]) for p in lowest}) == 1:
                for p in sorted(lowest, key=lambda p: p[3])[1:]:
                    gone[None if p[0] else p[1], p[2]].add((p[3], p[4]))
    return sorted(((d, t or "", sorted(gone[d, t or ""])) for d, t in docs), key=str)


def found(frame, docs):
    out = []
    for r in frame.collect():
        out.append((r.doc_id, r.kept_text, [(s.start, s.end) for s in r.removed]))
    return sorted(out, key=str)


def expected(docs, unit, min_words):
    out = []
    for doc_id, text, spans in brute(docs, unit, min_words):
        kept, at = "", 0
        for a, b in spans:
            kept, at = kept + text[at:a], b
        out.append((doc_id, kept + text[at:], spans))
    return sorted(out, key=str)


ROWS = [
    (1, "One line of text here.\nShort.\nAnother line of text follows."), (2, "ONE  line of text here.\nSomething else is in here."),
    (3, "Before. Another line of text follows. After é日. Another line of text follows."),
    (3, "Before. Another line of text follows. After é日. Another line of text follows."),
    (None, "One line of text here.\n\nAnother line of text follows."), (4, None), (5, ""), (6, "\n\n \n"),
    (7, "a b c d e\n" * 50), (8, "Short.\nShort."),
]


@pytest.mark.parametrize("unit", ["line", "sentence", "paragraph"])
def test_units(make_docs, unit):
    assert found(ld.line_dedup(make_docs(ROWS), unit), ROWS) == expected(ROWS, unit, 5)


def test_whole_table(table):
    docs = [(r.doc_id, r.text) for r in table.collect()]
    assert found(ld.line_dedup(table), docs) == expected(docs, "sentence", 5)


def test_odd_rows_and_empty_table(make_docs, odd_rows):
    docs = [(r[0], r[1]) for r in odd_rows]
    assert found(ld.line_dedup(make_docs(odd_rows)), docs) == expected(docs, "sentence", 5)
    assert ld.line_dedup(make_docs([])).collect() == []


def test_units_cover_the_text():
    text = "A b c. D e f!\ng h"
    for unit in ld.BREAKS:
        spans = [(a, b) for a, b, _ in ld.units_of(text, unit, 0)]
        assert "".join(text[a:b] for a, b in spans) == text


def test_query_removes_repeated_short_lines(spark, make_docs, tmp_path):
    menu, verse = "Home\nAbout us\n", "nt onor. the of it.\n"
    sentence = "This sentence stands in several lines."
    texts = [
        f"{menu}First text. {sentence} More here.\n{verse}", f"{menu}{verse}Other line. {sentence}\n",
        f"{menu}\n\n{verse}Yes. No. Last.", "Yes. No.", "",
    ]
    make_docs(list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in QUERIES["op6_line_dedup"](spark, str(tmp_path)).collect()}
    removed = {}
    for i, text in enumerate(texts):
        spans = [tuple(map(int, s.split(":"))) for s in rows[i].spans.split(",") if s]
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:])) and all(s[2] == 0 for s in spans)
        assert rows[i].n_removed == sum(b - a for a, b, _ in spans) and rows[i].n_spans == len(spans)
        removed[i] = [text[a:b] for a, b, _ in spans]
    lines = ["Home\n", "About us\n", verse]
    assert removed == {0: [], 1: [*lines, f"{sentence}\n"], 2: lines, 3: [], 4: []}


def test_lines_and_sentences_against_brute_force(table):
    docs = [(r.doc_id, r.text or "") for r in table.collect()]
    assert len({d for d, _ in docs}) == len(docs)
    groups = defaultdict(set)
    for doc_id, text in docs:
        for unit, least in (("sentence", 5), ("line", 1)):
            for start, end, _ in ld.units_of(text, unit, least):
                groups[" ".join(text[start:end].lower().split())].add((doc_id, start))
    first = {key: min(places) for key, places in groups.items()}
    got = {r.doc_id: r for r in ld.line_dedup(table, lines=True).collect()}
    for doc_id, text in docs:
        gone = set()
        for unit, least in (("sentence", 5), ("line", 1)):
            for start, end, _ in ld.units_of(text, unit, least):
                if first[" ".join(text[start:end].lower().split())] != (doc_id, start):
                    gone.update(range(start, end))
        assert got[doc_id].kept_text == "".join(c for i, c in enumerate(text) if i not in gone)
