import hashlib
import re
from collections import defaultdict

from pairloom.llm.exact_dedup import exact_dedup


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def check(rows, docs):
    groups = defaultdict(list)
    for doc_id, text in docs:
        groups[normal(text)].append(doc_id)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(rows) == len(docs)
    kept = defaultdict(list)
    for r in rows:
        ids = by_sha[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.keep_id == (min(known) if known else None) and r.group_size == len(ids)
        if r.kept:
            kept[r.text_sha256].append(r.doc_id)
    assert kept == {sha: [min([i for i in ids if i is not None], default=None)] for sha, ids in by_sha.items()}


def test_odd_rows(make_docs, odd_rows):
    rows = odd_rows + [(4, "another text of the same id", "en", "a"), (20, "another  text of the same id", "en", "a")]
    check(exact_dedup(make_docs(rows)).collect(), [(r[0], r[1]) for r in rows])


def test_texts_that_part_late(make_docs):
    base = "z" * 300
    docs = [(i, base[: 60 + i % 7] + str(i % 5) + base) for i in range(200)] + [(1000 + i, base) for i in range(20)]
    rows = exact_dedup(make_docs(docs), first_width=3, growth=2).collect()
    check(rows, docs)


def test_carried_columns_and_empty_table(make_docs):
    docs = make_docs([(1, "a b", "en", "s"), (2, "a  b", "de", "t")])
    rows = exact_dedup(docs, carry=docs.columns).where("kept").select("row.*").collect()
    assert [(r.doc_id, r.lang, r.source, r.size, r.kept) for r in rows] == [(1, "en", "s", "a", "e")]
    assert exact_dedup(make_docs([])).collect() == []
