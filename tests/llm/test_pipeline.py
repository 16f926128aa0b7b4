from collections import Counter

import corpus_pipeline
from pairloom.llm import jaccard, packing
from plain_rules import words_of


def test_stages_on_the_table(spark, sf_dir, table):
    docs, seen = table, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == table.columns
    texts = {r.doc_id: r.text for r in table.collect()}
    known = {r.doc_id for r in seen["language_id"].select("doc_id").collect()}
    assert known == {d for d, t in texts.items() if any(c.isalpha() for c in t)}
    groups = {}
    for d in sorted(known):
        groups.setdefault(" ".join(texts[d].split(" ")), d)
    unique = {r.doc_id for r in seen["exact_dedup"].select("doc_id").collect()}
    assert unique == set(groups.values())
    apart = {r.doc_id for r in seen["jaccard_join"].select("doc_id").collect()}
    want = {r.component_id for r in jaccard.jaccard_groups(table.where(table.doc_id.isin(list(unique)))).collect()}
    assert apart == want
    mixed = Counter(r.doc_id for r in seen["source_mixing"].select("doc_id").collect())
    assert set(mixed) <= apart and max(mixed.values()) <= 3
    packed = Counter()
    for r in seen["packing"].collect():
        packed[r.doc_id] += r.length
    encode = packing.byte_bpe()
    assert packed == {d: n * (len(encode(texts[d])) + 1) for d, n in mixed.items()}


def test_run_equals_the_stages(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "start", "length", "sequence_id"} <= set(rows.columns) and rows.count() > 0


def test_stages_take_odd_and_empty_rows(spark, sf_dir, make_docs, odd_rows):
    for rows in (odd_rows, []):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, make_docs(rows), sf_dir)
            if name != "packing":
                assert out.columns == make_docs([]).columns
            found = out.collect()
            assert rows or not found
    kept = [r for r in corpus_pipeline.near_copies(spark, make_docs(odd_rows), sf_dir).collect() if words_of(r.text)]
    assert len({(r.doc_id, r.text) for r in kept}) == len(kept)
