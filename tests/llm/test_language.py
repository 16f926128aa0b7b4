import numpy as np
import pytest

from pairloom.llm import language
from plain_rules import remainder


def test_held_out_accuracy(table):
    model = language.fit(table.where(~language.held_out()))
    rows = language.predict(table, model).select("row.*", "lang_pred", "score", "rejected").collect()
    assert len(rows) == table.count()
    held = [r for r in rows if remainder(r.doc_id, 5) == 0]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) == 0


def test_prediction_looks_at_the_text_alone(table, make_docs):
    model = language.fit(table)
    text = table.first().text
    rows = language.predict(make_docs([(1, text, "xx", "s"), (None, text, None, None)]), model).collect()
    assert len({(r.lang_pred, r.score) for r in rows}) == 1


def test_odd_rows(table, make_docs, odd_rows):
    model = language.fit(table)
    rows = language.predict(make_docs(odd_rows), model).collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        letters = any(c.isalpha() for c in r.row.text or "")
        assert (r.lang_pred == language.UNKNOWN) == (not letters)
        assert r.lang_pred in {*model.languages, language.UNKNOWN}
        assert letters or (r.score == 0 and r.rejected)
    assert rows[0].row.size == "a"


def test_other_scripts_are_rejected(table, make_docs):
    model = language.fit(table)
    rows = language.predict(make_docs([(1, "日本語の文章です。これは長い文章です。")]), model).collect()
    assert rows[0].rejected and rows[0].lang_pred in model.languages


@pytest.mark.parametrize("every", [200, 100, 60])
def test_some_wrong_labels_do_not_open_a_language(make_docs, every):
    words = "the of and to in is that for it was on are as with his they at be this from".split()
    rng = np.random.default_rng(every)
    rows = [(i, " ".join(rng.choice(words, 30)), "en") for i in range(1000)]
    japanese = list("日本語の文章です。これは長い文章です。東京は大きい町で、山も海も近い。")
    wrong = {i: "".join(rng.permutation(japanese)) for i in range(0, 1000, every)}
    rows = [(i, wrong.get(i, text), lang) for i, text, lang in rows]
    rows += [(1000 + i, " ".join(rng.choice("der die und das ist nicht ein zu mit auf".split(), 30)), "de") for i in range(300)]
    model = language.fit(make_docs(rows))
    asked = [(1, "これは日本の町の話です。山と海があります。"), (2, "that was for the people and with them"), (3, "das ist nicht mit der und die")]
    found = {r.row.doc_id: r for r in language.predict(make_docs(asked), model).collect()}
    assert found[1].rejected
    assert [(found[i].lang_pred, found[i].rejected) for i in (2, 3)] == [("en", False), ("de", False)]
    clean = make_docs([r for r in rows if r[0] not in wrong])
    assert language.predict(clean, model).where("rejected").count() == 0


def plain_prediction(text, model):
    """The nearest centroid, trigram by trigram."""
    if text is None or not any(c.isalpha() for c in text):
        return language.UNKNOWN, 0.0, True
    data = f" {text} ".encode()
    folded = [b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in data]
    weights = {}
    for i in range(len(folded) - 2):
        a, b, c = folded[i : i + 3]
        if (a, b, c) == (32, 32, 32):
            continue
        place = ((a * 65536 + b * 256 + c) * 2654435761 % 2**32) >> 19
        weights[place] = weights.get(place, 0.0) + float(model.idf[place])
    length = sum(w * w for w in weights.values()) ** 0.5
    near = [sum(w * float(c[place]) for place, w in weights.items()) / length for c in model.centroids]
    best = max(range(len(near)), key=lambda i: (near[i], -i))
    floor = model.floors[best] * min(1.0, len(weights) / model.sizes[best]) ** 0.5
    return model.languages[best], near[best], near[best] < floor


def test_predictions_equal_plain_loops(table, make_docs, odd_rows):
    model = language.fit(table)
    texts = [r.text for r in table.orderBy("doc_id").limit(150).collect()] + [r[1] for r in odd_rows if len(r[1] or "") < 10000]
    texts += ["日本語", "ÄÖÜ straße", "Zażółć gęślą jaźń"]
    docs = make_docs([(i, t) for i, t in enumerate(texts)])
    found = {r.row.doc_id: r for r in language.predict(docs, model).collect()}
    for i, text in enumerate(texts):
        lang, score, rejected = plain_prediction(text, model)
        assert found[i].score == pytest.approx(min(max(score, 0), 1), abs=1e-5)
        assert (found[i].lang_pred, found[i].rejected) == (lang, rejected)


def test_nothing_to_learn(make_docs):
    model = language.fit(make_docs([(1, "no label", None, None), (2, None, "en", None)]))
    rows = language.predict(make_docs([(1, "some text")]), model).collect()
    assert [(r.lang_pred, r.score, r.rejected) for r in rows] == [(language.UNKNOWN, 0.0, True)]
    assert language.predict(make_docs([]), model).collect() == []


def test_document_frequencies_cover_all_rows(table):
    n, frequencies = language.document_frequencies(table)
    counts = language.trigram_counts([r.text for r in table.collect()])
    assert n == table.count() and (frequencies == (counts > 0).sum(axis=0)).all()


def test_clusters_are_unit_vectors_near_their_members():
    rng = np.random.default_rng(0)
    centres = np.eye(3, 10)
    vectors = np.repeat(centres, 20, axis=0) + 0.05 * rng.random((60, 10))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    found = language.cluster(vectors.astype(np.float32), 3)
    assert np.allclose(np.linalg.norm(found, axis=1), 1, atol=1e-5)
    assert ((vectors @ found.T).max(axis=1) > 0.95).all()


def test_copies_neither_crowd_out_nor_empty_a_sample(make_docs):
    words = {"aa": ["alpha", "bravo", "carol"], "bb": ["wyvern", "xylem", "zephyr"]}
    # few texts with many copies, and one text with many copies among others
    rows = [(i, f"{words['aa'][i % 3]} hot", "aa") for i in range(3000)]
    rows += [(i, "wyvern xylem zephyr", "bb") for i in range(3000)] + [(i, f"xylem {i} zephyr", "bb") for i in range(40)]
    docs = make_docs(rows)
    for seed in ("language", "b", "c", "d"):
        model = language.fit(docs, sample=10, seed=seed)
        assert set(model.languages) == {"aa", "bb"}
        assert model.languages.count("aa") == 3
    rows = language.predict(make_docs([(1, "alpha hot"), (2, "xylem 7 zephyr")]), model).collect()
    assert [r.lang_pred for r in sorted(rows, key=lambda r: r.row.doc_id)] == ["aa", "bb"]
