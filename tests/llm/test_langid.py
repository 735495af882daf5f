"""Language profiles: algebra against a plain version, held-out accuracy, edge cases."""

from collections import Counter

import numpy as np

from corvex.llm import langid
from corvex.llm.queries import op5_language_id


def plain_vector(text):
    """The bundle, letter by letter."""
    letters = [ord(c) for c in " " + " ".join("".join(c.lower() if c.isalpha() else " " for c in text).split()) + " "]
    total = np.zeros(langid.DIMENSIONS)
    for i in range(len(letters) - 2):
        v = np.ones(langid.DIMENSIONS)
        for k in range(3):
            v *= np.roll(langid.letter_vector(letters[i + k]), k)
        total += v
    return total


def test_bundle_equals_plain():
    for text in ("Thé cat, 12 sat", "a", "x" * 50):
        codes, counts = langid.grams(text)
        assert np.allclose(langid._bundle([codes], [counts], langid.DIMENSIONS)[0], plain_vector(text))


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op5_language_id(spark, folder).collect()}
    truth = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert set(got) == set(truth)
    test = [d for d, r in got.items() if r.held_out and truth[d].lang and r.lang_pred != "und" and len(truth[d].text.split()) >= 5]
    assert len(test) > 150
    right = sum(got[d].lang_pred == truth[d].lang for d in test) / len(test)
    assert right > 0.97, right
    assert all(0 <= r.score <= 1 for r in got.values())


def test_edges(spark):
    rows = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "le chat et les chiens", "fr"), (3, None, "en"), (4, "12 34", None), (5, "", "fr"), (1, "the cat and the dog", "en")], "doc_id long, text string, lang string")
    model = langid.train(rows)
    assert sorted(model) == ["en", "fr"]
    got = sorted((r.doc_id, r.lang_pred, r.score > 0) for r in langid.predict(rows, model).collect())
    assert got == [(1, "en", True), (1, "en", True), (2, "fr", True), (3, "und", False), (4, "und", False), (5, "und", False)]
    empty = rows.where("doc_id < 0")
    assert langid.train(empty) == {} and langid.predict(empty, {}).count() == 0
    assert {r.lang_pred for r in langid.predict(rows, {}).collect()} == {"und"}


def plain_grams(text):
    letters = " " + " ".join("".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text or "").split()) + " "
    return Counter(letters[i : i + 3] for i in range(len(letters) - 2)) if letters.strip() else Counter()


def plain_model(rows):
    """Training letter by letter: each document's bundle over its counts' root of squares, added by language."""
    model = {}
    for text, lang in rows:
        counts = plain_grams(text)
        if lang is not None and counts:
            model[lang] = model.get(lang, 0) + plain_vector(text) / np.sqrt(sum(n * n for n in counts.values()))
    return model


def test_train_and_predict_equal_plain(spark):
    """Ties, repeated rows, null languages and texts, clashing names and a long text, against a plain version of all of it."""
    texts = [
        ("the cat and the dog are here", "en"), ("a dog is not the cat", "en"), ("le chat et le chien sont ici", "fr"), ("le chien n'est pas un chat", "fr"), ("der hund und die katze", "de"), ("The CAT!", "en"),
        ("Straße und Maß", "de"), ("Istanbul ve Ankara", "tr"), ("same words here", "xa"), ("same words here", "xb"), ("same words here", None), (None, "fr"), ("12 34", "en"), ("漢字 と かな", "ja"), ("le chat et le chien sont ici", "fr"),
        ("the dog " * 3_000 + "le chat", "en"),
    ]
    asked = [t for t, _ in texts] + ["un chat", "katze und hund", "here", "", "かな", "😀"]
    rows = [(i, t, texts[i][1] if i < len(texts) else None, 1.0, "x") for i, t in enumerate(asked)] + [(0, asked[0], "en", 1.0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string").repartition(4)
    model, want = langid.train(docs), plain_model([(t, lang) for _, t, lang, _, _ in rows])
    assert sorted(model) == sorted(want)
    for name, vector in want.items():
        assert np.allclose(model[name], vector, atol=1e-3)
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(docs, model).collect()]
    assert len(got) == len(rows)
    unit = {k: v / np.linalg.norm(v) for k, v in sorted(want.items())}
    for key, lang, score in got:
        text = asked[key]
        if not plain_grams(text):
            assert (lang, score) == ("und", 0)
            continue
        vector = plain_vector(text)
        cosines = {k: float(vector @ v / np.linalg.norm(vector)) for k, v in unit.items()}
        best = max(cosines.values())
        assert abs(score - min(1, max(0, best))) < 1e-4 and cosines[lang] > best - 1e-4
        if text == "same words here":
            assert lang == "xa"
