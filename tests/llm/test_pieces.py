"""Piece ids against the public library, and round trips."""

import gc
import random
import string
import weakref

import sentencepiece

from corvex.llm import pieces, wordhash


def test_equals_library(spark, sf):
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    code = pieces.coder()
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rng = random.Random(3)
    alphabet = ["a", "e", "th", "ing", " ", "  ", "\n", "\t", "é", "日本", "🙂", "ß", "1", "2024", ".", "the", "<s>", "<0x0A>", "’"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    texts += ["", " ", "   ", " a", "a ", "   lead", "x" * 400, "ab" * 300, "the quick brown fox  jumps", "The 'unaffordable' internationalisation of straightforwardness"]
    ids, offsets = code.encode(texts)
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == model.encode(t), repr(t[:80])
    assert code.decode(ids, offsets) == texts


def test_edges(spark):
    rows = spark.createDataFrame([(1, None, 3), (2, "", 4), (None, "a b", 5), (2, "a b", 5)], "doc_id long, text string, n_tokens int")
    got = {(r.doc_id, r.n_tokens, r.round_trip) for r in pieces.encode(rows).collect()}
    assert got == {(1, 0, True), (2, 0, True), (None, 2, True), (2, 2, True)}
    assert pieces.encode(rows.where("doc_id > 9")).count() == 0
    back = pieces.decode(pieces.encode(rows)).collect()
    assert sorted(r.text for r in back) == ["", "", "a b", "a b"]


def swapped(n, a, b):
    """A word whose letters follow the parity of the bits of their places."""
    return "".join((a, b)[bin(i).count("1") & 1] for i in range(n))


def test_words_that_polynomials_confuse():
    model, code = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL), pieces.coder()
    texts = [swapped(n, *ab) for n in (1024, 2048, 4096) for ab in ("ab", "ba")]
    ids, at = code.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [model.encode(t) for t in texts]
    assert code.decode(ids, at) == texts


def test_equal_hashes(monkeypatch):
    """Long words whose hashes are all alike still get their own ids."""
    model, code = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL), pieces.Coder(pieces.coder().vocabulary)
    units = code._units
    monkeypatch.setattr(code, "_units", lambda texts: (lambda c, s, n, k, f: (c, s, n, k * 0 + k[0], f))(*units(texts)))
    for texts in (["one" * 20, "four" * 30, "one" * 20], ["two" * 20, "four" * 30, "five" * 15]):
        ids, at = code.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [model.encode(t) for t in texts]


def test_long_words():
    rng, letters = random.Random(3), string.ascii_letters + string.digits + "+/"
    model, code = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL), pieces.coder()
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in (4095, 4097, 9999, 30000)]
    texts += ["=" * 7001, "ab" * 4000 + "c" * 5000, "a" * 9001 + "é漢" * 3000, "abc" * 3001, "word " * 9000]
    ids, at = code.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [model.encode(t) for t in texts]


def test_empty_table_and_clashes(spark):
    rows = spark.createDataFrame([(1, "a b", 5), (1, "a b", 6), (None, None, 7)], "doc_id long, text string, token_ids int")
    got = sorted((r.doc_id or 0, r.n_tokens, r.round_trip) for r in pieces.encode(rows).collect())
    assert got[0] == (0, 0, True) and got[1] == got[2]
    assert pieces.encode(rows.where("doc_id > 5")).count() == 0


def test_coders_leave_with_the_next_operator():
    """A worker keeps its coder for tasks that code texts, and drops it when another operator's task starts."""
    code = pieces.coder()
    assert list(wordhash.lean(lambda batches: batches, keeps=True)(iter([1]))) == [1] and pieces.coder() is code
    held = weakref.ref(code)
    del code
    assert list(wordhash.lean(lambda batches: batches)(iter([1]))) == [1]
    gc.collect()
    assert held() is None
