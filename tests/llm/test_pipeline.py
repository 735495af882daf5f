"""The pipeline against a brute-force version of each stage on what its predecessor kept."""

import re
from collections import Counter

import sentencepiece

import corpus_pipeline
from corvex.llm import pieces, pii
from tests.llm.test_jaccard import plain


def plain_keep(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, chars = len(w), sum(map(len, w))
    grams = Counter(tuple(w[i : i + 8]) for i in range(n - 7))
    repeated = {j for i in range(n - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    bad = [n < 20, 100 * len(repeated) > 30 * n, n and chars > 25 * n, n and chars < 2 * n]
    bad += [10 * len(re.findall(r"[#*$%&|<>]", text or "")) > n, 100 * sum(c.isupper() for c in text or "") > 40 * chars]
    bad += [10 * (text or "").count("!") > 3 * n, len(lines) > 4 and 100 * (len(lines) - len(set(lines))) > 50 * len(lines)]
    return not any(bad)


def fold(text):
    return re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", " ", text.lower()).split()


def test_pipeline(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [f" {' '.join(fold(r.text))} " for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = {d: t for d, t in docs.items() if plain_keep(t)}
    docs = {d: docs[d] for d, (_, c) in plain(list(docs.items()), 5, 80).items() if c == d}
    docs = {d: t for d, t in docs.items() if not any(i in f" {' '.join(fold(t))} " for i in items)}
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    want = {d: model.encode(pii.redact(t, pii.find(t))) for d, t in docs.items()}
    got = {r.doc_id: r.token_ids for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want and len(got) > 50


def test_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_repeated_rows_and_nulls(spark):
    text = "one two three four five six seven eight nine ten " * 3
    rows = [(2, text, "a"), (2, text, "a"), (3, text, "b"), (None, text, "c"), (4, "", "d"), (5, None, "e"), (5, "other words here", "f"), (5, text, "g")]
    kept = corpus_pipeline.jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string, lost string"))
    assert sorted((r.doc_id, r.lost) for r in kept.collect()) == [(2, "a"), (4, "d"), (5, "e"), (5, "f")]
