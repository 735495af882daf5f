"""Collocations against plain counters; tries, odd bytes, ranges that begin inside a subtree, exact scores."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from corvex.llm import collocations, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, most=3, least=10, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            score, k = min((10**6 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            inside = [b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * b >= 50 * a for b in inside):
                rows.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def rows_of(df):
    return sorted((r[0], *r[1:]) for r in df.collect())


def texts(seed, n, vocabulary, zipf=1.2):
    rng = random.Random(seed)
    weights = [1 / (i + 1) ** zipf for i in range(len(vocabulary))]
    sep = [" "] * 12 + ["  ", "\t", ". ", ", ", "\n", "! ", "\r\n", ";", "\x0b"]
    return ["".join(x for w in rng.choices(vocabulary, weights, k=rng.randint(0, 120)) for x in (w, rng.choice(sep))) for _ in range(n)]


ODD = ["a", "b", "A", "a\x00", "a\x01", "a\x01b", "\x00", "\x01\x02", "é", "É", "漢字", "\U0001f600", "a-b", "a\xa0b", "x" * 300, "the", "The", "of"]


def frame(spark, docs):
    return spark.createDataFrame([(t, lang, 1, "x") for t, lang in docs], "text string, lang string, a int, phrase string")


@pytest.mark.parametrize("most, least", [(3, 10), (2, 3), (4, 5)])
def test_equals_plain(spark, most, least):
    docs = [(t, lang) for lang in ("en", "d\x00e", "", None) for t in texts(len(lang or "xx"), 60, ODD)]
    docs += [(None, "en"), ("", "fr"), (None, None), (". ,", "it")] + [("same words again here", "en")] * 40
    got = rows_of(collocations.mine(frame(spark, docs), most, least))
    assert got and got == plain(docs, most, least)


def test_many_small_shards(spark, monkeypatch):
    """Tries of few words, ranges that begin inside the subtree of a frequent word or pair, texts cut into slices."""
    monkeypatch.setattr(collocations, "SHARD_WORDS", 100)
    monkeypatch.setattr(collocations, "SLICE", 50)
    monkeypatch.setattr(collocations, "RANGE_NODES", 200)
    docs = [(t, "en") for t in texts(5, 300, ["the", "of", *[f"w{i}" for i in range(60)]])] + [("the of " * 30, "en")] * 50
    rows = frame(spark, docs).repartition(9)
    assert len(collocations._borders(rows.selectExpr("lang as part", "text"), 3)) > 50
    got = rows_of(collocations.mine(rows, top=50))
    assert got == plain(docs, top=50)


def test_ties_are_ordered_by_bytes(spark):
    docs = [(f"{w} {w}x", "en") for w in ("b", "a", "é", "z", "\U0001f600", "～") for _ in range(12)]
    got = collocations.mine(frame(spark, docs), top=4).orderBy("rank").collect()
    assert [r.phrase for r in got] == ["a ax", "b bx", "z zx", "é éx"]
    assert rows_of(collocations.mine(frame(spark, docs))) == plain(docs)


def test_empty_and_long(spark):
    assert collocations.mine(frame(spark, []), 3).count() == 0
    docs = [("one two three four. " * 60_000 + "tail " * 200_000, "en")]
    got = rows_of(collocations.mine(frame(spark, docs)))
    assert got == plain(docs)


def test_scores_beyond_64_bits(spark):
    big = 4_000_000_000_000_000
    found = spark.createDataFrame([("en", "", 0, 9 * big, []), ("en", "a", 1, big + 7, [9 * big]), ("en", "b", 1, big + 1, [9 * big]), ("en", "a b", 2, big - 3, [9 * big, big + 7])], collocations.NODES.split(", pid")[0])
    row = collocations.candidates(found).first()
    assert row.score == 10**6 * (big - 3) ** 2 // ((big + 7) * (big + 1))


def test_serialised_trie():
    rng = np.random.default_rng(3)
    words = [b"", b"a", b"ab", b"b", b"ba", b"c"]
    ids = rng.integers(0, 6, 500)
    for depth in (1, 3, 4):
        paths, n = collocations.serialised(ids, 6, depth)
        want = Counter(tuple(ids[i : i + k]) for k in range(1, depth + 1) for i in range(len(ids) - k + 1) if all(ids[i : i + k]))
        tuples = [tuple(int(x) for x in p if x) for p in paths]
        assert tuples == sorted(tuples) and dict(zip(tuples[1:], n[1:].tolist())) == want and n[0] == np.count_nonzero(ids)
        named = [tuple(words[x] for x in p) for p in tuples]
        for border in [(b"a",), (b"aa",), (b"ab", b"b", b"c")[:depth], (b"b", b"bb")[:depth], (b"z",), (b"", b"a")[:depth]]:
            assert collocations._cut(paths, words, border) == sum(p < border for p in named)
        pieces = ((0, 40), (3, 4), (2, len(n)))
        parts = [collocations.encode(paths[a:b], n[a:b], words) for a, b in pieces]
        again, total, vocabulary = collocations._merged(parts, depth)
        sums = Counter()
        for a, b in pieces:
            sums.update(dict(zip(named[a:b], n[a:b].tolist())))
        got = [tuple(vocabulary[x - 1] for x in p if x) for p in again]
        assert got == sorted(sums) and dict(zip(got, total.tolist())) == sums


def test_sql(spark, sf, tmp_path):
    docs = [(t, lang) for lang in ("en", "de", None) for t in texts(len(lang or "xx"), 60, [w for w in ODD if "\x00" not in w])]
    frame(spark, docs).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    for folder, path in ((sf, f"{sf}/documents.parquet"), (str(tmp_path), f"{tmp_path}/documents.parquet/*.parquet")):
        con.execute(f"create or replace view documents as select * from '{path}'")
        cursor = con.execute(queries.OP13_SQL)
        names = [d[0] for d in cursor.description]
        got = queries.op13_collocations(spark, folder).collect()
        assert got and sorted(map(str, cursor.fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in got)
