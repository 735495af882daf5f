"""Repeated passages against brute force; the index batch by batch; edges."""

import hashlib
import random
from collections import Counter

from corvex.llm import store, substrings
from corvex.llm.queries import op6_substring_dedup


def plain(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        drop = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                drop.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in drop)
        out.append((len(w), len(drop), hashlib.sha256(kept).hexdigest()))
    return out


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = dict(zip(docs, plain(docs.values(), 35), strict=True))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op6_substring_dedup(spark, sf).collect()}
    assert got == want and any(x[1] for x in want.values())


def test_small_windows(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("ab c d é x".split(" ")) for _ in range(rng.randint(0, 14))) for _ in range(60)]
    texts += [None, "", texts[3], texts[3], " \t\r\n", "a " * 40]
    ids = [*range(60), 60, 61, 62, 62, None, None]
    rows = spark.createDataFrame(list(zip(ids, texts, ["x"] * len(ids), strict=True)), "doc_id long, text string, content string")
    got = substrings.deduplicate(rows, window=5, gram=3).collect()
    want = plain(texts, 5)
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=key) == sorted(((i, *w) for i, w in zip(ids, want, strict=True)), key=key)


def test_empty(spark):
    rows = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.deduplicate(rows).count() == 0


def test_index(spark):
    index = substrings.FingerprintIndex(spark, store.fresh(spark, "index-test"), fanout=2)
    frame = lambda xs: spark.createDataFrame([(x, 7) for x in xs], "hash long, doc long")
    assert {r.hash for r in index.add(frame([1, 2, 2, 3])).collect()} == {2}
    assert {r.hash for r in index.add(frame([3, 4])).collect()} == {3}
    # Compaction waits until a batch reads the runs.
    assert [n.split("-")[1] for n in index.runs()] == ["00", "00"]
    # Another session's index over the same folder goes on from there.
    index.close()
    index = substrings.FingerprintIndex(spark, index.path, fanout=2)
    assert {r.hash for r in index.add(frame([4, 9, 1])).collect()} == {4, 1}
    assert [n.split("-")[1] for n in index.runs()] == ["00", "01"]
    new, old = (index.read(n) for n in index.runs())
    assert sorted(r.hash for r in old.collect()) == [1, 2, 2, 3, 3, 4]
    plan = new.select("hash", "salt").hint("merge").join(old.select("hash", "salt"), ["hash", "salt"], "left_semi")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    index.delete()
    assert index.runs() == []


def test_hot_fingerprint(spark):
    """A fingerprint of a third of all postings is dealt over several buckets, and found again in all of them."""
    index = substrings.FingerprintIndex(spark, store.fresh(spark, "index-test"), fanout=2, hot_least=16)
    post = lambda rows: spark.createDataFrame(rows, "hash long, doc long")
    first = [(5, d) for d in range(1000)] + [(100 + d, d) for d in range(2000)]
    assert {r.hash for r in index.add(post(first)).collect()} == {5}
    run = index.read(index.runs()[0])
    salts = run.where("hash = 5").groupBy("salt").count().collect()
    assert len(salts) > 3 and all(r.salt > 0 for r in salts) and run.where("hash <> 5 and salt <> 0").isEmpty()
    files = [r["count"] for r in run.groupBy(substrings.F.input_file_name()).count().collect()]
    assert len(files) == 8 and max(files) < 1.6 * len(first) / 8, files
    # Once in a later batch, and in the run that both are compacted into.
    assert {r.hash for r in index.add(post([(5, 9001), (100, 9002), (7, 9003)])).collect()} == {5, 100}
    assert {r.hash for r in index.add(post([(5, 9004), (7, 9005)])).collect()} == {5, 7}
    got = sorted((r.hash, r.doc) for r in index.postings(post([(5, 0), (7, 0)]).select("hash")).collect())
    assert got == sorted([(5, d) for d in [*range(1000), 9001, 9004]] + [(7, 9003), (7, 9005)])
    index.delete()


def test_batches(spark):
    """A batch after the other against brute force: what a batch loses lies in it or in those before."""
    rng, window = random.Random(5), 5
    texts = [" ".join(rng.choice("ab c d é".split(" ")) for _ in range(rng.randint(0, 14))) for _ in range(45)]
    index = substrings.FingerprintIndex(spark, store.fresh(spark, "index-test"), fanout=2)
    frame = lambda low, high: spark.createDataFrame(list(enumerate(texts[low:high], low)), "doc_id long, text string")
    for low in (0, 15, 30):
        got = substrings.deduplicate_batch(frame(low, low + 15), index, frame(0, low) if low else frame(0, 1).where("false"), window=window, gram=3).collect()
        want = plain(texts[: low + 15], window)
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == dict(enumerate(want[low:], low))
    index.delete()


def test_words_that_polynomials_confuse(spark):
    """Documents that differ in one word whose letters polynomial sums can't tell apart."""
    swapped = lambda n, a, b: "".join((a, b)[bin(i).count("1") & 1] for i in range(n))
    rest = " ".join(f"w{i}" for i in range(20))
    texts = [f"{rest} {swapped(n, *ab)} {' '.join(f'{n}v{i}' for i in range(14))}" for n in (1024, 4096) for ab in ("ab", "ba")]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.n_removed for r in substrings.deduplicate(rows).collect()} == {0}
