"""Components against all pairs by brute force, on generated groups and on the tables; edges."""

import random

import numpy as np

from corvex.llm import components, jaccard, store
from corvex.llm.queries import op2_jaccard_join


def plain(rows, k, percent):
    """{doc: (tokens, component)} by comparing all pairs."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for d, t in rows:
        w = (t or "").translate(lower).encode().split()
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_token = {}
    for d, s in sets.items():
        for x in s:
            by_token.setdefault(x, []).append(d)
    pairs = {(a, b) for ds in by_token.values() for i, a in enumerate(ds) for b in ds[i + 1 :]}
    for a, b in pairs:
        n = len(sets[a] & sets[b])
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_groups(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(3, 150))]
        for _ in range(rng.randint(1, 25)):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(copy) // 30)):
                copy[rng.randrange(len(copy))] = rng.choice(words).upper()
            rows.append((n, " ".join(copy)))
            n += 1
    passage = " ".join(rng.choice(words) for _ in range(40))
    rows += [(n + i, f"{rng.random()} {passage} " + " ".join(rng.choice(words) for _ in range(rng.randint(0, 8)))) for i in range(60)]
    rows += [(9001, None), (9002, ""), (9003, "One"), (9004, "one"), (9005, "one two"), (9006, "ONE  two\n"), (9007, "é")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, node string").repartition(6)
    for k, percent in ((3, 90), (5, 80), (2, 50)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs, k, percent).collect()}
        assert got == plain(rows, k, percent), (k, percent)


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op2_jaccard_join(spark, sf).collect()}
    assert got == plain(rows, 3, 90)


def test_filters_lose_nothing():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 1500), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], rng.integers(0, 1 << 62, rng.integers(0, 40), dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        if len(b) and 100 * common >= 80 * (len(a) + len(b) - common):
            group = jaccard.Group(np.array([1, 2]), np.array([len(a), len(b)]), np.array([0, 0]), [jaccard.parity_bitmap(x, 80) for x in (a, b)], np.array([1, 2]), 80)
            assert group.passes(0, np.array([1]))[0] and group.pair() == [(1, 2)]


def test_repeats_nulls_empty(spark):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (7, "A b c d e"), (None, None), (8, "z")]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, 0, -1), (-1, 1, 5), (5, 1, 5), (5, 1, 5), (7, 1, 5), (8, 1, 8)]
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(50)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_stars_need_no_step(spark, monkeypatch):
    """Edges that are stars already are not joined again; a round's edges lie between labels and mostly are."""
    names, edges = [], spark.createDataFrame([(5, 1), (1, 9), (7, 7), (30, 20)], "low long, high long")
    monkeypatch.setattr(store.Scratch, "stage", lambda self, df, name, f=store.Scratch.stage: (names.append(name), f(self, df, name))[1])
    assert sorted(map(tuple, components.components(edges, None, "low", "high").collect())) == [(1, 1), (5, 1), (9, 1), (20, 20), (30, 20)]
    assert names == ["edges", "components"]


def test_words_that_polynomials_confuse(spark):
    swapped = lambda n, a, b: "".join((a, b)[bin(i).count("1") & 1] for i in range(n))
    rows = [(10 * n + i, f"A {swapped(n, *ab)} z") for n in (1024, 2048, 4096) for i, ab in enumerate(("ab", "ba"))]
    got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert got == {d: d for d, _ in rows}


def test_blocks(spark, monkeypatch):
    """Groups of frequent tokens dealt in blocks: large groups of near copies, and texts of frequent words."""
    monkeypatch.setattr(jaccard, "GROUP_ROWS", 4)
    rng = random.Random(12)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for n in range(150):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 12])):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(9)}"
        rows.append((n, " ".join(copy)))
    rows += [(500 + n, " ".join(rng.choice("abc") for _ in range(rng.randint(3, 14)))) for n in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for k, percent in ((3, 90), (2, 60)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs, k, percent).collect()}
        assert got == plain(rows, k, percent), (k, percent)


def test_large_components_meet_in_one_pair(spark, monkeypatch):
    """Two clusters with links between any of their documents: the rounds make far fewer pairs than there are links."""
    made = []
    rng, base = random.Random(5), [f"w{i}" for i in range(200)]
    rows = []
    for n in range(240):
        copy = list(base)
        copy[rng.randrange(100, 200)] = f"x{n}"
        rows.append((n, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    group = jaccard.Group(np.arange(60), np.full(60, 50), np.zeros(60, dtype=int), [bytes(64)] * 60, np.repeat([1, 2, 3], 20), 80)
    group.sent = np.arange(60) >= 20
    assert len(jaccard.across(group)) == 20 * 40 and sorted((group.label[a], group.label[b]) for a, b in jaccard.meeting(group)) == [(2, 1), (3, 1)]
    monkeypatch.setattr(jaccard, "GROUP_ROWS", 8)
    monkeypatch.setattr(jaccard, "verify", lambda pairs, *more, f=jaccard.verify: (made.append(pairs.count()), f(pairs, *more))[1])
    got = {r.doc_id: r.component_id for r in jaccard.join(docs, 5, 80).collect()}
    assert got == {d: c for d, (_, c) in plain(rows, 5, 80).items()} and sum(made) < 4 * len(rows)
