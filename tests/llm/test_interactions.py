"""The audit against filters that are applied one after another to plain rows."""

import re
from itertools import permutations

import duckdb

from corvex.llm import interactions, queries


def plain(docs, labels):
    """{(part, order, step): counts}, document by document."""
    texts = [(k, t or "", p or "") for k, t, p in docs]
    fails = []
    for k, t, _ in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        bad["E"] = k is not None and any(o is not None and o < k and u == t for o, u, _ in texts)
        fails.append({c for c, x in bad.items() if x})
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, x in labels if x == 1 and k is not None}
    out = {}
    for part in {p for _, _, p in texts}:
        mine = [(k, f) for (k, _, p), f in zip(texts, fails) if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, c in enumerate(order, 1):
                gone = [(k, f) for k, f in left if c in f]
                left = [(k, f) for k, f in left if c not in f]
                redundant = sum(c in f for _, f in mine) - len(gone)
                unique = sum(f == {c} for _, f in mine)
                shapley[c] += len(gone)
                out[part, order, step] = [len(left), len(gone), redundant, unique, sum(k in good for k, _ in gone), sum(k in toxic for k, _ in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


LONG = " ".join(f"word{i}" for i in range(250))
DOCS = [
    (1, LONG, "en"), (2, LONG, "de"), (2, LONG, "de"), (3, LONG, "en"), (4, None, None), (5, "", ""), (6, "", "en"), (None, LONG, "en"), (None, None, "en"),
    (7, LONG + " #", "en"), (8, "same " * 300, "de"), (9, "SHOUT " * 300, "de"), (10, LONG.upper(), "fr"), (1, LONG, "fr"), (11, "few words | here", "fr"), (12, "é" * 400, "fr"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, None, None), (8, 1, 1), (None, 1, 1), (99, 1, 1), (10, 0, 1)]
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def frames(spark, docs=DOCS, labels=LABELS):
    rows = [(*d, "clash", 7) for d in docs]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, mask string, part int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_equals_plain(spark):
    got = {(r.part, r.filter_order, r.step): [r[c] for c in COUNTS] for r in interactions.audit(*frames(spark)).collect()}
    assert got == plain(DOCS, LABELS)


def test_many_copies(spark):
    """A group of copies over two parts and many tasks; only its least key passes E."""
    docs = [(i, LONG, "en" if i % 2 else "de") for i in range(500)]
    got = {(r.part, r.filter_order, r.step): [r[c] for c in COUNTS] for r in interactions.audit(frames(spark, docs)[0].repartition(16), frames(spark)[1]).collect()}
    assert got == plain(docs, LABELS)


def test_empty(spark):
    docs, labels = frames(spark)
    assert interactions.audit(docs.limit(0), labels).count() == 0
    got = interactions.audit(docs, labels.limit(0)).collect()
    assert len(got) == 4 * 600 and not any(r.good_lost or r.toxic_lost for r in got)


def test_matrices():
    maps = interactions.matrices()
    assert all(m.shape == (32, 600) and set(m.ravel()) <= {0, 1} for m in maps.values())
    # Each mask is kept to the end of an order, or removed at one step of it.
    removed = maps["removed"].reshape(32, 120, 5).sum(axis=2)
    assert (removed + maps["kept"].reshape(32, 120, 5)[:, :, 4] == 1).all()


def test_sql_on_odd_rows(spark, tmp_path):
    docs, labels = frames(spark)
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    labels.coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    cursor = con.execute(queries.OP11_SQL)
    names = [d[0] for d in cursor.description]
    got = queries.op11_filter_interactions(spark, str(tmp_path)).collect()
    assert sorted(map(str, cursor.fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in got)
