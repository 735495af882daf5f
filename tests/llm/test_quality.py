"""The ledger against a brute-force version and SQL; policies, ablation and edges."""

import re
from collections import Counter

import duckdb

from corvex.llm import queries, quality

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "fail_bits")


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, chars = len(w), sum(map(len, w))
    grams = Counter(tuple(w[i : i + 8]) for i in range(n - 7))
    repeated = len({j for i in range(n - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)})
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols, dup = len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines))
    bad = [n < 20, 100 * repeated > 30 * n, n > 0 and chars > 25 * n, n > 0 and chars < 2 * n, 10 * symbols > n]
    bad += [100 * sum(c.isupper() for c in text) > 40 * chars, 10 * text.count("!") > 3 * n, len(lines) > 4 and 2 * dup > len(lines)]
    return n, chars, symbols, dup, repeated, sum(1 << i for i, x in enumerate(bad) if x)


TEXTS = [
    None, "", " \n\t", "f", "foo bar f", "f f f", "\x0cone two\x0c", "\x0bfour\x0b five\r", "a  b\n\n c", "é ü 漢字 \U0001f600 x",
    "one two three four five six seven eight " * 4, "x\n" * 9 + "y\n", "WORD! # $ " * 10, "the same line of words here\nthe same line of words here\n" * 3,
    " ".join(f"w{i}" for i in range(40)), " no break space", "n" * 5000,
]


def test_ledger(spark):
    rows = [(i, t, i, "x") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], 7, "y"), (None, TEXTS[10], 8, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, fail_bits string")
    got = quality.ledger(docs).collect()
    assert len(got) == len(rows)
    by_key = {}
    for r in got:
        by_key.setdefault(r.doc_id, []).append(tuple(r[m] for m in MEASURES))
    for i, t, _, _ in rows:
        assert set(by_key[i]) == {plain(t)}, t
    kept = quality.passing(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, t, _, _ in rows if i is not None and plain(t)[-1] == 0]
    lenient = {r.doc_id for r in quality.apply_policy(quality.ledger(docs), "base").where("kept").collect()}
    assert lenient - {None} == {i for i, t, _, _ in rows if i is not None and not plain(t)[-1] & 3}


def test_empty_and_long(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert quality.ledger(none).count() == 0 and quality.passing(none).count() == 0
    assert {r.n_failed for r in quality.ablation(quality.ledger(none)).collect()} == {0}
    long = "ab cde f " * 350_000
    row = quality.ledger(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert (row.n_words, row.word_chars, row.n_repeat_words) == (1_050_000, 6 * 350_000, 1_050_000)


def test_ablation(spark, sf):
    rows, stored = quality.stored(spark.read.parquet(f"{sf}/documents.parquet"))
    assert sorted(map(str, stored.collect())) == sorted(map(str, quality.ablation(rows).collect()))
    assert "documents.parquet" not in quality.apply_policy(rows)._jdf.queryExecution().executedPlan().toString()
    for r in quality.decided(rows).collect():
        for p, mask in quality.POLICIES.items():
            own = r.fail_bits & mask
            alone = [n for b, (n, _) in quality.RULES.items() if own == 1 << b]
            assert r[f"kept_{p}"] == (own == 0) and r[f"alone_{p}"] == (alone[0] if alone else None)
    bits = [r.fail_bits for r in rows.collect()]
    for r in quality.ablation(rows).collect():
        mask, bit = quality.POLICIES[r.policy], 1 << next(b for b, (n, _) in quality.RULES.items() if n == r.rule)
        want = [sum(bool(x & bit) for x in bits), sum(x & mask == bit for x in bits), sum(not x & mask & ~bit for x in bits)]
        assert [r.n_failed, r.n_only_this, r.n_kept_without] == want and r.n_docs == len(bits)


def test_sql(spark, sf, tmp_path):
    """The queries that have SQL, and texts that the tables lack."""
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        cursor = con.execute(sql)
        names = [d[0] for d in cursor.description]
        assert sorted(map(str, cursor.fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in queries.queries()[name](spark, sf).collect())
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con.execute(f"create or replace view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    cursor = con.execute(queries.OP10_SQL)
    names = [d[0] for d in cursor.description]
    got = queries.op10_quality_rules(spark, str(tmp_path)).collect()
    assert sorted(map(str, cursor.fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in got)
