"""Operators on small tables with results worked out by hand."""

import math
import re

import pytest
from pyspark.sql import functions as F

from corvex.functions import classify, html, registry as reg, text as tx
from corvex.operators import chunking, evaluate, fusion, relational as rel, search, two_stage, workspace
from corvex.sources import files


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_similarity_and_quality(spark):
    assert one(spark, tx.similarity(tx.trigrams(F.lit("word")), tx.trigrams(F.lit("two words"))))[0] == pytest.approx(4 / 11)
    parts = tx.extraction_quality(F.lit("short ~~~~"), F.lit("ocr"), F.lit(0.5))
    row = one(spark, *[c.alias(k) for k, c in parts.items()])
    assert row.quality_flags == ["unusable_ocr", "very_short_text"] and not row.legal_answer_eligible and row.confidence_band == "unusable"
    assert one(spark, tx.normalize_text(F.lit(" a \r\n\r\n b\t\tc\x01d ")))[0] == "a\nb c d"
    assert one(spark, tx.estimate_tokens(F.lit("")), tx.estimate_tokens(F.lit("a b c d")))[:] == (1, 5)


def test_metrics(spark):
    cases = spark.createDataFrame([(1, ["a", "c"], ["b", "a", "c"]), (2, [], ["x"])], "query_id int, expected array<string>, ranked array<string>")
    got = {r.query_id: r for r in evaluate.metrics(cases, 2).collect()}
    assert (got[1].recall, got[1].rr, got[2].recall) == (0.5, 0.5, 1.0)
    third = evaluate.metrics(cases, 3).where("query_id = 1").first()
    assert third.ndcg == pytest.approx(0.693426, abs=1e-6)
    with pytest.raises(ValueError):
        evaluate.metrics(cases, 0)


def test_fusion(spark):
    rows = [(0, 1, "s", 9.0, "dense", 3, False), (1, 1, "x", 999.0, "exact", 3, True), (2, 1, "x", 5.0, "bm25", 3, False)]
    hits = spark.createDataFrame(rows, "result_set int, rank int, chunk_id string, score double, retriever string, authority_level int, exact boolean")
    got = fusion.reciprocal_rank_fusion(hits).orderBy(F.col("score").desc()).collect()
    assert [r.chunk_id for r in got] == ["x", "s"]
    assert got[0].retrieval_evidence == ["bm25 rank 1", "exact rank 1"]
    assert got[0].score == pytest.approx((2 / 61 + 0.1) * 1.25)


def test_pack_skips_what_overflows(spark):
    rows = [(1, i + 1, f"c{i}", f"d{i % 2}", n) for i, n in enumerate([50, 60, 40, 5, 9])]
    hits = spark.createDataFrame(rows, "pack_id int, seq int, chunk_id string, document_id string, tokens long")
    got = fusion.select_pack(hits, 3, 100).orderBy("item").collect()
    assert [(r.pack_item_id, r.chunk_id, r.note) for r in got] == [("1_item_001", "c0", "new source document"), ("1_item_002", "c2", "high authority"), ("1_item_003", "c3", "new source document")]
    assert [r.chunk_id for r in fusion.select_pack(hits, 3, 10).collect()][:1] == ["c0"]


def test_chunks():
    words = lambda n: " ".join(["w"] * n)
    assert list(chunking.segments(words(10), 8)) == [words(6), words(4)]
    assert list(chunking.segments("x" * 2000, 100)) == ["x" * 2000]
    runs = list(chunking.group([(1, words(30)), (2, words(45)), (3, words(3)), (4, words(60))], 100, 10))
    assert [[p for p, _ in r] for r in runs] == [[1, 2], [3, 4]]
    assert [[p for p, _ in r] for r in chunking.group([(1, words(60)), (2, words(30))], 100, 10)] == [[1], [2]]
    assert [[p for p, _ in r] for r in chunking.group([(1, words(75)), (2, words(3))], 100, 10)] == [[1], [2]]


def test_anchor():
    pages = [(1, "alpha beta\ngamma"), (2, "delta epsilon")]
    assert chunking.locate(pages, "beta") == [(1, 6, 10, "exact", 1.0)]
    assert chunking.locate(pages, "beta gamma") == [(1, 6, 16, "normalized", 0.95)]
    assert chunking.locate(pages, "gamma delta") == [(1, 11, 16, "cross_page", 0.95), (2, 0, 5, "cross_page", 0.95)]
    assert chunking.locate(pages, "zeta") == chunking.locate(pages, " ") == []


def test_relational(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 9)], "k int, t string, n int")
    new = spark.createDataFrame([(2, "", 3), (3, "c", 1)], "k int, t string, n int")
    got = {r.k: (r.t, r.n) for r in rel.merge_by_key(old, new, ["k"], {"t": "fill", "n": "greatest"}).collect()}
    assert got == {1: ("a", 5), 2: ("b", 9), 3: ("c", 1)}
    assert {r.k: r.t for r in rel.merge_by_key(old, new, ["k"], {"t": "overwrite"}).collect()}[2] == ""
    assert sorted(r.k for r in rel.insert_absent(old, new, ["k"]).collect()) == [1, 2, 3]
    assert sorted((r.k, r.t) for r in rel.replace_scope(old, new, "k").collect()) == [(1, "a"), (2, ""), (3, "c")]
    cursor = rel.cursor_of({"k": 2})
    assert [r.k for r in rel.keyset_page(old, ["k"], 5, cursor).collect()] == [1]
    ranges = spark.createDataFrame([(1, 4, None), (2, 1, 3)], "k int, low int, high int")
    assert [r.k for r in rel.outside_ranges(old, ranges, "k", "n", "low", "high").orderBy("k").collect()] == [1, 2]


def test_exact_citation(spark):
    rows = [("a", "Act No. 5 of 1990", "section 3 ( 1 ) says", 2, 1990, 1, 0), ("b", "Act No. 5 of 1990", "3(1)", 1, None, None, 0), ("c", "x", "3(1) alone", 1, 2000, 1, 1), ("d", "x", "article 3(1)", 1, 2001, 2, 1)]
    chunks = spark.createDataFrame(rows, "id string, title string, text string, authority_level int, year int, page_start int, chunk_index int")
    got = search.exact_citation(chunks, [("5", 1990)], ["3(1)"], [])
    assert [(r.id, r.score) for r in got.orderBy("rank").collect()] == [("b", 999.0), ("a", 998.0)]
    assert [r.id for r in search.exact_citation(chunks, [], ["3(1)"], []).orderBy("rank").collect()] == ["d", "a"]


def test_files(spark, tmp_path):
    (tmp_path / "m.csv").write_text("document_id,year,ocr_required,date,notes,title,text_quality_score,document_type,source_id,last_checked\na,1990,yes,2020-01-02,pages_path=/x;y=1,T,0.5,Act,S,2024-05-06T07:08:09Z\nb,x,no,,,,z,,SUPREME,soon\n")
    rows = {r.document_id: r for r in files.typed_manifest(files.read_csv_rows(spark, str(tmp_path / "m.csv"))).collect()}
    assert (rows["a"].year, rows["a"].ocr_required, rows["a"].authority_level) == (1990, True, 2)
    assert rows["a"].last_checked.isoformat() == "2024-05-06T07:08:09" and rows["b"].last_checked is None
    assert (rows["b"].year, rows["b"].date, rows["b"].text_quality_score, rows["b"].authority_level) == (None, None, None, 3)
    assert files.read_csv_rows(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "p.jsonl").write_text('{"document_id": "a", "page": 1, "text": " x  y "}\n{"document_id": "a", "page_number": 2, "text": "z"}\n')
    assert sorted((r.page_number, r.text) for r in files.read_pages_jsonl(spark, str(tmp_path / "p.jsonl")).collect()) == [(1, "x y"), (2, "z")]
    words = spark.createDataFrame([(1, 1, 1, 1, 1, 90.0, "Hello"), (1, 1, 1, 1, 2, -1.0, "you"), (1, 1, 1, 1, 3, 80.0, " ")], "page int, block int, par int, line int, word int, conf double, text string")
    row = files.ocr_lines(words).first()
    assert (row.line_text, row.confidence, row.n_words, row.band) == ("Hello you", 90.0, 2, "high")
    files.write_index(search.inverted_index(spark.createDataFrame([("d", "ab ab cd")], "document_id string, text string")), str(tmp_path / "i"), 2)
    assert sorted((r.term, r.tf, r.dl) for r in spark.read.parquet(str(tmp_path / "i")).collect()) == [("ab", 2, 3), ("cd", 1, 3)]


def test_text_helpers(spark):
    page = spark.createDataFrame([(1, "<p>a &amp; b</p><script>x</script><a class=c href=\"/f%20g.pdf?x#y\">Go <b>on</b></a><a href='?s'>s</a>")], "id int, html string")
    assert page.select(html.strip_tags(F.col("html"))).first()[0].startswith("a & b")
    link = html.listing(page, "id").first()
    assert (link.href, link.label, link.name) == ("/f%20g.pdf?x#y", "Go on", "f g.pdf")
    assert one(spark, reg.pack_paragraphs(F.lit("aa\n\nbb\n\ncccccccc\n\nd"), 6))[0] == ["aa\n\nbb", "cccccc", "cc", "d"]
    signals = one(spark, classify.citation_signals(F.lit("Smith v. Jones, under section 5(2) of Act No. 7 of 1999")))[0]
    assert (signals.acts, signals.provisions, signals.cases) == (["7/1999"], ["section 5(2)"], ["Smith v Jones"])
    text = "Search for  Smith  Ltd vs. jones; Sections 5 (A), 6 and 7b under Articles 9; sec. 6 of act No. 12a of 2001: smith LTD v Jones, act no 12A of 2001"
    signals = one(spark, classify.citation_signals(F.lit(text)))[0]
    assert (signals.acts, signals.provisions) == (["12A/2001"], ["sections 5(a)", "sections 6", "sections 7b", "articles 9", "sec 6"])
    clean = lambda x: re.sub(classify.PARTY_LEAD_RE, "", re.sub(r"\s+", " ", x.strip(" ,.;:\n\t")).strip())
    names = [f"{clean(m[1])} v {clean(m[2])}" for m in re.finditer(classify.CASE_RE, text)]
    assert signals.cases == [n for i, n in enumerate(names) if n.lower() not in [x.lower() for x in names[:i]]] != []
    assert one(spark, tx.or_rank(F.array(F.lit("thing"), F.lit("x")), ["th"]))[0] == pytest.approx(0.1 / 1.1)


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([("a", "T", 6, "xx xx yy"), ("b", "xx", 6, "zz")], "document_id string, title string, authority_level int, text string")
    got = {r.document_id: r.score for r in search.bm25(docs, "xx").collect()}
    idf = math.log(1 + (2 - 1 + 0.5) / 1.5)
    assert got["a"] == pytest.approx(idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 2)))
    assert got["b"] == pytest.approx(0.4)


def test_metrics_of_very_long_texts(spark):
    docs = spark.createDataFrame([("a", "x " * 500_000 + "on bail and customs")], "document_id string, text string")
    row = two_stage.full_text_metrics(docs, "bail customs", ["bail and customs", "no bail"]).first()
    assert (row.term_hits, row.phrase_hits) == (2, 1)
    assert row.full_text_rank == pytest.approx(0.2 / 1.2)


def test_pack_takes_a_late_item_that_fits(spark):
    rows = [(i + 1, f"c{i}", f"d{i}", 50 if i in (0, 2500) else 60) for i in range(3000)]
    hits = spark.createDataFrame(rows, "seq int, chunk_id string, document_id string, tokens long").withColumn("pack_id", F.lit(1))
    assert [r.chunk_id for r in fusion.select_pack(hits, 3, 100).orderBy("item").collect()] == ["c0", "c2500"]


def test_candidate_filter(spark):
    good = ("short", "downloaded", "x", 1, "en", "si", None, "Act")
    rows = {"a": good, "b": ("long", *good[1:]), "c": ("short", "failed", *good[2:]), "d": (*good[:2], None, *good[3:]), "e": (*good[:3], 0, *good[4:]), "f": (*good[:4], "ta", "ta", "en", "Bill"), "g": (*good[:4], None, None, None, None)}
    docs = spark.createDataFrame([(k, *v) for k, v in rows.items()], "id string, summary_type string, acquisition_status string, text string, char_count int, language string, summary_language string, text_language string, document_type string")
    ids = lambda *args: "".join(sorted(r.id for r in two_stage.candidate_filter(docs, "short", *args).collect()))
    assert [ids(), ids("en"), ids("si"), ids("ta", ("Act",)), ids(None, ("Act", "Bill"))] == ["afg", "af", "a", "", "af"]


def test_first_of_decisions_at_one_time_counts(spark, tmp_path):
    items = spark.createDataFrame([(i, "draft", "pending") for i in range(3)], "review_item_id int, item_type string, status string")
    rows = [(0, "approved", 5), (0, "rejected", 5), (0, "rejected", 4), (1, "rejected", 5), (1, "approved", 5), (1, "maybe", 5), (2, "maybe", 1), (2, "approved", 1)]
    path = str(tmp_path / "decisions")
    spark.createDataFrame(rows, "review_item_id int, decision string, decided_at int").coalesce(1).write.parquet(path)
    decisions = spark.read.parquet(path).select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("place"))
    got = {r.review_item_id: r.item_status for r in workspace.decide(items, decisions.repartition(3)).collect()}
    assert got == {0: "approved", 1: "rejected", 2: None}
