"""Selectors in their order, limits, repeats across selectors, and the status table."""

from corvex.operators import selectors as sel

DOCS = "document_id string, title string, document_type string, year int, source_id string, language string, summary_language string, text_language string, acquisition_status string, summary string, char_count int"


def docs(spark):
    row = lambda k, title, kind="Act", year=2000, source="s", lang="en", status="downloaded", summary="", chars=9: (k, title, kind, year, source, lang, None, lang, status, summary, chars)
    return spark.createDataFrame(
        [
            row("a", "Bail Act", year=1997, summary="bail and remand"),
            row("b", "Bail Amendment", "Bill", 2002, summary="bail"),
            row("c", "Bail case", "Supreme Court Judgment", 2010, summary="bail bail custody"),
            row("d", "Customs Act", summary="bail duty", lang="si"),
            row("e", "Bail gone", status="missing", summary="bail"),
            row("f", "Bail empty", chars=0, summary="bail"),
            row("g", "Bail Act", year=None, summary="bail and remand"),
            row("h", "Gazette of bail", "Gazette", 1990, "t", summary="nothing"),
        ],
        DOCS,
    )


def names(spark, *selectors, count=10, language=None, query="bail"):
    rows = sel.resolve(docs(spark), [sel.Case("case", query, selectors, count, language)]).orderBy("place").collect()
    return [r.document_id for r in rows], [r.label for r in rows]


def test_order_and_limits(spark):
    assert names(spark, sel.Selector("ids", ("c", "zz", "a", "f")))[0] == ["c", "a"]
    assert names(spark, sel.Selector("ids", ("e",)))[0] == ["e"]
    # Statutes first, then by rank, year (none last) and title.
    assert names(spark, sel.Selector("title", title_like="bail%", limit=9))[0] == ["a", "g", "c", "b"]
    assert names(spark, sel.Selector("title", title_like="bail%", limit=2))[0] == ["a", "g"]
    assert names(spark, sel.Selector("types", document_types=("Gazette", "Bill")))[0] == ["h", "b"]
    assert names(spark, sel.Selector("source", source_ids=("t",)))[0] == ["h"]
    assert names(spark, sel.Selector("text", text_query="custody", limit=9))[0] == ["c"]
    assert names(spark, sel.Selector("text", text_query="bai", limit=9), language="si")[0] == ["d"]


def test_first_selector_wins(spark):
    got = names(spark, sel.Selector("first", title_like="%act", limit=2), sel.Selector("second", text_query="bail", limit=4))
    # No word of a title begins like the pattern's, so that years decide; the second selector's four are a, g, d and c.
    assert got == (["d", "a", "g", "c"], ["first", "first", "second", "second"])
    assert names(spark, sel.Selector("first", title_like="%act", limit=2), sel.Selector("second", text_query="bail", limit=4), count=3)[0] == ["d", "a", "g"]


def test_status(spark):
    expected = sel.resolve(docs(spark), [sel.Case("x", "bail", (sel.Selector("i", ("a", "b", "c")),)), sel.Case("y", "bail", (sel.Selector("i", ("d",)),))])
    first = spark.createDataFrame([("x", "a", 4), ("x", "b", 1), ("y", "a", 1)], "case_id string, document_id string, rank int")
    final = spark.createDataFrame([("x", "b", 1, 90.0), ("x", "a", 7, 20.0)], "case_id string, document_id string, rank int, score double")
    table = sel.status(expected, first, final, 5)
    got = {(r.case_id, r.document_id): (r.found_in_stage1, r.stage1_rank, r.found_in_final_top_k, r.final_rank, r.final_relevance_score) for r in table.collect()}
    assert got == {("x", "a"): (True, 4, False, 7, 20.0), ("x", "b"): (True, 1, True, 1, 90.0), ("x", "c"): (False, None, False, None, None), ("y", "d"): (False, None, False, None, None)}
    rows = {r.case_id: r for r in sel.summary(table).collect()}
    assert (rows["x"].stage1_expected_recall, rows["x"].top_k_expected_recall, rows["x"].missing_from_stage1, rows["x"].missing_from_top_k) == (0.666667, 0.333333, "c", "a|c")
    assert (rows["y"].expected_count, rows["y"].stage1_found_count) == (1, 0)
