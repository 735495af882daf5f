"""Relevance selectors: which documents a test case expects, and where the ranking has them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvex.functions import text as tx
from corvex.operators.search_index import word_tokens
from corvex.operators.two_stage import query_prefixes


@dataclass(frozen=True)
class Selector:
    """Names documents by ids, or by title pattern, types, sources and words, at most ``limit`` of them."""

    label: str
    document_ids: tuple[str, ...] = ()
    title_like: str | None = None
    document_types: tuple[str, ...] = ()
    source_ids: tuple[str, ...] = ()
    text_query: str | None = None
    limit: int = 5


@dataclass(frozen=True)
class Case:
    """A query with the selectors of the documents that it should find."""

    case_id: str
    query: str
    selectors: tuple[Selector, ...]
    expected_count: int = 10
    language: str | None = None


#: Order of the kinds of documents.
TYPE_PRIORITY = (("Constitution", "Core Legislation", "Act"), "Judgment", "Gazette")


def type_priority(kind: Column) -> Column:
    """0 for statutes, 1 for judgments, 2 for gazettes, 3 for all else."""
    first, *rest = TYPE_PRIORITY
    out = F.when(kind.isin(*first), 0)
    for i, word in enumerate(rest, 1):
        out = out.when(kind.contains(word), i)
    return out.otherwise(3)


def _match(case: Case, at: int, s: Selector) -> Column:
    """The entry of a document for a selector, null where it isn't meant: case, place, keys of order, limit."""
    entry = lambda *order: F.struct(F.lit(case.case_id).alias("case_id"), F.lit(at).alias("selector"), F.lit(s.label).alias("label"), F.lit(s.limit if not s.document_ids else len(s.document_ids)).alias("limit"), F.lit(case.expected_count).alias("expected_count"), *[c.alias(f"o{i}") for i, c in enumerate(order)])
    nothing = F.lit(0).cast("int")
    if s.document_ids:
        place = F.array_position(F.array(*map(F.lit, s.document_ids)), F.col("document_id")).cast("int")
        return F.when(F.col("document_id").isin(*s.document_ids), entry(place, F.lit(0.0), nothing, F.lit("")))
    prefixes = query_prefixes(s.text_query or s.title_like or case.query)
    summary, title = tx.or_rank(F.col("_summary"), prefixes), tx.or_rank(F.col("_title"), prefixes)
    tests = [F.col("acquisition_status") == "downloaded"]
    if case.language:
        tests.append(reduce(lambda a, b: a | b, [F.col(c).eqNullSafe(case.language) for c in ("language", "summary_language", "text_language")]))
    tests += [F.col("title").ilike(s.title_like)] if s.title_like else []
    tests += [F.col("document_type").isin(*s.document_types)] if s.document_types else []
    tests += [F.col("source_id").isin(*s.source_ids)] if s.source_ids else []
    tests += [summary > 0] if s.text_query else []
    order = entry(type_priority(F.col("document_type")), -F.round(summary + 3 * title, 9), -F.coalesce("year", F.lit(-(1 << 30))).cast("int"), F.coalesce("title", F.lit("")))
    return F.when(reduce(lambda a, b: a & b, tests), order)


def resolve(docs: DataFrame, cases: list[Case]) -> DataFrame:
    """(case_id, document_id, title, document_type, year, source_id, language, label, place) of the expected documents.

    docs: document_id, title, document_type, year, source_id, language,
    summary_language, text_language, acquisition_status, summary, char_count.
    One pass over the documents answers all selectors of all cases.  A selector
    keeps its first ``limit`` documents; a document counts for the first
    selector that has it; a case ends with its expected count.  Documents
    without text are never meant.
    """
    attributes = ["document_id", "title", "document_type", "year", "source_id", "language"]
    rows = docs.where("char_count > 0").withColumns({"_summary": word_tokens(F.coalesce("summary", F.lit(""))), "_title": word_tokens(F.coalesce("title", F.lit("")))})
    entries = [_match(case, at, s) for case in cases for at, s in enumerate(case.selectors)]
    rows = rows.select(*attributes, F.explode(F.array_compact(F.array(*entries))).alias("e")).select(*attributes, "e.*")
    order = [F.col(f"o{i}") for i in range(4)] + [F.col("document_id")]
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("case_id", "selector").orderBy(*order))).where("_r <= limit")
    rows = rows.withColumn("_d", F.row_number().over(Window.partitionBy("case_id", "document_id").orderBy("selector"))).where("_d = 1")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("case_id").orderBy("selector", "_r"))).where("place <= expected_count")
    return rows.select("case_id", *attributes, "label", "place")


def status(expected: DataFrame, first: DataFrame, final: DataFrame, top_k: int) -> DataFrame:
    """Each expected document with its rank in the first stage and the end (case_id, document_id, rank; final also score)."""
    a = first.select("case_id", "document_id", F.col("rank").alias("stage1_rank"))
    b = final.select("case_id", "document_id", F.col("rank").alias("final_rank"), F.col("score").alias("final_relevance_score"))
    rows = expected.join(a, ["case_id", "document_id"], "left").join(b, ["case_id", "document_id"], "left")
    return rows.withColumns({"found_in_stage1": F.col("stage1_rank").isNotNull(), "found_in_final_top_k": F.coalesce(F.col("final_rank") <= top_k, F.lit(False))})


def summary(table: DataFrame) -> DataFrame:
    """Of each case: how many documents it expects, how many were found, recalls, and what is missing."""
    n = F.greatest(F.lit(1), F.count("*"))
    found = {k: F.count_if(c) for k, c in (("stage1", F.col("found_in_stage1")), ("top_k", F.col("found_in_final_top_k")))}
    missing = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(~F.col(c), F.col("document_id")))), "|")
    return table.groupBy("case_id").agg(
        F.count("*").alias("expected_count"), *[c.alias(f"{k}_found_count") for k, c in found.items()], *[F.round(c / n, 6).alias(f"{k}_expected_recall") for k, c in found.items()],
        missing("found_in_stage1").alias("missing_from_stage1"), missing("found_in_final_top_k").alias("missing_from_top_k"),
    )
