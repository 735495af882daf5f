"""Checks of a structured case against its raw text: spans, ids, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that are checked for coverage, and the share that is low.
LONG, LOW = 120, 0.35


def span_warning(raw: Column, span: Column) -> Column:
    """What is wrong with a span (quote, start_char, end_char); a quote that stands elsewhere in the text gets its offsets from there."""
    quote = F.coalesce(span["quote"], F.lit(""))
    return F.when(quote == "", "has no exact source quote").when(~F.contains(raw, quote), "quote is not an exact substring of raw input")


def placed(raw: Column, span: Column) -> Column:
    """The span with the offsets of its quote's first place, its own where there is none."""
    at = F.instr(raw, F.coalesce(span["quote"], F.lit("")))
    found = (F.coalesce(span["quote"], F.lit("")) != "") & (at > 0)
    return F.struct(span["quote"].alias("quote"), F.when(found, at - 1).otherwise(span["start_char"]).alias("start_char"), F.when(found, at - 1 + F.length(span["quote"])).otherwise(span["end_char"]).alias("end_char"))


def coverage(raw: Column, spans: Column) -> Column:
    """The share of the text that spans with offsets cover, to four digits: a running end over spans in order."""
    n = F.length(raw)
    cut = F.transform(F.filter(spans, lambda s: s["start_char"].isNotNull() & s["end_char"].isNotNull()), lambda s: F.struct(F.greatest(F.lit(0), s["start_char"]).alias("a"), F.least(n, s["end_char"]).alias("b")))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    total = F.aggregate(F.array_sort(cut), start, lambda acc, s: F.struct(F.greatest(acc["end"], s["b"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(acc["end"], s["a"]))).alias("n")), lambda acc: acc["n"])
    return F.when(n == 0, F.lit(0.0)).otherwise(F.round(total / n, 4))


def warnings(cases: DataFrame) -> DataFrame:
    """(case_id, path, warning) of every breach.

    cases: case_id, raw, facts (array of fact_id, certainty_label, source_spans),
    parties and timeline (arrays of source_spans), issues (array of
    supporting_fact_ids, certainty_label, inferred_reason), queries (array).
    """
    raw = F.coalesce(F.col("raw"), F.lit(""))
    none = F.array().cast("array<struct<path:string,warning:string>>")
    row = lambda path, text: F.struct(path.alias("path"), text.alias("warning"))
    place = lambda name, i: F.concat(F.lit(f"{name}["), (i + 1).cast("string"), F.lit("]"))

    def spans_of(name: str) -> Column:
        def each(x: Column, i: Column) -> Column:
            return F.transform(F.coalesce(x["source_spans"], F.array().cast("array<struct<quote:string,start_char:int,end_char:int>>")), lambda s, j: row(F.concat(place(name, i), F.lit(".source_spans["), (j + 1).cast("string"), F.lit("]")), span_warning(raw, s)))

        return F.filter(F.flatten(F.transform(F.coalesce(F.col(name), F.array().cast(cases.schema[name].dataType)), each)), lambda w: w["warning"].isNotNull())

    spans = F.flatten(F.transform(F.concat(*[F.transform(F.coalesce(F.col(n), F.array().cast(cases.schema[n].dataType)), lambda x: F.coalesce(x["source_spans"], F.array().cast("array<struct<quote:string,start_char:int,end_char:int>>"))) for n in ("parties", "facts", "timeline")]), lambda s: F.transform(s, lambda x: placed(raw, x))))
    facts, issues = F.coalesce(F.col("facts"), F.array().cast(cases.schema["facts"].dataType)), F.coalesce(F.col("issues"), F.array().cast(cases.schema["issues"].dataType))
    ids = F.transform(facts, lambda f: f["fact_id"])
    known = F.filter(facts, lambda f: f["certainty_label"] != "missing")
    bare = F.transform(facts, lambda f, i: F.when((f["certainty_label"] != "missing") & (F.size(F.coalesce(f["source_spans"], F.array().cast("array<struct<quote:string,start_char:int,end_char:int>>"))) == 0), row(place("facts", i), F.lit("has no source spans"))))
    twice = F.array_sort(F.array_distinct(F.filter(ids, lambda x: F.size(F.filter(ids, lambda y: y == x)) > 1)))
    unknown = F.transform(issues, lambda x, i: F.when(F.size(F.array_except(x["supporting_fact_ids"], ids)) > 0, row(place("issues", i), F.concat(F.lit("references unknown supporting facts: "), F.array_join(F.array_sort(F.array_except(x["supporting_fact_ids"], ids)), ", ")))))
    inferred = F.transform(issues, lambda x, i: F.when((x["certainty_label"] == "inferred") & (F.trim(F.coalesce(x["inferred_reason"], F.lit(""))) == ""), row(place("issues", i), F.lit("is inferred but has no inferred_reason"))))
    share = coverage(raw, spans)
    when = lambda test, path, text: F.when(test, F.array(row(F.lit(path), text))).otherwise(none)
    found = F.concat(
        spans_of("parties"), spans_of("facts"), F.array_compact(bare), spans_of("timeline"),
        when(F.size(twice) > 0, "facts", F.concat(F.lit("duplicate fact IDs: "), F.array_join(twice, ", "))), F.array_compact(unknown), F.array_compact(inferred),
        when((F.trim(raw) != "") & (F.size(known) == 0), "facts", F.lit("structure contains no non-missing facts from non-empty raw input")),
        when((F.length(F.trim(raw)) >= LONG) & (share < LOW), "spans", F.concat(F.lit("source span coverage is low: "), F.format_number(share * 100, 2), F.lit("%"))),
        when((F.size(F.coalesce(F.col("queries"), F.array().cast("array<string>"))) == 0) & ((F.size(issues) > 0) | (F.size(known) > 0)), "queries", F.lit("structure has facts or issues but no retrieval queries")),
    )
    return cases.select("case_id", F.inline(found))
