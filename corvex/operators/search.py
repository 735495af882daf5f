"""Ranked search over tables without an index: BM25 by a scan, exact citations, filters; the index is in search_index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvex.functions import classify, text as tx


def filters(document_types: list[str] | None = None, source_ids: list[str] | None = None, authority_levels: list[int] | None = None, years: list[int] | None = None, year_from: int | None = None, year_to: int | None = None, language: str | None = None, require_official: bool = False) -> Column:
    """The conjunction of the given restrictions; it reaches the scan."""
    tests = [F.col(c).isin(*v) for c, v in (("document_type", document_types), ("source_id", source_ids), ("authority_level", authority_levels), ("year", years)) if v]
    tests += [F.col("year") >= year_from] if year_from is not None else []
    tests += [F.col("year") <= year_to] if year_to is not None else []
    tests += [F.col("language") == language] if language is not None else []
    tests += [F.col("authority_level") <= 4] if require_official else []
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def inverted_index(chunks: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
    """(term, key, tf, dl): the keyword index as a table to write and read again."""
    rows = chunks.select(key, tx.bm25_tokens(F.col(text)).alias("tokens"))
    rows = rows.select(key, F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    return rows.groupBy("term", key).agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def bm25(chunks: DataFrame, query: str, key: str = "document_id", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """key and score of the chunks with a positive score.

    Okapi BM25 where a repeated query term counts repeatedly, 0.4 for each
    distinct query term in the title and citation, times the authority boost.
    One pass over the chunks: tokens are counted against the query's few terms
    inside the row, so only the totals are exchanged.
    """
    asked = [t.lower() for t in _query_tokens(query)]
    distinct = list(dict.fromkeys(asked))
    if not distinct:
        return chunks.select(key, F.lit(0.0).alias("score")).where(F.lit(False))
    rows = chunks.select(key, "title", "authority_level", tx.bm25_tokens(F.col("text")).alias("tokens"))
    rows = rows.select(key, "title", "authority_level", F.size("tokens").alias("dl"), *[_count(F.col("tokens"), w).alias(f"tf{i}") for i, w in enumerate(distinct)])
    total = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(distinct))])
    rows = rows.join(F.broadcast(total))  # one row
    score = F.lit(0.0)
    for i, w in enumerate(distinct):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        tf = F.col(f"tf{i}")
        score = score + asked.count(w) * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    titled = sum((F.when(F.lower("title").contains(w), F.lit(0.4)).otherwise(0.0) for w in distinct), F.lit(0.0))
    return rows.select(key, ((score + titled) * classify.authority_boost(F.col("authority_level"))).alias("score")).where("score > 0")


def _query_tokens(query: str) -> list[str]:
    import re

    return [t for t in re.findall(r"[A-Za-z0-9][A-Za-z0-9()./-]*", query) if len(t) > 1]


def top(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows with their rank; the sort is a top-n, no full one."""
    return rows.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def _count(tokens: Column, word: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t == F.lit(word)))


def exact_citation(chunks: DataFrame, acts: list[tuple[str, int]], provisions: list[str], cases: list[str], limit: int = 50) -> DataFrame:
    """Chunks that cite the acts, provisions and cases, ranked by authority, year, page and place; score 1000 - rank.

    Alternatives of one kind are joined by or, kinds by and.  Without an act, a
    provision must follow a word like section or article.
    """
    text = F.concat_ws(" ", "title", "text")
    groups = []
    if acts:
        groups.append([text.rlike(rf"(?i)\bno\.?\s*{n}\s+of\s+{y}\b") for n, y in acts])
    if provisions:
        head = "" if acts else r"(?:sections?|sec\.?|s\.|articles?|art\.?)\s+"
        groups.append([text.rlike(rf"(?i)\b{head}{_tolerant(p)}(?![\p{{Alnum}}])") for p in provisions])
    if cases:
        groups.append([text.ilike(f"%{c}%") for c in cases])
    if not groups:
        return chunks.where(F.lit(False)).withColumns({"rank": F.lit(1), "score": F.lit(0.0)})
    test = reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, g) for g in groups])
    order = (F.col("authority_level").asc(), F.col("year").desc_nulls_last(), F.col("page_start").asc_nulls_last(), F.col("chunk_index").asc())
    found = top(chunks.where(test), limit, *order)
    return found.withColumn("score", 1000.0 - F.col("rank"))


def _tolerant(provision: str) -> str:
    """A provision with blanks allowed around its parts."""
    import re

    return r"\s*".join(re.escape(p) for p in re.findall(r"[0-9]+|[A-Za-z]+|[()]", provision))

