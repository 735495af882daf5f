"""Queries over text: scalars, quality, summaries, search and ranking."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvex.functions import classify, text as tx
from corvex.operators import fusion, search, search_index, two_stage, vectors
from corvex.operators.relational import first_per_key
from corvex.sources import shared
from corvex.sources.tables import CORPUS_SQL, corpus, table

QUERY = "the thing that with and from"
YEAR = 2025


def index_of(spark: SparkSession, folder: str) -> search_index.Index:
    """The search index of the documents, built when they have changed."""
    return search_index.of_table(spark, f"{folder}/documents.parquet", corpus(spark, folder))


def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The best 20 documents for a benchmark-like query, from the index."""
    found = search_index.bm25(index_of(spark, folder), QUERY, 20, digits=6)
    return search.top(found, 20, F.round("score", 6).desc(), F.col("document_id")).select("document_id", F.round("score", 6).alias("score"), "rank")


BM25_SQL = f"""WITH {CORPUS_SQL},
t AS (SELECT document_id, title, authority_level, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9()./-]*'), lambda x: lower(x)), lambda x: length(x) > 1) AS w FROM corpus),
q AS (SELECT unnest(['the', 'thing', 'that', 'with', 'and', 'from']) AS term),
s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t),
tf AS (SELECT document_id, title, authority_level, len(w) AS dl, term, len(list_filter(w, lambda x: x = term)) AS tf FROM t, q),
df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY term),
sc AS (SELECT document_id, any_value(authority_level) AS a,
         sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) + CASE WHEN contains(lower(title), term) THEN 0.4 ELSE 0 END) AS x
       FROM tf JOIN df USING (term), s GROUP BY document_id),
r AS (SELECT document_id, round(x * [1.35, 1.30, 1.25, 1.15, 1.05, 1.00, 0.95, 0.90, 0.80][a], 6) AS score FROM sc WHERE x > 0)
SELECT document_id, score, (row_number() OVER (ORDER BY score DESC, document_id))::INTEGER AS rank FROM r ORDER BY score DESC, document_id LIMIT 20"""


def keyword_search(spark: SparkSession, folder: str) -> DataFrame:
    """The best 15 documents by words, phrase and near words, from the index."""
    found = search_index.keyword_score(index_of(spark, folder), "thing that")
    return search.top(found, 15, F.round("score", 6).desc(), F.col("document_id")).select("document_id", F.round("score", 6).alias("score"))


KEYWORD_SQL = f"""WITH {CORPUS_SQL},
t AS (SELECT document_id, lower(title) AS title, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9()./-]*'), lambda x: lower(x)), lambda x: length(x) > 1) AS w FROM corpus),
p AS (SELECT *, list_contains(w, 'thing') AS h1, list_contains(w, 'that') AS h2, contains(title, 'thing') AS t1, contains(title, 'that') AS t2 FROM t),
r AS (SELECT document_id, round(
   CASE WHEN (h1 OR t1) AND (h2 OR t2) THEN 3.0 * (CASE WHEN t1 THEN 3 WHEN h1 THEN 1 ELSE 0 END + CASE WHEN t2 THEN 3 WHEN h2 THEN 1 ELSE 0 END) ELSE 0 END
   + CASE WHEN len(list_filter(range(1, len(w)), lambda i: w[i] = 'thing' AND w[i + 1] = 'that')) > 0 OR contains(title, 'thing that') THEN 5 ELSE 0 END
   + CASE WHEN len(list_filter(w, lambda x: starts_with(x, 'th') AND levenshtein(x, 'thing') <= 1)) > 0 THEN 0.8 ELSE 0 END
   + CASE WHEN len(list_filter(w, lambda x: starts_with(x, 'th') AND levenshtein(x, 'that') <= 1)) > 0 THEN 0.8 ELSE 0 END, 6)::DOUBLE AS score FROM p)
SELECT document_id, score FROM r WHERE score > 0 ORDER BY score DESC, document_id LIMIT 15"""


def token_estimate_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Token estimates of normalised texts by language."""
    rows = corpus(spark, folder).select("language", tx.estimate_tokens(F.col("text")).alias("n"), F.length(tx.normalize_text(F.col("text"))).alias("chars"))
    return rows.groupBy("language").agg(F.count("*").alias("n_docs"), F.sum("n").alias("tokens"), F.max("n").alias("most_tokens"), F.sum("chars").alias("chars"))


TOKEN_SQL = r"""WITH d AS (SELECT lang AS language, greatest(1, len(regexp_extract_all(text, '\S+')) * 4 // 3) AS n,
  length(array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', ' ', 'g'), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))) AS chars FROM documents)
SELECT language, count(*) AS n_docs, sum(n)::BIGINT AS tokens, max(n)::INTEGER AS most_tokens, sum(chars)::BIGINT AS chars FROM d GROUP BY language"""


def extraction_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality decision of each document, read as OCR for every fourth."""
    docs = corpus(spark, folder)
    method = F.when(F.col("doc_id") % 4 == 0, "ocr").otherwise("text_layer")
    confidence = F.when(F.col("doc_id") % 4 == 0, F.when(F.col("doc_id") % 8 == 0, F.lit(None)).otherwise(0.5 + (F.col("doc_id") % 50) / 100))
    parts = tx.extraction_quality(F.col("text"), F.col("method"), F.col("confidence"))
    rows = docs.select("doc_id", "text", method.alias("method"), confidence.cast("double").alias("confidence")).select("doc_id", *[c.alias(k) for k, c in parts.items()])
    return rows.withColumn("quality_flags", F.array_join("quality_flags", "|"))


QUALITY_SQL = r"""WITH d AS (SELECT doc_id, trim(text) AS t, doc_id % 4 = 0 AS ocr, CASE WHEN doc_id % 8 = 4 THEN 0.5 + (doc_id % 50) / 100.0 END::DOUBLE AS c FROM documents),
b AS (SELECT *, length(t) AS n, CASE WHEN length(t) = 0 THEN 0 ELSE length(regexp_replace(t, '[^\p{L}\p{N}]', '', 'g')) / length(t) END AS ratio,
  CASE WHEN c IS NULL THEN 'unknown' WHEN c >= 0.95 THEN 'high' WHEN c >= 0.85 THEN 'medium' WHEN c >= 0.70 THEN 'low' ELSE 'unusable' END AS band FROM d),
f AS (SELECT *, list_filter([CASE WHEN n = 0 THEN 'empty_text' END, CASE WHEN n > 0 AND ratio < 0.35 THEN 'low_alphanumeric_ratio' END, CASE WHEN ocr AND band = 'low' THEN 'low_confidence_ocr' END,
  CASE WHEN contains(t, chr(65533)) THEN 'replacement_characters' END, CASE WHEN ocr AND band = 'unknown' THEN 'unknown_ocr_confidence' END, CASE WHEN ocr AND band = 'unusable' THEN 'unusable_ocr' END, CASE WHEN n < 80 THEN 'very_short_text' END], lambda x: x IS NOT NULL) AS flags FROM b),
g AS (SELECT *, NOT list_has_any(flags, ['empty_text', 'unusable_ocr', 'low_confidence_ocr', 'low_alphanumeric_ratio']) AS ok FROM f)
SELECT doc_id, array_to_string(flags, '|') AS quality_flags, round(greatest(0.0, least(1.0, least(1.0, n / 500) * 0.25 + ratio * 0.25 + coalesce(c, 0.75) * 0.5 - 0.15 * len(flags))), 4)::DOUBLE AS quality_score, band AS confidence_band, ok AS legal_answer_eligible,
  NOT ok OR list_has_any(flags, ['very_short_text', 'replacement_characters', 'unknown_ocr_confidence']) AS requires_manual_review FROM g"""


def doc_quality_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Union of flags, eligible and blocked counts and mean score by source."""
    rows = extraction_quality(spark, folder).join(corpus(spark, folder).select("doc_id", "source_id"), "doc_id")
    flags = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("quality_flags", r"\|")))))
    out = rows.groupBy("source_id").agg(F.count("*").alias("n"), F.count_if("legal_answer_eligible").alias("eligible"), F.count_if(~F.col("legal_answer_eligible")).alias("blocked"), F.round(F.avg("quality_score"), 4).alias("mean_score"), F.array_join(F.filter(flags, lambda x: x != ""), "|").alias("flags"))
    return out


ROLLUP_SQL = f"""WITH q AS ({QUALITY_SQL})
SELECT source AS source_id, count(*) AS n, count(*) FILTER (legal_answer_eligible) AS eligible, count(*) FILTER (NOT legal_answer_eligible) AS blocked, round(avg(quality_score), 4) AS mean_score,
  array_to_string(list_sort(list_filter(list_distinct(flatten(list(string_split(quality_flags, '|')))), lambda x: x <> '')), '|') AS flags
FROM q JOIN documents USING (doc_id) GROUP BY source"""


def spread_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Deterministic summaries with their ids, hashes and ratios."""
    rows = corpus(spark, folder).where("length(text) > 0").select("document_id", F.length("text").alias("source_chars"), tx.spread_summary(F.col("text"), least=300, most=3000).alias("s"), "text")
    return rows.select("document_id", F.concat(F.lit("docsum_"), F.md5(F.concat("document_id", F.lit(":summary")))).alias("summary_id"), "source_chars", F.length("s").alias("summary_chars"), F.sha2("s", 256).alias("summary_hash"), F.round(F.least(F.lit(1.0), F.length("s") / F.col("source_chars")), 6).alias("ratio"))


SUMMARY_SQL = """WITH d AS (SELECT 'doc_' || doc_id AS document_id, text, length(text) AS n, least(length(text), greatest(300, least(3000, ceil(length(text) * 0.10)::INTEGER)))::INTEGER AS b FROM documents WHERE length(text) > 0),
p AS (SELECT *, greatest(1, floor(b / 3.0))::INTEGER AS third FROM d),
s AS (SELECT document_id, n, CASE WHEN b + 18 >= n THEN text ELSE substr(text, 1, third) || chr(10) || chr(10) || '[...]' || chr(10) || chr(10) || substr(text, greatest(1, floor(n / 2.0 - b / 6.0))::INTEGER, third) || chr(10) || chr(10) || '[...]' || chr(10) || chr(10) || substr(text, (n - greatest(1, b - 2 * third) + 1)::INTEGER, greatest(1, b - 2 * third)::INTEGER) END AS s FROM p)
SELECT document_id, 'docsum_' || md5(document_id || ':summary') AS summary_id, n::INTEGER AS source_chars, length(s)::INTEGER AS summary_chars, sha256(s) AS summary_hash, round(least(1.0, length(s) / n), 6) AS ratio FROM s"""


def trigram_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Similarity of part names to a phrase, the best 30."""
    rows = table(spark, folder, "part").select("p_partkey", F.round(tx.similarity(tx.trigrams(F.col("p_name")), tx.trigrams(F.lit("steel blue part"))), 6).alias("similarity"))
    return rows.orderBy(F.col("similarity").desc(), "p_partkey").limit(30)


TRIGRAM_SQL = r"""WITH w AS (SELECT p_partkey, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(p_name), '[^\p{L}\p{N}]+'), lambda x: x <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i::INTEGER, 3))))) AS a,
 (SELECT list_distinct(flatten(list_transform(['steel', 'blue', 'part'], lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i::INTEGER, 3)))))) AS b FROM part)
SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM w ORDER BY similarity DESC, p_partkey LIMIT 30"""


def query_parsing(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens, terms and phrases of the benchmark's texts."""
    rows = table(spark, folder, "benchmark")
    return rows.select("item_id", F.array_join(tx.query_tokens(F.col("text")), " ").alias("tokens"), F.array_join(tx.terms(F.col("text")), " ").alias("terms"), F.size(tx.bm25_tokens(F.col("text"))).alias("n_bm25"), F.array_join(tx.important_phrases(F.col("text")), "|").alias("phrases"), tx.excerpt(F.col("text"), ["thing", "inly"], 40).alias("excerpt"), tx.extractive_summary(F.col("text"), ["thing", "inly"], 100).alias("summary"))



PARSING_SQL = r"""WITH b AS (SELECT item_id, text, regexp_extract_all(lower(text), '[a-z][a-z0-9]{2,}') AS t, regexp_extract_all(lower(text), '[a-z][a-z_]{2,}') AS u,
   list_filter(list_transform(list_concat(regexp_extract_all(text, '"([^"]{4,80})"', 1), regexp_extract_all(text, '\b((?:[A-Z][A-Za-z]+(?:\s+|$)){2,6})', 1)), lambda x: lower(trim(regexp_replace(x, '\s+', ' ', 'g')))), lambda x: length(x) >= 5) AS p,
   trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM benchmark),
a AS (SELECT *, least(nullif(instr(lower(f), 'thing'), 0), nullif(instr(lower(f), 'inly'), 0)) AS pos, length(f) AS n FROM b),
c AS (SELECT *, list_filter(t, lambda x: x NOT IN ('and', 'the', 'for', 'with', 'from', 'that', 'this', 'into', 'under', 'about', 'after', 'before', 'between', 'where', 'which', 'says', 'wants', 'case', 'legal', 'sri', 'lanka', 'ceylon', 'act', 'acts', 'law', 'laws', 'section', 'article', 'ordinance')) AS v FROM a),
e AS (SELECT *, CASE WHEN pos IS NOT NULL THEN CASE WHEN pos - 40 > 1 THEN '...' ELSE '' END || trim(substr(f, greatest(1, pos - 40)::INTEGER, (least(n, pos + 39) - greatest(1, pos - 40) + 1)::INTEGER)) || CASE WHEN pos + 39 < n THEN '...' ELSE '' END END AS near,
   CASE WHEN pos IS NOT NULL THEN CASE WHEN pos - 120 > 1 THEN '...' ELSE '' END || trim(substr(f, greatest(1, pos - 120)::INTEGER, (least(n, pos + 119) - greatest(1, pos - 120) + 1)::INTEGER)) || CASE WHEN pos + 119 < n THEN '...' ELSE '' END END AS wide FROM c)
SELECT item_id, array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i), ' ') AS tokens, array_to_string(list_filter(u, lambda x, i: list_position(u, x) = i), ' ') AS terms,
  len(list_filter(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9()./-]*'), lambda x: length(x) > 1))::INTEGER AS n_bm25,
  array_to_string(list_slice(list_filter(p, lambda x, i: list_position(p, x) = i), 1, 16), '|') AS phrases,
  coalesce(near, trim(substr(f, 1, 80))) AS excerpt, CASE WHEN n <= 100 THEN f ELSE coalesce(wide, rtrim(substr(f, 1, 100))) END AS summary FROM e"""


def citation_projection(spark: SparkSession, folder: str) -> DataFrame:
    """Authority, boost, recency, citation, ids and slugs of each document."""
    docs = corpus(spark, folder)
    level = classify.authority_level(F.col("document_type"), F.col("source_id"))
    number = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string"))
    return docs.select("document_id", level.alias("authority"), classify.authority_boost(level).cast("double").alias("boost"), classify.authority_score(level).cast("double").alias("authority_score"), classify.recency_score(F.col("year"), YEAR).cast("double").alias("recency"), classify.citation(F.col("title"), number, F.col("year"), F.lit(1), (F.col("doc_id") % 3 + 1).cast("int")).alias("citation"), tx.stable_id(F.col("document_id"), F.col("source_id")).alias("stable_id"), classify.slug(F.col("title"), 30).alias("slug"), classify.last_year(F.concat_ws(" ", "title", "year")).alias("last_year"))


CITATION_SQL = f"""WITH {CORPUS_SQL}, a AS (SELECT *, CASE document_type WHEN 'Constitution' THEN 1 WHEN 'Act' THEN 2 WHEN 'Bill' THEN 8 WHEN 'Supreme Court Judgment' THEN 3 WHEN 'Court of Appeal Judgment' THEN 4 WHEN 'Law Report' THEN 4 WHEN 'Gazette' THEN 5 ELSE 8 END AS l FROM corpus)
SELECT document_id, l::INTEGER AS authority, [1.35, 1.30, 1.25, 1.15, 1.05, 1.00, 0.95, 0.90, 0.80][l]::DOUBLE AS boost, (CASE WHEN l <= 1 THEN 1.0 WHEN l <= 3 THEN 0.9 WHEN l <= 5 THEN 0.72 WHEN l <= 7 THEN 0.55 ELSE 0.35 END)::DOUBLE AS authority_score,
  (CASE WHEN {YEAR} - year <= 5 THEN 1.0 WHEN {YEAR} - year <= 20 THEN 0.85 WHEN {YEAR} - year <= 50 THEN 0.68 ELSE 0.5 END)::DOUBLE AS recency,
  concat_ws(', ', title, CASE WHEN doc_id % 2 = 0 THEN 'No. ' || doc_id || ' of ' || year ELSE year::VARCHAR END, CASE WHEN doc_id % 3 > 0 THEN 'pp. 1-' || (doc_id % 3 + 1) ELSE 'p. 1' END) AS citation,
  substr(sha1(document_id || '::' || source_id), 1, 16) AS stable_id, substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 30) AS slug, year AS last_year FROM a"""


def policy_screen(spark: SparkSession, folder: str) -> DataFrame:
    """Prohibited patterns in turns, into which sample phrases are put by turn number."""
    phrases = ["you must file", "invent a citation", "omit the adverse authority", "alter the record", "skip lawyer review", "ignore previous instructions", "court will certainly", ""]
    turns = table(spark, folder, "conversations").withColumn("t", F.concat_ws(" ", "text", F.get(F.array(*map(F.lit, phrases)), ((F.col("conv_id") + F.col("turn")) % 8).cast("int"))))
    return turns.select("conv_id", "turn", F.array_join(classify.policy_hits(F.col("t")), "|").alias("codes"), classify.policy_risk(F.col("t")).alias("risk"))


_HITS = ", ".join(f"CASE WHEN regexp_matches(t, '(?is){p}') THEN '{c}' END" for c, p, _ in classify.PROHIBITED)
_CRITICAL = " OR ".join(f"regexp_matches(t, '(?is){p}')" for _, p, r in classify.PROHIBITED if r == "critical")
_HIGH = " OR ".join(f"regexp_matches(t, '(?is){p}')" for _, p, r in classify.PROHIBITED if r == "high")
POLICY_SQL = f"""WITH c AS (SELECT conv_id, turn, text || ' ' || ['you must file', 'invent a citation', 'omit the adverse authority', 'alter the record', 'skip lawyer review', 'ignore previous instructions', 'court will certainly', ''][((conv_id + turn) % 8 + 1)::INTEGER] AS t FROM conversations)
SELECT conv_id, turn, array_to_string(list_filter([{_HITS}], lambda x: x IS NOT NULL), '|') AS codes, CASE WHEN {_CRITICAL} THEN 'critical' WHEN {_HIGH} THEN 'high' ELSE 'low' END AS risk FROM c"""


def citation_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Acts, provisions (whole lists of them) and cases in texts made from customers."""
    k = F.col("c_custkey")
    made = F.concat(F.lit("Find Under sections "), k % 90 + 1, F.lit(" (A), 7b and "), k % 13 + 1, F.lit(" of Act No. "), k % 50 + 1, F.lit("a of "), 1950 + k % 70, F.lit(", alpha "), k % 5, F.lit("  Ltd v. Beta; and article "), k % 9 + 1, F.lit(" under no 0"), k % 3, F.lit(" of 2001. see Sec. "), k % 4, F.lit("; SEC. "), k % 4)
    rows = table(spark, folder, "customer").select("c_custkey", classify.citation_signals(made).alias("s"))
    return rows.select("c_custkey", F.array_join("s.acts", "|").alias("acts"), F.array_join("s.provisions", "|").alias("provisions"), F.array_join("s.cases", "|").alias("cases"))


CITED_SQL = """WITH k AS (SELECT c_custkey AS k FROM customer)
SELECT k AS c_custkey, (k % 50 + 1) || 'A/' || (1950 + k % 70) || '|0' || (k % 3) || '/2001' AS acts,
  'sections ' || (k % 90 + 1) || '(a)|sections 7b' || '|sections ' || (k % 13 + 1) || '|article ' || (k % 9 + 1) || '|sec ' || (k % 4) AS provisions, 'alpha ' || (k % 5) || ' Ltd v Beta' AS cases FROM k"""


def _lists(spark: SparkSession, folder: str) -> DataFrame:
    """Three ranked lists of documents, by authority and other keys, as search results."""
    docs = corpus(spark, folder).select(F.col("document_id").alias("chunk_id"), "document_id", "doc_id", "title", "authority_level", "year", F.col("text"), (F.col("doc_id") % 11 == 0).alias("exact"))
    out = None
    for i, (name, order) in enumerate((("keyword", F.col("doc_id") * 7919 % 1009), ("vector", F.col("doc_id") * 104729 % 997), ("exact", F.col("doc_id") * 31 % 499))):
        part = search.top(docs.withColumn("o", order), 60, F.col("o"), F.col("doc_id")).drop("o")
        part = part.select(F.lit(i).alias("result_set"), "rank", "chunk_id", "document_id", "authority_level", "year", "title", "exact", (1000.0 - F.col("rank") - 300 * i).alias("score"), F.lit(name).alias("retriever"), tx.estimate_tokens(F.col("text")).cast("long").alias("tokens"))
        out = part if out is None else out.unionByName(part)
    return out


_LISTS_SQL = f"""{CORPUS_SQL},
o AS (SELECT *, doc_id * 7919 % 1009 AS o0, doc_id * 104729 % 997 AS o1, doc_id * 31 % 499 AS o2 FROM corpus),
l AS (SELECT 0 AS result_set, 'keyword' AS retriever, row_number() OVER (ORDER BY o0, doc_id) AS rank, o.* FROM o UNION ALL SELECT 1, 'vector', row_number() OVER (ORDER BY o1, doc_id), o.* FROM o UNION ALL SELECT 2, 'exact', row_number() OVER (ORDER BY o2, doc_id), o.* FROM o),
h AS (SELECT *, doc_id % 11 = 0 AS exact FROM l WHERE rank <= 60),
f AS (SELECT document_id, any_value(doc_id) AS doc_id, sum(1.0 / (60 + rank) + CASE WHEN exact THEN 0.10 / rank ELSE 0 END) AS points, min(result_set * 1000 + rank) AS first_seen, any_value(authority_level) AS a, any_value(exact) AS exact, array_to_string(list_sort(list_distinct(list(retriever || ' rank ' || rank))), '; ') AS evidence, any_value(greatest(1, len(regexp_extract_all(text, '\\S+')) * 4 // 3)) AS tokens FROM h GROUP BY document_id),
s AS (SELECT *, points * [1.35, 1.30, 1.25, 1.15, 1.05, 1.00, 0.95, 0.90, 0.80][a] AS score FROM f)"""


def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """Three ranked lists fused."""
    fused = fusion.reciprocal_rank_fusion(_lists(spark, folder))
    return fused.select("chunk_id", F.round("score", 8).alias("score"), F.array_join("retrieval_evidence", "; ").alias("evidence"))


RRF_SQL = f"WITH {_LISTS_SQL} SELECT document_id AS chunk_id, round(score, 8)::DOUBLE AS score, evidence FROM s"


def legal_quality_rerank(spark: SparkSession, folder: str) -> DataFrame:
    """Fused hits under quality factors, the best 40."""
    flags = F.array_compact(F.array(F.when(F.col("doc") % 2 == 0, "low_confidence_ocr"), F.when(F.col("doc") % 3 == 0, "missing_page_anchor"), F.when(F.col("doc") % 5 == 0, "current_consolidated_law"), F.when(F.col("doc") % 7 == 0, "machine_translation_unreviewed")))
    fused = fusion.reciprocal_rank_fusion(_lists(spark, folder)).withColumn("doc", F.substring("chunk_id", 5, 20).cast("long"))
    rows = fused.withColumn("m", fusion.quality_multiplier(F.col("authority_level"), flags, F.col("exact")))
    rows = rows.select("chunk_id", F.round("m", 6).alias("multiplier"), F.round(F.col("score") * F.col("m"), 8).alias("score"))
    return rows.orderBy(F.col("score").desc(), "chunk_id").limit(40)


RERANK_SQL = f"""WITH {_LISTS_SQL}, m AS (SELECT document_id, score, [1.35, 1.30, 1.25, 1.15, 1.05, 1.00, 0.95, 0.90, 0.80][a] * CASE WHEN doc_id % 2 = 0 THEN 0.70 ELSE 1 END * CASE WHEN doc_id % 3 = 0 THEN 0.80 ELSE 1 END * CASE WHEN doc_id % 7 = 0 THEN 0.75 ELSE 1 END * CASE WHEN doc_id % 5 = 0 THEN 1.10 ELSE 1 END * CASE WHEN exact THEN 1.25 ELSE 1 END AS m FROM s)
SELECT document_id AS chunk_id, round(m, 6)::DOUBLE AS multiplier, round(score * m, 8)::DOUBLE AS score FROM m ORDER BY score DESC, chunk_id LIMIT 40"""


def pack_select(spark: SparkSession, folder: str) -> DataFrame:
    """A pack of at most 12 items and 4000 tokens from the fused list."""
    fused = fusion.reciprocal_rank_fusion(_lists(spark, folder)).withColumn("score", F.round("score", 8))
    ranked = search.top(fused, 1000, F.col("score").desc(), F.col("first_seen"), F.col("chunk_id")).withColumnRenamed("rank", "seq")
    items = fusion.select_pack(ranked.withColumn("pack_id", F.lit("pack_1")), 12, 4000)
    return items.select("pack_item_id", "chunk_id", "tokens", "note")


SELECT_SQL = f"""WITH RECURSIVE {_LISTS_SQL}, r AS (SELECT document_id AS chunk_id, tokens::BIGINT AS tokens, row_number() OVER (ORDER BY round(score, 8) DESC, first_seen, document_id) AS seq FROM s),
p AS (SELECT 0::BIGINT AS seq, 0::BIGINT AS used, 0 AS n, NULL::VARCHAR AS chunk_id, 0::BIGINT AS tokens, false AS taken
  UNION ALL SELECT r.seq, p.used + CASE WHEN p.n < 12 AND (p.n = 0 OR p.used + r.tokens <= 4000) THEN r.tokens ELSE 0 END, p.n + (p.n < 12 AND (p.n = 0 OR p.used + r.tokens <= 4000))::INT, r.chunk_id, r.tokens, p.n < 12 AND (p.n = 0 OR p.used + r.tokens <= 4000) FROM p JOIN r ON r.seq = p.seq + 1)
SELECT 'pack_1_item_' || lpad(n::VARCHAR, 3, '0') AS pack_item_id, chunk_id, tokens, 'new source document' AS note FROM p WHERE taken"""


def intent_features(spark: SparkSession, folder: str) -> DataFrame:
    """Five intents of a query against all documents' features."""
    queries = spark.createDataFrame([(1, "the   thing that")], "query_id int, query string")
    hits = corpus(spark, folder).select("document_id", "title", F.concat_ws(", ", "title", "year").alias("citation"), "text", "authority_level", "year", (F.col("doc_id") % 11 == 0).alias("exact"))
    # Terms are found once for a text and once for an intent, before they meet.
    hits = fusion.with_terms(hits).drop("title", "citation", "text")
    both = hits.crossJoin(F.broadcast(fusion.with_signals(fusion.expand(spark, queries))))  # five rows
    rows = fusion.tag(fusion.intent_features(both.withColumns({"score": F.lit(1.0), "retriever": F.lit("keyword")}), YEAR))
    return rows.select("document_id", "retriever", *[F.round(c, 6).cast("double").alias(c) for c in ("authority_score", "recency_score", "exactness_score", "adverse_relevance_score", "intent_score_multiplier")])


_INTENT_ROWS = ", ".join(f"('{k}', '{' '.join(v)}')" for k, v in fusion.INTENTS.items())
_SQL_TERMS = lambda x: f"list_distinct(regexp_extract_all(lower({x}), '[a-z][a-z_]{{2,}}'))"
INTENT_SQL = f"""WITH {CORPUS_SQL}, i AS (SELECT * FROM (VALUES {_INTENT_ROWS}) v(intent, words)),
d AS (SELECT *, title || ', ' || year AS citation, doc_id % 11 = 0 AS exact FROM corpus),
t AS (SELECT document_id, intent, authority_level AS a, year, exact, {_SQL_TERMS("'the thing that ' || words")} AS q, {_SQL_TERMS("title")} AS tt, {_SQL_TERMS("citation")} AS ct, {_SQL_TERMS("substr(text, 1, 1000)")} AS xt, {_SQL_TERMS("title || ' ' || citation || ' ' || substr(text, 1, 2000)")} AS st, list_distinct(list_concat({list(fusion.ADVERSE_TERMS)}, {_SQL_TERMS("words")})) AS sig FROM d, i),
u AS (SELECT document_id, intent, CASE WHEN a <= 1 THEN 1.0 WHEN a <= 3 THEN 0.9 WHEN a <= 5 THEN 0.72 WHEN a <= 7 THEN 0.55 ELSE 0.35 END AS au, CASE WHEN {YEAR} - year <= 5 THEN 1.0 WHEN {YEAR} - year <= 20 THEN 0.85 ELSE 0.68 END AS re,
  CASE WHEN exact THEN 1.0 ELSE least(1.0, 0.45 * len(list_intersect(q, tt)) / len(q) + 0.45 * len(list_intersect(q, ct)) / len(q) + 0.10 * len(list_intersect(q, xt)) / len(q)) END AS ex,
  CASE WHEN len(st) = 0 THEN 0 ELSE least(1.0, len(list_intersect(st, sig)) / 6 + CASE WHEN intent <> 'supportive' THEN 0.2 ELSE 0 END) END AS ad,
  least(1.0, len(list_intersect(st, {list(fusion.SUPPORTIVE_TERMS)})) / 5) AS su FROM t)
SELECT document_id, 'keyword:' || intent AS retriever, au::DOUBLE AS authority_score, re::DOUBLE AS recency_score, round(ex, 6)::DOUBLE AS exactness_score, round(ad, 6)::DOUBLE AS adverse_relevance_score,
  round(0.85 + 0.25 * au + 0.15 * re + 0.25 * ex + 0.25 * CASE WHEN intent = 'supportive' THEN su ELSE ad END + CASE WHEN intent <> 'supportive' THEN 0.08 ELSE 0 END, 6)::DOUBLE AS intent_score_multiplier FROM u"""


RANKED_QUERY = 'thing les die que "thing the" Bail'


def _tokens(text):  # noqa: ANN001, ANN202
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def stage1_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """First stage: ranks of the spread summary and the title, title similarity and type bonus, the best 50; from the index."""
    rows = search_index.first_stage(index_of(spark, folder), RANKED_QUERY, two_stage.query_prefixes(RANKED_QUERY))
    bonus = F.when(F.col("document_type").isin("Constitution", "Act"), 0.35).when(F.col("document_type").contains("Judgment"), 0.25).when(F.col("document_type").contains("Gazette"), 0.15).otherwise(0.0)
    rows = rows.select("document_id", F.round(F.col("summary_rank") + 3 * F.col("title_rank") + 1.5 * F.col("similarity") + bonus, 6).cast("double").alias("score"))
    return search.top(rows, 50, F.col("score").desc(), F.col("document_id"))


def title_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Titles with a trigram similarity of at least 0.15 to a query, from the trigram index."""
    rows = search_index.similar_titles(index_of(spark, folder), RANKED_QUERY, 0.15)
    return rows.select(F.col("key").alias("document_id"), F.round("similarity", 6).alias("similarity"))


def near_words(spark: SparkSession, folder: str) -> DataFrame:
    """Terms within a few edits of each of three words, with their document frequency, from the term dictionary."""
    index = index_of(spark, folder)
    out = None
    for word in ("thing", "that", "eauaile"):
        part = search_index.near_terms(index, word).join(index.terms.where("field = 'text'"), "term").select(F.lit(word).alias("word"), "term", "df", "cf")
        out = part if out is None else out.unionByName(part)
    return out


def sql_summary(t: str) -> str:
    """SQL of a text's head, middle and tail within a tenth of it, 1200 to 12000 characters."""
    n, gap = f"length({t})", "chr(10) || chr(10) || '[...]' || chr(10) || chr(10)"
    b = f"least({n}, greatest(1200, least(12000, ceil({n} * 0.10::DOUBLE)::INTEGER)))::INTEGER"
    third, rest = f"greatest(1, floor({b} / 3.0))::INTEGER", f"greatest(1, {b} - 2 * greatest(1, floor({b} / 3.0))::INTEGER)::INTEGER"
    return f"CASE WHEN {b} + 18 >= {n} THEN {t} ELSE substr({t}, 1, {third}) || {gap} || substr({t}, greatest(1, floor({n} / 2.0 - {b} / 6.0))::INTEGER, {third}) || {gap} || substr({t}, ({n} - {rest} + 1)::INTEGER, {rest}) END"


_TOK = lambda x: f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_HIT = lambda x: f"0.1 * len(list_filter({_TOK(x)}, lambda x: starts_with(x, 'thing') OR starts_with(x, 'les') OR starts_with(x, 'die') OR starts_with(x, 'que') OR starts_with(x, 'bail')))"
_RANK = lambda x: f"({_HIT(x)} / ({_HIT(x)} + 1))"
_TRI = lambda x: f"list_distinct(flatten(list_transform({x}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i::INTEGER, 3)))))"
_ASKED = "['thing', 'les', 'die', 'que', 'thing', 'the', 'bail']"
STAGE1_SQL = f"""WITH {CORPUS_SQL}, a AS (SELECT document_id, document_type, {_HIT(sql_summary("text"))} AS s, {_HIT("title")} AS t, {_TRI(_TOK("title"))} AS g, {_TRI(_ASKED)} AS h FROM corpus),
b AS (SELECT document_id, document_type, s / (s + 1) AS s, t / (t + 1) AS t, len(list_intersect(g, h)) / len(list_distinct(list_concat(g, h))) AS sim FROM a),
c AS (SELECT document_id, round(s + 3 * t + 1.5 * sim + CASE WHEN document_type IN ('Constitution', 'Act') THEN 0.35 WHEN contains(document_type, 'Judgment') THEN 0.25 WHEN contains(document_type, 'Gazette') THEN 0.15 ELSE 0 END, 6)::DOUBLE AS score FROM b WHERE s > 0 OR t > 0 OR sim >= 0.08)
SELECT document_id, score, (row_number() OVER (ORDER BY score DESC, document_id))::INTEGER AS rank FROM c ORDER BY score DESC, document_id LIMIT 50"""
TITLES_SQL = f"""WITH {CORPUS_SQL}, a AS (SELECT document_id, {_TRI(_TOK("title"))} AS g, {_TRI(_ASKED)} AS h FROM corpus), b AS (SELECT document_id, len(list_intersect(g, h)) / len(list_distinct(list_concat(g, h))) AS s FROM a)
SELECT document_id, round(s, 6) AS similarity FROM b WHERE s >= 0.15"""
NEAR_SQL = r"""WITH t AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9()./-]*'), lambda x: lower(x)), lambda x: length(x) > 1)) AS term FROM documents),
c AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY 1), w AS (SELECT * FROM (VALUES ('thing', 1), ('that', 1), ('eauaile', 2)) AS w(word, most))
SELECT word, term, df, cf FROM c JOIN w ON starts_with(term, word[1:2]) AND levenshtein(term, word) <= most"""


def stage2_blend(spark: SparkSession, folder: str) -> DataFrame:
    """Second stage over the first one's documents: all six parts, source quality and title hint, scaled to 100.

    Documents ⋈ first stage ⋈ best chunks; each line of a text is a chunk.
    Origin, review and flags of the texts are made from the document's number.
    """
    prefixes, phrases, n = two_stage.query_prefixes(RANKED_QUERY), ["thing the"], F.col("doc_id")
    first = stage1_ranking(spark, folder).select("document_id", F.col("score").alias("stage1"))
    docs = corpus(spark, folder).join(F.broadcast(first), "document_id")  # 50 rows
    docs = docs.withColumn("title", F.concat(F.when(n % 5 == 0, "Bail ").otherwise(""), "title"))
    lines = docs.select("document_id", F.explode(F.split("text", "\n")).alias("chunk"))
    similar = tx.similarity(tx.trigrams(F.substring("chunk", 1, 5000)), tx.trigrams(F.lit(RANKED_QUERY)))
    chunks = lines.select("document_id", tx.or_rank(_tokens(F.col("chunk")), prefixes).alias("r"), similar.alias("sim")).where("r > 0 or sim >= 0.03")
    best = chunks.groupBy("document_id").agg(F.max(F.col("r") + F.col("sim")).alias("chunk"))
    rows = two_stage.full_text_metrics(docs, RANKED_QUERY, phrases).join(best, "document_id", "left")
    title = tx.or_rank(_tokens(F.col("title")), prefixes) + tx.similarity(tx.trigrams(F.col("title")), tx.trigrams(F.lit(RANKED_QUERY)))
    rows = rows.withColumns({"title_score": title, "chunk": F.coalesce("chunk", F.lit(0.0)), "query_id": F.lit("q")})
    parts = {"stage1": "stage1", "full_text": "full_text_rank", "chunk": "chunk", "title": "title_score"}
    rows = rows.withColumns({f"p_{k}": fusion.normalise_max(c, "query_id") for k, c in parts.items()})
    origin, review = F.when(n % 5 == 1, "translated").otherwise("original"), F.when(n % 7 == 0, "pending").otherwise("reviewed")
    flags = F.array_compact(F.array(F.when(n % 3 == 0, "low_confidence_ocr"), F.when(n % 11 == 0, "machine_translation_unreviewed")))
    factor = two_stage.source_quality(F.col("document_type"), origin, review, flags) * two_stage.hint_multiplier(F.col("title"), two_stage.title_hints(RANKED_QUERY))
    coverage, phrase = F.col("term_hits") / len(prefixes), F.least(F.lit(1.0), F.col("phrase_hits") / len(phrases))
    raw = fusion.stage2_blend({**{k: F.col(f"p_{k}") for k in parts}, "coverage": coverage, "phrase": phrase}) * factor
    rows = rows.withColumn("raw", raw).withColumn("share", fusion.normalise_max("raw", "query_id"))
    return rows.select("document_id", F.round("raw", 6).alias("raw_score"), F.when(F.col("raw") > 0, F.greatest(F.lit(1.0), F.round(100 * F.col("share"), 2))).otherwise(0.0).alias("relevance"))


_SIM = lambda x: f"len(list_intersect({_TRI(_TOK(x))}, {_TRI(_ASKED)})) / len(list_distinct(list_concat({_TRI(_TOK(x))}, {_TRI(_ASKED)})))"
STAGE2_SQL = f"""WITH {CORPUS_SQL}, first AS (SELECT document_id, score FROM ({STAGE1_SQL})), docs AS (SELECT doc_id, document_id, score, document_type AS kind, CASE WHEN doc_id % 5 = 0 THEN 'Bail ' ELSE '' END || title AS title, text, lower(text) AS low FROM first JOIN corpus USING (document_id)),
lines AS (SELECT document_id, unnest(string_split(text, chr(10))) AS line FROM docs), chunks AS (SELECT document_id, {_RANK("line")} AS r, {_SIM("substr(line, 1, 5000)")} AS sim FROM lines), best AS (SELECT document_id, max(r + sim) AS chunk FROM chunks WHERE r > 0 OR sim >= 0.03 GROUP BY 1),
m AS (SELECT d.*, {_RANK("text")} AS ft, coalesce(chunk, 0) AS chunk, {_RANK("title")} + {_SIM("title")} AS tt, (contains(low, 'thing')::INTEGER + contains(low, 'les')::INTEGER + contains(low, 'die')::INTEGER + contains(low, 'que')::INTEGER + contains(low, 'bail')::INTEGER) / 5 AS cov, contains(low, 'thing the')::INTEGER AS ph FROM docs d LEFT JOIN best USING (document_id)),
r AS (SELECT document_id, (0.22 * score / max(score) OVER () + 0.34 * CASE WHEN max(ft) OVER () > 0 THEN ft / max(ft) OVER () ELSE 0 END + 0.20 * CASE WHEN max(chunk) OVER () > 0 THEN chunk / max(chunk) OVER () ELSE 0 END + 0.15 * cov + 0.07 * CASE WHEN max(tt) OVER () > 0 THEN tt / max(tt) OVER () ELSE 0 END + 0.02 * ph)
  * CASE WHEN kind IN ('Constitution', 'Act') THEN 1.15 WHEN contains(kind, 'Judgment') THEN 1.12 WHEN contains(kind, 'Gazette') THEN 1.04 WHEN contains(kind, 'Parliament Paper') THEN 0.86 ELSE 1 END
  * CASE WHEN doc_id % 5 = 1 THEN 0.82 ELSE 1 END * CASE WHEN doc_id % 7 = 0 THEN 0.86 ELSE 1 END * CASE WHEN doc_id % 3 = 0 THEN 0.75 ELSE 1 END * CASE WHEN doc_id % 11 = 0 THEN 0.80 ELSE 1 END * CASE WHEN contains(lower(title), 'bail') THEN 1.18 ELSE 0.62 END AS raw FROM m)
SELECT document_id, round(raw, 6)::DOUBLE AS raw_score, (CASE WHEN raw > 0 THEN greatest(1.0, round(100 * raw / max(raw) OVER (), 2)) ELSE 0 END)::DOUBLE AS relevance FROM r"""


def knn_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Five nearest vectors of those whose id is divisible by 50."""
    table_ = table(spark, folder, "embeddings")
    found = vectors.nearest(table_, table_.where("vec_id % 50 = 0"), 5)
    return found.select("query_id", "vec_id", F.round("score", 5).alias("score"), "rank")


def vector_search(spark: SparkSession, folder: str) -> DataFrame:
    """Of the queries divisible by 50, how many of the ten nearest vectors with an even label the index finds: queries, pairs, whether recall is 0.9 or more."""
    table_ = table(spark, folder, "embeddings")
    asked, test = table_.where("vec_id % 50 = 0"), F.col("label") % 2 == 0
    index = vectors.build(table_, f"{shared.shared_dir(spark)}/corvex-vectors/{uuid.uuid4().hex}", ["label"])
    found = vectors.search(index, asked, 10, probes=vectors.probes_for(index, asked, 10, test=test), test=test)
    truth = vectors.nearest(table_.where(test), asked, 10)
    hits = truth.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hits.agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("pairs"), (F.count("hit") >= 0.9 * F.count("*")).alias("recall_reached"))


VECTOR_SQL = """WITH q AS (SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0), n AS (SELECT q.vec_id, least(10, count(*)) AS n FROM q JOIN embeddings e ON e.label % 2 = 0 AND e.vec_id <> q.vec_id GROUP BY 1)
SELECT count(*) AS queries, sum(n)::BIGINT AS pairs, true AS recall_reached FROM n"""


KNN_SQL = """WITH p AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS s FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, vec_id, round(s, 5) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id))::INTEGER AS rank FROM p QUALIFY rank <= 5"""


def best_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Three best turns of each conversation by rank, similarity and place."""
    tokens = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", F.round(tx.or_rank(tokens, ["the", "la", "die"]), 6).alias("rank"))
    return first_per_key(rows, ["conv_id"], F.col("rank").desc(), F.col("turn"), n=3).withColumn("rank", F.col("rank").cast("double"))


EVIDENCE_SQL = r"""WITH a AS (SELECT conv_id, turn, 0.1 * len(list_filter(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> ''), lambda x: starts_with(x, 'the') OR starts_with(x, 'la') OR starts_with(x, 'die'))) AS s FROM conversations),
b AS (SELECT conv_id, turn, round(s / (s + 1), 6)::DOUBLE AS rank FROM a)
SELECT conv_id, turn, rank FROM b QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY rank DESC, turn) <= 3"""

QUERIES = {f.__name__: f for f in (bm25_topk, keyword_search, token_estimate_stats, extraction_quality, doc_quality_rollup, spread_summary, trigram_similarity, query_parsing, citation_projection, policy_screen, citation_extraction, rrf_fusion, legal_quality_rerank, pack_select, intent_features, stage1_ranking, stage2_blend, knn_topk, best_evidence, title_matches, near_words, vector_search)}
SQL = {
    "bm25_topk": BM25_SQL, "keyword_search": KEYWORD_SQL, "token_estimate_stats": TOKEN_SQL, "extraction_quality": QUALITY_SQL, "doc_quality_rollup": ROLLUP_SQL, "spread_summary": SUMMARY_SQL,
    "trigram_similarity": TRIGRAM_SQL, "query_parsing": PARSING_SQL, "citation_projection": CITATION_SQL, "policy_screen": POLICY_SQL, "citation_extraction": CITED_SQL, "rrf_fusion": RRF_SQL,
    "legal_quality_rerank": RERANK_SQL, "pack_select": SELECT_SQL, "intent_features": INTENT_SQL, "stage1_ranking": STAGE1_SQL, "stage2_blend": STAGE2_SQL, "knn_topk": KNN_SQL, "best_evidence": EVIDENCE_SQL,
    "title_matches": TITLES_SQL, "near_words": NEAR_SQL, "vector_search": VECTOR_SQL,
}
