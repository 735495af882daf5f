"""The hybrid search as a whole: one exact list, five keyword and five vector lists, fused, ranked again, packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvex.functions import text as tx
from corvex.operators import fusion, search, search_index, two_stage, vectors
from corvex.plans import text_queries
from corvex.sources.tables import CORPUS_SQL, corpus, table

ASKED = "the thing that"
CITED = ("7", 1997)
SIZE = 20


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose title cites an act of their year."""
    return corpus(spark, folder).withColumn("title", F.concat("title", F.lit("; Act No. "), F.col("doc_id") % 50, F.lit(" of "), "year"))


def lists(spark: SparkSession, folder: str) -> DataFrame:
    """Hits of the eleven lists with intent and variant of the query that found them.

    The vectors of the five variants are those of the ids 1 to 5, as texts are
    embedded by the caller.
    """
    docs = _docs(spark, folder)
    variants = fusion.expand(spark, spark.createDataFrame([(1, ASKED)], "query_id int, query string")).drop("query_id")
    named = {name: f"{ASKED} {' '.join(words)}" for name, words in fusion.INTENTS.items()}
    order = F.create_map(*[x for i, name in enumerate(named, 1) for x in (F.lit(name), F.lit(i))])
    index = text_queries.index_of(spark, folder)
    words = search_index.bm25_each(index, named, SIZE).select(F.col("query").alias("intent"), "document_id", "score", "rank", F.lit("keyword").alias("retriever"))
    table_ = table(spark, folder, "embeddings")
    near = vectors.nearest(table_, table_.where(F.col("vec_id").between(1, len(named))), SIZE)
    near = near.select(F.get(F.array(*map(F.lit, named)), (F.col("query_id") - 1).cast("int")).alias("intent"), F.concat(F.lit("doc_"), "vec_id").alias("document_id"), "score", "rank", F.lit("vector").alias("retriever"))
    found = words.unionByName(near).withColumns({"exact": F.lit(False), "result_set": order[F.col("intent")] + F.when(F.col("retriever") == "vector", len(named)).otherwise(0)})
    attributes = ["document_id", "title", F.concat_ws(", ", "title", "year").alias("citation"), "text", "authority_level", "year"]
    tagged = found.join(docs.select(*attributes), "document_id").join(F.broadcast(variants), "intent")  # five rows
    tagged = fusion.tag(fusion.intent_features(tagged, text_queries.YEAR))
    cited = docs.withColumns({"page_start": F.lit(1), "chunk_index": F.col("doc_id")})
    cited = search.exact_citation(cited, [CITED], [], []).withColumns({"exact": F.lit(True), "result_set": F.lit(0), "retriever": F.lit("exact"), "intent": F.lit(None).cast("string"), "query_variant_id": F.lit(None).cast("string")})
    columns = ["result_set", "rank", "document_id", "authority_level", "exact", "score", "retriever", "intent", "query_variant_id", "text"]
    return tagged.select(*columns).unionByName(cited.select(*columns)).withColumn("chunk_id", F.col("document_id")).withColumn("tokens", tx.estimate_tokens(F.col("text")).cast("long")).drop("text")


def _ranked(spark: SparkSession, folder: str) -> DataFrame:
    fused = fusion.reciprocal_rank_fusion(lists(spark, folder))
    again = fusion.quality_multiplier(F.col("authority_level"), F.array().cast("array<string>"), F.col("exact"))
    return fused.withColumn("score", F.round(F.col("score") * again, 8))


def hybrid_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """The fused list after the second ranking, with all lists, intents and variants that found each chunk."""
    rows = _ranked(spark, folder)
    return rows.select("chunk_id", "score", "exact", F.array_join("retrieval_evidence", "; ").alias("evidence"), F.array_join("query_intents", "|").alias("intents"), F.array_join("query_variant_ids", "|").alias("variants"))


def hybrid_pack(spark: SparkSession, folder: str) -> DataFrame:
    """A query's whole way: eleven lists, fused, ranked again, packed."""
    ranked = search.top(_ranked(spark, folder), 250, F.col("score").desc(), F.col("chunk_id")).withColumnRenamed("rank", "seq")  # all that eleven lists can hold
    return fusion.select_pack(ranked.withColumn("pack_id", F.lit("pack_1")), 8, 12000).select("pack_item_id", "chunk_id", "tokens", "note")


def retriever_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Hits by retriever and by intent of the hybrid search's lists."""
    hits = lists(spark, folder).withColumn("name", F.split_part("retriever", F.lit(":"), F.lit(1)))
    by = lambda c, kind: hits.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "value", "n")
    return by("name", "retriever").unionByName(by("intent", "intent"))


_TOKENS = lambda x: f"list_filter(list_transform(regexp_extract_all({x}, '[A-Za-z0-9][A-Za-z0-9()./-]*'), lambda x: lower(x)), lambda x: length(x) > 1)"
_VARIANTS = ", ".join(f"({i}, '{name}', '{ASKED} {' '.join(words)}', '{name}:{'-'.join((ASKED + ' ' + ' '.join(words)).split())}')" for i, (name, words) in enumerate(fusion.INTENTS.items(), 1))
_LISTS_SQL = f"""{CORPUS_SQL}, i AS (SELECT * FROM (VALUES {_VARIANTS}) v(k, intent, q, variant)),
t AS (SELECT document_id, title, authority_level AS a, {_TOKENS("text")} AS w FROM corpus), s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t),
qt AS (SELECT k, intent, variant, term, count(*) AS times FROM (SELECT k, intent, variant, unnest({_TOKENS("q")}) AS term FROM i) GROUP BY ALL),
tf AS (SELECT document_id, title, a, len(w) AS dl, term, len(list_filter(w, lambda x: x = term)) AS tf FROM t, (SELECT DISTINCT term FROM qt)),
df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY 1),
ks AS (SELECT k, intent, variant, document_id, any_value(a) AS a, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) + CASE WHEN contains(lower(title), term) THEN 0.4 ELSE 0 END) AS x FROM tf JOIN df USING (term) JOIN qt USING (term), s GROUP BY 1, 2, 3, 4),
kr AS (SELECT k AS result_set, 'keyword' AS name, intent, variant, document_id, round(x * [1.35, 1.30, 1.25, 1.15, 1.05, 1.00, 0.95, 0.90, 0.80][a], 6) AS score FROM ks WHERE x > 0),
vr AS (SELECT k + 5 AS result_set, 'vector' AS name, intent, variant, 'doc_' || v.vec_id AS document_id, row_number() OVER (PARTITION BY k ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], v.embedding::DOUBLE[]), 12) DESC, v.vec_id) AS rank FROM i JOIN embeddings e ON e.vec_id = k JOIN embeddings v ON v.vec_id <> k QUALIFY rank <= {SIZE}),
xr AS (SELECT document_id, row_number() OVER (ORDER BY authority_level, year DESC, doc_id) AS rank FROM corpus WHERE doc_id % 50 = {CITED[0]} AND year = {CITED[1]} QUALIFY rank <= 50),
l AS (SELECT result_set, name, intent, variant, document_id, row_number() OVER (PARTITION BY result_set ORDER BY score DESC, document_id) AS rank, false AS exact FROM kr QUALIFY rank <= {SIZE}
  UNION ALL SELECT result_set, name, intent, variant, document_id, rank, false FROM vr JOIN corpus USING (document_id) UNION ALL SELECT 0, 'exact', NULL, NULL, document_id, rank, true FROM xr)"""
FUSION_SQL = f"""WITH {_LISTS_SQL},
f AS (SELECT document_id, sum(1.0 / (60 + rank) + CASE WHEN exact THEN 0.10 / rank ELSE 0 END) AS points, bool_or(exact) AS exact, array_to_string(list_sort(list_distinct(list(name || coalesce(':' || intent, '') || ' rank ' || rank))), '; ') AS evidence,
  array_to_string(list_sort(list_distinct(list(intent) FILTER (intent IS NOT NULL))), '|') AS intents, array_to_string(list_sort(list_distinct(list(variant) FILTER (variant IS NOT NULL))), '|') AS variants FROM l GROUP BY 1)
SELECT document_id AS chunk_id, round(points * [1.35, 1.30, 1.25, 1.15, 1.05, 1.00, 0.95, 0.90, 0.80][authority_level] * [1.35, 1.30, 1.25, 1.15, 1.05, 1.00, 0.95, 0.90, 0.80][authority_level] * CASE WHEN exact THEN 1.25 ELSE 1 END, 8)::DOUBLE AS score, exact, evidence, coalesce(intents, '') AS intents, coalesce(variants, '') AS variants FROM f JOIN corpus USING (document_id)"""
PACK_SQL = f"""WITH RECURSIVE r AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS seq, greatest(1, len(regexp_extract_all(text, '\\S+')) * 4 // 3)::BIGINT AS tokens FROM ({FUSION_SQL}) JOIN documents ON chunk_id = 'doc_' || doc_id),
p AS (SELECT 0::BIGINT AS seq, 0::BIGINT AS used, 0 AS n, NULL::VARCHAR AS chunk_id, 0::BIGINT AS tokens, false AS taken
  UNION ALL SELECT r.seq, p.used + CASE WHEN p.n < 8 AND (p.n = 0 OR p.used + r.tokens <= 12000) THEN r.tokens ELSE 0 END, p.n + (p.n < 8 AND (p.n = 0 OR p.used + r.tokens <= 12000))::INT, r.chunk_id, r.tokens, p.n < 8 AND (p.n = 0 OR p.used + r.tokens <= 12000) FROM p JOIN r ON r.seq = p.seq + 1)
SELECT 'pack_1_item_' || lpad(n::VARCHAR, 3, '0') AS pack_item_id, chunk_id, tokens, 'new source document' AS note FROM p WHERE taken"""
COUNTS_SQL = f"""WITH {_LISTS_SQL} SELECT 'retriever' AS kind, name AS value, count(*) AS n FROM l GROUP BY 2 UNION ALL SELECT 'intent', intent, count(*) FROM l WHERE intent IS NOT NULL GROUP BY 2"""


def evidence_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The three best lines of each document of the first stage, by rank, similarity and place, with their score."""
    first = text_queries.stage1_ranking(spark, folder).select("document_id")
    docs = corpus(spark, folder).join(F.broadcast(first), "document_id")  # 50 rows
    lines = docs.select("document_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "chunk_text"))
    lines = lines.select("document_id", F.concat_ws("_", F.lit("chunk"), "document_id", "chunk_index").alias("chunk_id"), "chunk_index", F.floor(F.col("chunk_index") / 6).cast("int").alias("page_start"), "chunk_text")
    found = two_stage.best_chunks(lines, text_queries.RANKED_QUERY, 3)
    return found.select("document_id", "chunk_id", "place", F.round("chunk_rank", 6).alias("chunk_rank"), F.round("chunk_similarity", 6).alias("chunk_similarity"), F.round("chunk_score", 6).alias("chunk_score"))


EVIDENCE_SQL = f"""WITH {CORPUS_SQL}, first AS (SELECT document_id FROM ({text_queries.STAGE1_SQL})), lines AS (SELECT document_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM first JOIN corpus USING (document_id)),
c AS (SELECT document_id, i, {text_queries._RANK("line")} AS r, {text_queries._SIM("substr(line, 1, 5000)")} AS s FROM lines)
SELECT document_id, 'chunk_' || document_id || '_' || i AS chunk_id, row_number() OVER (PARTITION BY document_id ORDER BY round(r, 9) DESC, round(s, 9) DESC, i)::INT AS place, round(r, 6) AS chunk_rank, round(s, 6) AS chunk_similarity, round(r + s, 6) AS chunk_score FROM c WHERE r > 0 OR s >= 0.03 QUALIFY place <= 3"""

_NAMES = "hybrid_fusion hybrid_pack retriever_counts evidence_chunks".split()
QUERIES = {n: globals()[n] for n in _NAMES}
SQL = dict(zip(_NAMES, (FUSION_SQL, PACK_SQL, COUNTS_SQL, EVIDENCE_SQL), strict=True))
