"""Queries of the two-stage ranking and of the summary and index builds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvex.functions import rules, text as tx
from corvex.operators import relational as rel, search, two_stage
from corvex.plans import text_queries
from corvex.sources.tables import CORPUS_SQL, corpus, table

QUERY = "bail and customs thing that with"


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    hint = F.when(F.col("doc_id") % 5 == 0, "Bail ").when(F.col("doc_id") % 7 == 0, "Customs ").otherwise("")
    return corpus(spark, folder).withColumn("title", F.concat(hint, F.col("title")))


_DOCS_SQL = f"{CORPUS_SQL}, dd AS (SELECT * REPLACE (CASE WHEN doc_id % 5 = 0 THEN 'Bail ' WHEN doc_id % 7 = 0 THEN 'Customs ' ELSE '' END || title AS title) FROM corpus)"
_PREFIX = "(starts_with(x, 'bail') OR starts_with(x, 'customs') OR starts_with(x, 'thing'))"
_TOK = text_queries._TOK
_HITS = lambda x: f"0.1 * len(list_filter({_TOK(x)}, lambda x: {_PREFIX}))"


def title_expansion(spark: SparkSession, folder: str) -> DataFrame:
    """The best 40 documents whose title has a hint of the query."""
    return two_stage.title_expansion(_docs(spark, folder), QUERY, 40)


TITLE_SQL = f"""WITH {_DOCS_SQL}, a AS (SELECT document_id, {_HITS(text_queries.sql_summary("text"))} AS s, {_HITS("title")} AS t, {text_queries._TRI(_TOK("title"))} AS g, {text_queries._TRI("['bail', 'and', 'customs', 'thing', 'that', 'with']")} AS h FROM dd WHERE contains(lower(title), 'bail') OR contains(lower(title), 'customs'))
SELECT document_id, round(0.6 + s / (s + 1) + 3.5 * t / (t + 1) + 2.0 * len(list_intersect(g, h)) / len(list_distinct(list_concat(g, h))), 6)::DOUBLE AS score FROM a ORDER BY score DESC, document_id LIMIT 40"""


def full_text_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Rank, term and phrase hits of full texts, with the factor of their titles."""
    rows = two_stage.full_text_metrics(_docs(spark, folder), QUERY, ["thing that", "that with"])
    return rows.select("document_id", F.round("full_text_rank", 6).cast("double").alias("rank"), "term_hits", "phrase_hits", two_stage.hint_multiplier(F.col("title"), two_stage.title_hints(QUERY)).cast("double").alias("factor"))


METRIC_SQL = f"""WITH {_DOCS_SQL}, a AS (SELECT document_id, title, lower(text) AS l, {_HITS("text")} AS s FROM dd)
SELECT document_id, round(s / (s + 1), 6)::DOUBLE AS rank, (contains(l, 'bail')::INT + contains(l, 'customs')::INT + contains(l, 'thing')::INT)::INT AS term_hits, (contains(l, 'thing that')::INT + contains(l, 'that with')::INT)::INT AS phrase_hits, (CASE WHEN contains(lower(title), 'bail') OR contains(lower(title), 'customs') THEN 1.18 ELSE 0.62 END)::DOUBLE AS factor FROM a"""


def two_stage_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The first stage and the title expansion merged."""
    first = text_queries.stage1_ranking(spark, folder).select("document_id", "score")
    return two_stage.merge_stages(first, title_expansion(spark, folder))


CANDIDATE_SQL = f"""WITH f AS ({text_queries.STAGE1_SQL}), t AS ({TITLE_SQL}), u AS (SELECT document_id, score, 0 AS branch FROM f UNION ALL SELECT document_id, score, 1 FROM t),
b AS (SELECT document_id, max(score) AS score, arg_min(branch, (-score, branch)) AS branch FROM u GROUP BY 1) SELECT document_id, score, branch, (row_number() OVER (ORDER BY score DESC, branch, document_id))::INT AS rank FROM b"""


def summary_build(spark: SparkSession, folder: str) -> DataFrame:
    """A dry run of the summary build: eligible, present, to build, to prune; by language."""
    docs = corpus(spark, folder).join(table(spark, folder, "labels"), "doc_id", "left")
    eligible = docs.where((F.length("text") > 0) & (F.coalesce("quality", F.lit(1)) * 0.5 >= 0.10))
    present = docs.where("doc_id % 3 = 0").select("doc_id", "language")
    count = lambda rows, k: rows.groupBy("language").agg(F.count("*").alias("n")).select("language", F.lit(k).alias("kind"), "n")
    parts = [count(eligible, "eligible"), count(present, "present"), count(eligible.join(present.select("doc_id"), "doc_id", "left_anti"), "to_build"), count(present.join(eligible.select("doc_id"), "doc_id", "left_anti"), "to_prune")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


SUMMARY_SQL = """WITH d AS (SELECT documents.*, quality FROM documents LEFT JOIN labels USING (doc_id)), e AS (SELECT doc_id, lang FROM d WHERE length(text) > 0 AND coalesce(quality, 1) * 0.5 >= 0.10), p AS (SELECT doc_id, lang FROM d WHERE doc_id % 3 = 0)
SELECT lang AS language, 'eligible' AS kind, count(*) AS n FROM e GROUP BY 1 UNION ALL SELECT lang, 'present', count(*) FROM p GROUP BY 1 UNION ALL SELECT lang, 'to_build', count(*) FROM e WHERE doc_id NOT IN (SELECT doc_id FROM p) GROUP BY 1 UNION ALL SELECT lang, 'to_prune', count(*) FROM p WHERE doc_id NOT IN (SELECT doc_id FROM e) GROUP BY 1"""


def inverted_index_stats(spark: SparkSession, folder: str) -> DataFrame:
    """The keyword index's 50 terms with the most documents."""
    index = search.inverted_index(corpus(spark, folder))
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("most")).orderBy(F.col("df").desc(), "term").limit(50)


INDEX_SQL = """WITH t AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9()./-]*'), lambda x: lower(x)), lambda x: length(x) > 1)) AS term FROM documents), f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2)
SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, max(tf) AS most FROM f GROUP BY 1 ORDER BY df DESC, term LIMIT 50"""


def canonical_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Rows under a canonical key, merged: best level, first id, types in order of appearance.

    A third of the rows have an address, another one nothing but title, type and source.
    """
    docs = corpus(spark, folder)
    third, none = F.col("doc_id") % 3, F.lit(None).cast("string")
    key = rules.canonical_key(F.when(third == 0, F.concat(F.lit(" Doc_"), F.col("doc_id") % 50)), none, F.when(third == 1, F.concat(F.lit("http://H/"), F.col("doc_id") % 70)), F.col("title"), F.col("document_type"), F.col("source_id"), none)
    rows = docs.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("authority_level").alias("level"))
    types = docs.groupBy(key.alias("key"), "document_type").agg(F.min("doc_id").alias("seen")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seen", "document_type"))).alias("t"))
    return rows.where("n > 1").join(types, "key").select("key", "n", "first_id", "level", F.array_join("t.document_type", "|").alias("types"))


CANON_SQL = f"""WITH {CORPUS_SQL}, k AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'document_id:doc_' || (doc_id % 50) WHEN 1 THEN 'source_url:http://h/' || (doc_id % 70) ELSE 'fallback:' || lower(trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g'))) || '|' || lower(document_type) || '|' || lower(source_id) || '|' END AS key, * FROM corpus),
o AS (SELECT key, document_type, min(doc_id) AS seen FROM k GROUP BY 1, 2), s AS (SELECT key, string_agg(document_type, '|' ORDER BY seen) AS types FROM o GROUP BY 1)
SELECT k.key, count(*) AS n, min(doc_id) AS first_id, max(authority_level) AS level, any_value(types) AS types FROM k JOIN s ON k.key = s.key GROUP BY 1 HAVING count(*) > 1"""


def event_history(spark: SparkSession, folder: str) -> DataFrame:
    """A user's recent errors and purchases after a cutoff, the last 30 in rising order, with support counts of all users."""
    events = table(spark, folder, "events").where("event_type in ('error', 'purchase') and ts >= timestamp_ntz'2024-01-10'")
    recent = events.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(30).select("event_id", "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))
    totals = rel.first_per_key(events.groupBy("user_id").agg(F.count("*").alias("events"), F.countDistinct("event_type").alias("types")), ["user_id"], F.col("events").desc())
    return recent.join(totals, "user_id").orderBy("at", "event_id")


HISTORY_SQL = """WITH e AS (SELECT * FROM events WHERE event_type IN ('error', 'purchase') AND ts >= '2024-01-10'), r AS (SELECT * FROM e ORDER BY ts DESC, event_id DESC LIMIT 30), t AS (SELECT user_id, count(*) AS events, count(DISTINCT event_type) AS types FROM e GROUP BY 1)
SELECT user_id, event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, events, types FROM r JOIN t USING (user_id)"""

_NAMES = "title_expansion full_text_metrics two_stage_candidates summary_build inverted_index_stats canonical_duplicates event_history".split()
QUERIES = {n: globals()[n] for n in _NAMES}
SQL = dict(zip(_NAMES, (TITLE_SQL, METRIC_SQL, CANDIDATE_SQL, SUMMARY_SQL, INDEX_SQL, CANON_SQL, HISTORY_SQL), strict=True))
