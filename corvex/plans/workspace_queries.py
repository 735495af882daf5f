"""Queries of ids, access, relevance, review decisions, listings, retries, load summaries and ranked results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvex.functions import ids, text as tx
from corvex.operators import two_stage, workspace
from corvex.plans import hybrid_queries, text_queries
from corvex.sources.tables import CORPUS_SQL, corpus, table
from corvex.streaming import rates

NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def stable_ids(spark: SparkSession, folder: str) -> DataFrame:
    """All kinds of ids, built from documents."""
    n, d = F.col("doc_id"), F.col("document_id")
    return corpus(spark, folder).select(
        d, ids.chunk_id(d, n % 7, tx.stable_id(F.col("text"))).alias("chunk"), ids.page_id(d, F.lit("ocr"), n % 300).alias("page"), ids.anchor_id(F.concat(F.lit("p_item_"), n), n % 5, F.substring("text", 1, 30)).alias("anchor"),
        ids.relevance_id(F.lit("case"), d, F.lit("retrieval")).alias("relevance"), ids.assessment_id(F.lit("claim"), d, F.lit("supports")).alias("assessment"), ids.summary_id(d, F.lit("short"), F.lit("spread")).alias("summary"), ids.point_id(NAMESPACE, d).alias("point"),
    )


_UUID = "sha1(from_hex('{ns}') || encode(document_id))".format(ns=NAMESPACE.replace("-", ""))
IDS_SQL = f"""WITH {CORPUS_SQL}, u AS (SELECT *, {_UUID} AS h FROM corpus)
SELECT document_id, 'chunk_' || document_id || '_' || lpad((doc_id % 7)::VARCHAR, 5, '0') || '_' || substr(sha1(text), 1, 16) AS chunk, 'page_' || document_id || '_ocr_' || lpad((doc_id % 300)::VARCHAR, 5, '0') || '_' || substr(sha1(document_id || ':ocr:' || (doc_id % 300)), 1, 12) AS page,
 'anchor_p_item_' || doc_id || '_' || lpad((doc_id % 5)::VARCHAR, 3, '0') || '_' || substr(sha1('p_item_' || doc_id || ':' || (doc_id % 5) || ':' || substr(text, 1, 30)), 1, 16) AS anchor, 'rel_' || substr(sha256('case:' || document_id || ':retrieval'), 1, 32) AS relevance, 'assess_' || substr(sha256('claim:' || document_id || ':supports'), 1, 32) AS assessment,
 'docsum_' || md5(document_id || ':short:spread') AS summary, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || ['8', '9', 'a', 'b'][(strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point FROM u"""


def access_lookups(spark: SparkSession, folder: str) -> DataFrame:
    """What an active user reaches through permissions: cases are orders, threads their items, messages and runs hang on threads."""
    orders, items, customers = (table(spark, folder, t) for t in ("orders", "lineitem", "customer"))
    users = customers.select(F.pmod("c_custkey", F.lit(7)).alias("user_id"), F.when(F.max("c_acctbal").over(Window.partitionBy(F.pmod("c_custkey", F.lit(7)))) > 0, "active").otherwise("left").alias("status")).distinct()
    permissions = orders.where("o_orderstatus = 'P'").select((F.col("o_custkey") % 7).alias("user_id"), F.col("o_orderkey").alias("case_id"))
    threads = items.select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("thread_id"), F.col("l_orderkey").alias("case_id"))
    messages = items.select(F.concat(F.lit("m"), F.concat_ws(":", "l_orderkey", "l_linenumber")).alias("message_id"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("thread_id"))
    runs = items.where("l_returnflag = 'R'").select(F.concat(F.lit("r"), F.concat_ws(":", "l_orderkey", "l_linenumber")).alias("run_id"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("thread_id"))
    return workspace.lookups(workspace.reachable(3, permissions, users), threads, messages, runs)


ACCESS_SQL = """WITH u AS (SELECT c_custkey % 7 AS u FROM customer GROUP BY 1 HAVING max(c_acctbal) > 0), c AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey % 7 = 3 AND 3 IN (SELECT u FROM u)), t AS (SELECT l_orderkey || ':' || l_linenumber AS k, l_orderkey AS case_id, l_returnflag FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM c))
SELECT DISTINCT 'thread' AS lookup, k AS key, case_id FROM t UNION ALL SELECT 'message', 'm' || k, case_id FROM t UNION ALL SELECT 'agent_run', 'r' || k, case_id FROM t WHERE l_returnflag = 'R'"""


def relevance_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Relevance of parts to orders from the items of packs, merged into the table of what is known."""
    items = table(spark, folder, "lineitem")
    new = workspace.pack_relevance(items.where("l_linenumber <= 3").select(F.col("l_orderkey").alias("case_id"), F.concat(F.lit("doc_"), F.col("l_partkey") % 50).alias("document_id"), F.concat_ws("_", F.lit("i"), "l_linenumber").alias("pack_item_id"), (F.col("l_quantity") / 40).cast("double").alias("fused_score"), F.when(F.col("l_linenumber") > 1, F.lit(0.8)).alias("multiplier")))
    known = items.where("l_linenumber >= 3").groupBy(F.col("l_orderkey").alias("case_id"), F.concat(F.lit("doc_"), F.col("l_partkey") % 50).alias("document_id")).agg(F.round(F.max("l_discount") * 10, 6).cast("double").alias("relevance_score"), F.max("l_returnflag").alias("f"))
    known = known.select(ids.relevance_id(F.col("case_id").cast("string"), F.col("document_id"), F.lit("retrieval")).alias("relevance_id"), "case_id", "document_id", F.least(F.lit(1.0), "relevance_score").alias("relevance_score"), F.lit(None).cast("double").alias("confidence_score"), F.lit("old").alias("evidence"), F.when(F.col("f") == "R", "rejected").when(F.col("f") == "A", "accepted").otherwise("candidate").alias("status"))
    return workspace.merge_relevance(known, new).drop("relevance_id")


RELEVANCE_SQL = """WITH i AS (SELECT l_orderkey AS case_id, 'doc_' || (l_partkey % 50) AS document_id, l_linenumber AS k, greatest(0, least(1, l_quantity / 40))::DOUBLE AS s, greatest(0, least(1, greatest(0, least(1, l_quantity / 40))::DOUBLE * CASE WHEN l_linenumber > 1 THEN 0.8 ELSE 1 END)) AS c FROM lineitem WHERE l_linenumber <= 3),
n AS (SELECT case_id, document_id, round(max(s), 6) AS s, round(max(c), 6) AS c, string_agg('i_' || k, '|' ORDER BY s DESC, k) AS e FROM i GROUP BY 1, 2), o AS (SELECT l_orderkey AS case_id, 'doc_' || (l_partkey % 50) AS document_id, least(1.0, round(max(l_discount) * 10, 6))::DOUBLE AS s, max(l_returnflag) AS f FROM lineitem WHERE l_linenumber >= 3 GROUP BY 1, 2),
j AS (SELECT coalesce(n.case_id, o.case_id) AS case_id, coalesce(n.document_id, o.document_id) AS document_id, greatest(n.s, o.s) AS s, coalesce(n.c, 0) AS c, n.e, f, n.s IS NOT NULL AS fresh, o.s IS NOT NULL AS known FROM n FULL JOIN o ON n.case_id = o.case_id AND n.document_id = o.document_id)
SELECT case_id, document_id, s AS relevance_score, c::DOUBLE AS confidence_score, CASE WHEN s >= 0.95 THEN 'direct' WHEN s >= 0.75 THEN 'strong' WHEN s >= 0.45 THEN 'moderate' WHEN s >= 0.10 THEN 'weak' WHEN s > 0 THEN 'background' ELSE 'irrelevant' END AS relevance_band, CASE WHEN known AND f = 'A' THEN 'accepted' WHEN known AND f = 'R' AND NOT fresh THEN 'rejected' ELSE 'candidate' END AS status, coalesce(e, 'old') AS evidence FROM j"""


def review_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Review items after their last decisions; of decisions of the same time, the one that the table holds first counts."""
    kinds = (*workspace.PLAIN_KINDS, "legal_claim", "unknown")
    pick = lambda values, by: F.get(F.array(*map(F.lit, values)), by.cast("int"))
    items = table(spark, folder, "orders").select(F.col("o_orderkey").alias("review_item_id"), pick(kinds, F.col("o_custkey") % 7).alias("item_type"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("pending").alias("status"))
    decisions = table(spark, folder, "lineitem").where("l_linenumber <= 4").select(F.col("l_orderkey").alias("review_item_id"), pick((*workspace.DECISIONS, "maybe"), F.col("l_partkey") % 4).alias("decision"), F.struct("l_shipdate", "l_linenumber").alias("decided_at"), F.struct("_metadata.file_path", "_metadata.row_index").alias("place"))
    return workspace.decide(items, decisions)


DECISION_SQL = """WITH l AS (SELECT l_orderkey, arg_max(['approved', 'rejected', 'changes_requested', 'maybe'][(l_partkey % 4 + 1)::INT], (l_shipdate, l_linenumber)) AS d FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1),
i AS (SELECT o_orderkey, ['draft', 'adverse_evidence', 'missing_evidence', 'clarification_need', 'authority_candidate', 'legal_claim', 'unknown'][(o_custkey % 7 + 1)::INT] AS t, o_orderstatus <> 'F' AS pending, d FROM orders LEFT JOIN l ON l_orderkey = o_orderkey), c AS (SELECT *, coalesce(pending AND t <> 'unknown' AND d <> 'maybe', false) AS done FROM i)
SELECT o_orderkey AS review_item_id, t AS item_type, CASE WHEN done OR NOT pending THEN 'completed' ELSE 'pending' END AS status, CASE WHEN done THEN CASE WHEN t = 'legal_claim' AND d = 'approved' THEN 'lawyer_approved' ELSE d END END AS item_status FROM c"""


def ingestion_listing(spark: SparkSession, folder: str, limit: int = 200) -> DataFrame:
    """The newest failed events of an ingestion run, 1 to 1000 of them."""
    rows = table(spark, folder, "events").where("user_id % 20 = 3 and event_type = 'error'")
    return rows.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(max(1, min(1000, limit))).select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


LIST_SQL = "SELECT event_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events WHERE user_id % 20 = 3 AND event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 200"


def rate_limit_retry(spark: SparkSession, folder: str) -> DataFrame:
    """Windows over the limit, when they reset, and how many whole seconds after their last request a user may come back."""
    events = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    micros = F.unix_micros("ts")
    start = F.floor(micros / 3_600_000_000) * 3600
    rows = events.groupBy("user_id", start.alias("window_start")).agg(F.count("*").alias("n"), F.max(micros).alias("last")).where("n > 2")
    return rows.select("user_id", "window_start", "n", (F.col("window_start") + 3600).alias("resets_at"), F.greatest(F.lit(1), F.ceil(((F.col("window_start") + 3600) * 1_000_000 - F.col("last")) / 1_000_000)).cast("long").alias("retry_after"), rates.retry_after(F.col("window_start"), F.floor(F.col("last") / 1_000_000)).alias("at_most"))


RETRY_SQL = """WITH w AS (SELECT user_id, (epoch_us(ts) // 3600000000) * 3600 AS s, count(*) AS n, max(epoch_us(ts)) AS last FROM events GROUP BY 1, 2 HAVING count(*) > 2)
SELECT user_id, s AS window_start, n, s + 3600 AS resets_at, greatest(1, ceil(((s + 3600) * 1000000 - last) / 1000000))::BIGINT AS retry_after, greatest(1, s + 3600 - last // 1000000)::BIGINT AS at_most FROM w"""


def exact_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Exact latencies of each route by a sketch and a second pass."""
    rows = table(spark, folder, "events").withColumnRenamed("event_type", "route")
    out = workspace.percentiles(rows, "route", "value", (0.5, 0.95, 0.99))
    return out.select("route", *[F.round(f"p{i}", 6).alias(name) for i, name in enumerate(("p50", "p95", "p99"))])


PERCENTILE_SQL = "SELECT event_type AS route, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events WHERE value IS NOT NULL GROUP BY 1"


def ranked_results(spark: SparkSession, folder: str) -> DataFrame:
    """The two-stage search as a whole: rank, relevance, best chunk and how many chunks each result has."""
    last, chunks = text_queries.stage2_blend(spark, folder), hybrid_queries.evidence_chunks(spark, folder)
    best = chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.min_by(F.struct("chunk_id", "chunk_score"), "place").alias("best"))
    rows = last.join(best, "document_id", "left").withColumn("rank", F.row_number().over(Window.orderBy(F.col("raw_score").desc(), "document_id")))  # 50 rows
    # The 50 rows meet their documents before excerpts are made: nothing else of the texts is touched.
    docs = corpus(spark, folder).select("document_id", "title", "year", "text").join(F.broadcast(rows), "document_id")
    docs = docs.withColumn("excerpt", tx.excerpt(tx.spread_summary(F.col("text")), two_stage.query_prefixes(text_queries.RANKED_QUERY), 60))
    nested = docs.select("rank", "relevance", "document_id", F.struct("title", "year", "excerpt").alias("document"), F.struct(F.col("best.chunk_id").alias("chunk_id"), F.col("best.chunk_score").alias("chunk_score")).alias("best_full_text_chunk"), F.struct(F.col("raw_score").alias("raw_score"), F.coalesce("n_chunks", F.lit(0)).alias("evidence_chunk_count")).alias("scoring_breakdown"))
    return nested.select("rank", "relevance", "document_id", "document.year", F.length("document.excerpt").alias("excerpt_chars"), "best_full_text_chunk.chunk_id", "best_full_text_chunk.chunk_score", "scoring_breakdown.evidence_chunk_count")


_P = ("thing", "les", "die", "que", "bail")
_AT = f"least({', '.join(f'nullif(instr(lower(f), {chr(39)}{w}{chr(39)}), 0)' for w in _P)})"
RANKED_SQL = rf"""WITH {CORPUS_SQL}, e AS ({hybrid_queries.EVIDENCE_SQL}), b AS (SELECT document_id, count(*) AS n, arg_min(chunk_id, place) AS chunk_id, arg_min(chunk_score, place) AS chunk_score FROM e GROUP BY 1),
r AS (SELECT document_id, relevance, row_number() OVER (ORDER BY raw_score DESC, document_id)::INT AS rank FROM ({text_queries.STAGE2_SQL})), f AS (SELECT document_id, year, trim(regexp_replace({text_queries.sql_summary("text")}, '\s+', ' ', 'g')) AS f FROM corpus),
p AS (SELECT *, {_AT} AS pos, length(f) AS m FROM f)
SELECT rank, relevance, document_id, year, (CASE WHEN pos IS NULL THEN length(trim(substr(f, 1, 120))) ELSE CASE WHEN pos - 60 > 1 THEN 3 ELSE 0 END + length(trim(substr(f, greatest(1, pos - 60)::INTEGER, (least(m, pos + 59) - greatest(1, pos - 60) + 1)::INTEGER))) + CASE WHEN pos + 59 < m THEN 3 ELSE 0 END END)::INT AS excerpt_chars, chunk_id, chunk_score, coalesce(n, 0) AS evidence_chunk_count FROM r JOIN p USING (document_id) LEFT JOIN b USING (document_id)"""

_NAMES = "stable_ids access_lookups relevance_upsert review_decisions ingestion_listing rate_limit_retry exact_percentiles ranked_results".split()
QUERIES = {n: globals()[n] for n in _NAMES}
SQL = dict(zip(_NAMES, (IDS_SQL, ACCESS_SQL, RELEVANCE_SQL, DECISION_SQL, LIST_SQL, RETRY_SQL, PERCENTILE_SQL, RANKED_SQL), strict=True))
