"""Queries over the corpus as tables: audits, coverage, windows, paging, merges, rollups, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvex.functions import classify, rules, text as tx
from corvex.operators import health, relational as rel
from corvex.sources.tables import corpus, pages, table



def searchability_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Classification of each document from pre-aggregated page, version and chunk counts, joined to the left."""
    docs = corpus(spark, folder).select("doc_id", "document_id", "language", F.length("text").alias("n"))
    labels = table(spark, folder, "labels")
    assets = labels.groupBy("doc_id").agg(F.count("*").alias("assets"))
    page_stats = docs.groupBy("doc_id").agg(F.sum(F.ceil(F.col("n") / 2000)).alias("pages"), F.sum(F.when(F.col("n") > 200, 1).otherwise(0)).alias("text_pages"))
    versions = labels.where("quality = 1").groupBy("doc_id").agg(F.count("*").alias("versions"), F.count_if(F.col("toxic") == 0).alias("english"))
    chunks = docs.where("doc_id % 5 <> 0").groupBy("doc_id").agg(F.count("*").alias("chunks"))
    rows = docs
    for other in (assets, page_stats, versions, chunks):
        rows = rows.join(other, "doc_id", "left")
    # Spanish stands in for a language that must be translated.
    language = F.when(F.col("language") == "es", "tamil").otherwise(F.col("language"))
    out = rows.select("document_id", classify.searchability(language, *map(F.col, ("assets", "pages", "text_pages", "versions", "english", "chunks"))).alias("c"), F.coalesce("assets", F.lit(0)).alias("original_asset_count"))
    plan = rules.recovery_plan(F.when(F.col("language") == "es", "tamil").otherwise(F.col("language")), F.col("c.classification"))
    return out.join(docs.select("document_id", "language"), "document_id").select("document_id", "c.*", "original_asset_count", plan["next_action"].alias("next_action"), plan["language_plan"].alias("language_plan"))


_ACTIONS = " ".join("WHEN '{}' THEN '{}'".format(k, v.replace("'", "''")) for k, v in rules.ACTIONS.items())
AUDIT_SQL = f"""WITH a AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1), v AS (SELECT doc_id, count(*) AS n, count(*) FILTER (toxic = 0) AS e FROM labels WHERE quality = 1 GROUP BY 1),
d AS (SELECT doc_id, lang, length(text) AS n FROM documents),
j AS (SELECT d.*, coalesce(a.n, 0) AS assets, ceil(d.n / 2000) AS pages, (d.n > 200)::INT AS tp, coalesce(v.n, 0) AS versions, coalesce(v.e, 0) AS english, (doc_id % 5 <> 0)::INT AS chunks FROM d LEFT JOIN a USING (doc_id) LEFT JOIN v USING (doc_id)),
c AS (SELECT *, CASE WHEN assets = 0 THEN 'needs_original_asset' WHEN pages = 0 THEN 'needs_page_extraction' WHEN tp = 0 THEN 'needs_ocr_or_text_recovery' WHEN versions = 0 THEN 'needs_text_version' WHEN lang = 'es' AND english = 0 THEN 'needs_translation_fallback' WHEN chunks = 0 THEN 'needs_chunk_indexing' ELSE 'fully_searchable' END AS k FROM j)
SELECT 'doc_' || doc_id AS document_id, k AS classification, CASE k WHEN 'needs_original_asset' THEN 'critical' WHEN 'needs_page_extraction' THEN 'high' WHEN 'needs_ocr_or_text_recovery' THEN 'high' WHEN 'needs_text_version' THEN 'high' WHEN 'fully_searchable' THEN 'none' ELSE 'normal' END AS recovery_priority, assets::BIGINT AS original_asset_count,
 CASE k {_ACTIONS} END AS next_action,
 CASE WHEN lang = 'es' THEN '{rules.PLANS["translate"]}' WHEN coalesce(lang, '') NOT IN ('en', 'english', '') THEN '{rules.PLANS["detect"]}' ELSE '{rules.PLANS["original"]}' END AS language_plan FROM c"""


def searchability_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Counts by classification, and the largest gaps by language."""
    rows = searchability_audit(spark, folder).join(corpus(spark, folder).select("document_id", "language"), "document_id")
    total = rows.groupBy("classification").agg(F.count("*").alias("n")).select(F.lit("all").alias("scope"), "classification", "n")
    gaps = rows.where("classification <> 'fully_searchable'").groupBy("language", "classification").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "language", "classification").limit(10)
    return total.unionByName(gaps.select(F.col("language").alias("scope"), "classification", "n"))


AUDIT_SUMMARY_SQL = f"""WITH r AS (SELECT x.*, lang FROM ({AUDIT_SQL}) x JOIN documents ON document_id = 'doc_' || doc_id)
SELECT 'all' AS scope, classification, count(*) AS n FROM r GROUP BY classification UNION ALL
SELECT * FROM (SELECT lang AS scope, classification, count(*) AS n FROM r WHERE classification <> 'fully_searchable' GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 10)"""


def _health_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a corpus, made from those given: pages and chunks of some documents, packs of orders, claims of customers."""
    docs, n = corpus(spark, folder), F.col("doc_id")
    pick = lambda test, value: F.when(test, value)
    documents = docs.select("document_id", F.lit("s3").alias("provider"), F.lit("b").alias("bucket"), pick(n % 40 > 0, F.col("document_id")).alias("object_key"), pick(n % 41 > 0, F.col("document_id")).alias("primary_asset_id"))
    page_rows = docs.where("doc_id % 30 > 0").select("document_id", F.lit(1).alias("page_number"), pick(n % 31 > 0, F.substring("text", 1, 200)).alias("text"))
    text = pick(n % 37 > 0, F.substring("text", 1, 80))
    chunks = docs.where("doc_id % 29 > 0").select("document_id", F.concat(F.lit("chunk_"), "doc_id").alias("chunk_id"), pick(n % 43 > 0, F.col("source_id")).alias("source_id"), "document_type", F.when(n % 47 > 0, "t").otherwise(" ").alias("title"), pick(n % 53 > 0, F.col("authority_level")).alias("authority_level"), (n % 59).cast("int").alias("token_estimate"), pick(n % 61 > 0, F.lit("c")).alias("citation"), text.alias("chunk_text"), F.sha2(F.when(n % 23 > 0, text).otherwise("changed"), 256).alias("text_hash"), pick(n % 2 == 0, (n % 3).cast("int")).alias("page_start"), pick(n % 4 == 0, (n % 3).cast("int")).alias("page_end"))
    orders, items = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    packs = orders.select(F.col("o_orderkey").alias("pack_id"), F.when(F.col("o_orderstatus") == "F", "archived").otherwise("complete").alias("status"))
    claims = table(spark, folder, "customer").select(F.col("c_custkey").alias("claim_id"), F.when(F.col("c_custkey") % 2 == 0, "supported").otherwise("open").alias("support_status"))
    assets = docs.where("doc_id % 19 > 0").select("document_id", F.lit("original").alias("asset_kind"), (n % 17 > 0).alias("is_primary"))
    versions = docs.where("doc_id % 13 > 0").select("document_id", F.concat(F.lit("v"), "doc_id").alias("text_version_id"), F.lit("current-pages-v1").alias("version_label"), pick(n % 11 > 0, F.lit("a")).alias("text_asset_id"))
    digests = docs.where("doc_id % 7 > 0").select("document_id", F.concat(F.lit("v"), "doc_id").alias("text_version_id"), F.explode(F.array(F.lit("original_file"), F.lit("extracted_full_text"))).alias("digest_type"), F.lit("sha256").alias("algorithm"))
    return {
        "documents": documents, "pages": page_rows, "chunks": chunks, "packs": packs, "pack_items": items.where("l_quantity > 25").select(F.col("l_orderkey").alias("pack_id")), "case_packs": orders.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("pack_id"), F.lit("active").alias("status")),
        "claims": claims, "claim_citations": orders.select(F.col("o_custkey").alias("claim_id")), "assets": assets, "digests": digests, "text_versions": versions,
    }


def health_zero_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The checks that should count nothing and the minimum counts, one row each."""
    tables = _health_tables(spark, folder)
    return health.zero_counts(tables).unionByName(health.minimums(tables, {"documents": 100, "pages": 10_000_000, "chunks": 1}))


_CHECKS = {
    "documents_without_pages": "d WHERE has_chunk AND NOT has_page", "documents_without_text_pages": "d WHERE has_chunk AND NOT has_text", "documents_without_chunks": "d WHERE has_text AND NOT has_chunk", "chunked_documents_without_text_pages": "d WHERE has_chunk AND NOT has_text",
    "documents_without_primary_file_asset": "d WHERE doc_id % 19 = 0 OR doc_id % 17 = 0", "documents_without_original_digest": "d WHERE doc_id % 7 = 0", "documents_with_text_pages_without_text_version": "d WHERE has_text AND doc_id % 13 = 0", "documents_without_object_storage_key": "d WHERE doc_id % 40 = 0 OR doc_id % 41 = 0",
    "chunks_with_empty_text": "d WHERE has_chunk AND length(trim(chunk)) = 0", "chunks_missing_citation": "d WHERE has_chunk AND doc_id % 61 = 0", "chunks_missing_required_metadata": "d WHERE has_chunk AND ((doc_id % 43 > 0 AND length(trim(source)) = 0) OR doc_id % 47 = 0 OR doc_id % 53 = 0 OR doc_id % 59 = 0)",
    "chunks_with_invalid_page_anchor": "d WHERE has_chunk AND doc_id % 2 = 0 AND NOT (has_text AND doc_id % 3 = 1)", "active_research_packs_without_items": "orders WHERE o_orderstatus <> 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)",
    "active_case_packs_with_inactive_pack": "orders WHERE o_orderkey % 5 = 0 AND o_orderstatus = 'F'", "supported_claims_without_citations": "customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "text_versions_without_text_asset": "d WHERE doc_id % 13 > 0 AND doc_id % 11 = 0", "text_versions_without_text_digest": "d WHERE doc_id % 13 > 0 AND doc_id % 7 = 0", "chunks_with_wrong_text_hash": "d WHERE has_chunk AND doc_id % 23 = 0 AND chunk IS NOT NULL AND chunk <> 'changed'",
}
HEALTH_SQL = (
    "WITH d AS (SELECT *, doc_id % 29 > 0 AS has_chunk, doc_id % 30 > 0 AS has_page, doc_id % 30 > 0 AND doc_id % 31 > 0 AND coalesce(length(trim(substr(text, 1, 200))), 0) > 0 AS has_text, CASE WHEN doc_id % 37 > 0 THEN substr(text, 1, 80) END AS chunk FROM documents) "
    + " UNION ALL ".join(f"SELECT '{k}' AS check_name, count(*) AS n, count(*) = 0 AS ok FROM {v}" for k, v in _CHECKS.items())
    + " UNION ALL SELECT 'minimum_documents', count(*), count(*) >= 100 FROM d UNION ALL SELECT 'minimum_pages', count(*), count(*) >= 10000000 FROM d WHERE has_page UNION ALL SELECT 'minimum_chunks', count(*), count(*) >= 1 FROM d WHERE has_chunk"
)


def invalid_anchor_range(spark: SparkSession, folder: str) -> DataFrame:
    """Items whose quantity lies in no range of their order (a band anti join on an equi key)."""
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("page"))
    ranges = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 20).cast("int").alias("low"), F.when(F.col("o_orderkey") % 3 > 0, (F.col("o_orderkey") % 20 + 15).cast("int")).alias("high"))
    return rel.outside_ranges(items, ranges, "l_orderkey", "page", "low", "high").groupBy("l_linenumber").agg(F.count("*").alias("n"), F.sum("page").alias("pages"))


RANGE_SQL = """SELECT l_linenumber, count(*) AS n, sum(l_quantity::INT)::BIGINT AS pages FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND l_quantity::INT BETWEEN o_orderkey % 20 AND coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 20 + 15 END, o_orderkey % 20)) GROUP BY 1"""


def item_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Turns inside the ranges of a few conversations (a range join on an equi key)."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn")
    ranges = turns.groupBy("conv_id").agg((F.min("turn") + 1).alias("low"), (F.max("turn") - 1).alias("high"))
    both = turns.join(ranges, "conv_id").where(F.col("turn").between(F.col("low"), F.col("high")))
    return both.groupBy("conv_id").agg(F.count("*").alias("inside"), F.array_join(F.transform(F.sort_array(F.collect_list("turn")), lambda x: x.cast("string")), ",").alias("turns"))


ITEM_PAGES_SQL = """WITH r AS (SELECT conv_id, min(turn) + 1 AS low, max(turn) - 1 AS high FROM conversations GROUP BY 1)
SELECT conv_id, count(*) AS inside, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS turns FROM conversations JOIN r USING (conv_id) WHERE turn BETWEEN low AND high GROUP BY conv_id"""


def latest_version_top1(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's newest event, joined to all users seen (top one of a key)."""
    events = table(spark, folder, "events")
    last = rel.first_per_key(events, ["user_id"], F.col("ts").desc_nulls_last(), F.col("event_id").desc())
    return events.select("user_id").distinct().join(last, "user_id", "left").select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))


LATEST_SQL = "SELECT user_id, event_id, event_type, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) = 1"


def latest_status(spark: SparkSession, folder: str) -> DataFrame:
    """Each order's last status by ship date (arg-max) with support counts."""
    items = table(spark, folder, "lineitem")
    key = F.struct("l_shipdate", "l_linenumber", "l_linestatus")
    return items.groupBy("l_orderkey").agg(F.max_by("l_linestatus", key).alias("status"), F.max("l_linenumber").alias("items"), F.array_join(F.sort_array(F.collect_set("l_returnflag")), "|").alias("flags"))


STATUS_SQL = "SELECT l_orderkey, arg_max(l_linestatus, (l_shipdate, l_linenumber, l_linestatus)) AS status, max(l_linenumber) AS items, array_to_string(list_sort(list_distinct(list(l_returnflag))), '|') AS flags FROM lineitem GROUP BY 1"


def either_match(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers and customers that share a nation or a key, counted by nation (an either-or join)."""
    s = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey", F.col("s_suppkey").alias("sk"))
    c = table(spark, folder, "customer").where("c_custkey % 50 = 0").select("c_custkey", "c_nationkey", F.col("c_custkey").alias("ck"))
    found = rel.join_on_either(s, c, [("s_nationkey", "c_nationkey"), ("sk", "ck")], "s_suppkey", "c_custkey")
    return found.groupBy("c_custkey").agg(F.count("*").alias("n"), F.min("s_suppkey").alias("least"))


EITHER_SQL = "SELECT c_custkey, count(*) AS n, min(s_suppkey) AS least FROM customer JOIN supplier ON s_nationkey = c_nationkey OR s_suppkey = c_custkey WHERE c_custkey % 50 = 0 GROUP BY 1"


def page_preview_listagg(spark: SparkSession, folder: str) -> DataFrame:
    """The first three turns of each conversation in one string of at most 400 characters."""
    rows = rel.first_per_key(table(spark, folder, "conversations"), ["conv_id"], F.col("turn"), n=3)
    return rows.groupBy("conv_id").agg(F.expr("left(listagg(concat(role, ': ', left(text, 150)), ' | ') within group (order by turn), 400)").alias("preview"), F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"))


PREVIEW_SQL = """WITH t AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3)
SELECT conv_id, left(string_agg(role || ': ' || left(text, 150), ' | ' ORDER BY turn), 400) AS preview, count(*) AS n, array_to_string(list_sort(list_distinct(list(role))), ',') AS roles FROM t GROUP BY conv_id"""


def readiness_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """Seven statuses by source, the most documents first, and the totals."""
    rows = corpus(spark, folder).join(table(spark, folder, "labels"), "doc_id", "left")
    ready = F.col("quality") == 1
    aggs = [F.count("*").alias("downloaded"), F.count_if(F.col("quality").isNull()).alias("unlabelled"), F.count_if(ready).alias("ready"), F.count_if(F.col("quality") == 0).alias("not_ready"), F.count_if((F.col("toxic") == 1) & ready).alias("needs_review"), F.count_if(F.length("text") < 200).alias("short"), F.countDistinct("language").alias("languages")]
    by = rows.groupBy("source_id").agg(*aggs)
    total = rows.agg(*aggs).select(F.lit("(all)").alias("source_id"), *[c for c in by.columns if c != "source_id"])
    return by.unionByName(total).orderBy(F.col("downloaded").desc(), "source_id")


READY_SQL = """WITH r AS (SELECT d.*, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id))
SELECT coalesce(source, '(all)') AS source_id, count(*) AS downloaded, count(*) FILTER (quality IS NULL) AS unlabelled, count(*) FILTER (quality = 1) AS ready, count(*) FILTER (quality = 0) AS not_ready, count(*) FILTER (toxic = 1 AND quality = 1) AS needs_review, count(*) FILTER (length(text) < 200) AS short, count(DISTINCT lang) AS languages FROM r GROUP BY GROUPING SETS ((source), ())"""


def mode_category(spark: SparkSession, folder: str) -> DataFrame:
    """Each source's most frequent type of language, of equal ones the first seen; first and last year."""
    docs = corpus(spark, folder)
    counts = docs.groupBy("source_id", "language").agg(F.count("*").alias("n"), F.min("doc_id").alias("seen"))
    best = rel.first_per_key(counts, ["source_id"], F.col("n").desc(), F.col("seen")).select("source_id", F.col("language").alias("modal"), "n")
    return best.join(docs.groupBy("source_id").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year")), "source_id")


MODE_SQL = """WITH d AS (SELECT *, (1990 + doc_id % 35)::INT AS year FROM documents), c AS (SELECT source, lang, count(*) AS n, min(doc_id) AS seen FROM d GROUP BY 1, 2), b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, seen) = 1)
SELECT b.source AS source_id, b.lang AS modal, b.n, min(year) AS first_year, max(year) AS last_year FROM b JOIN d ON d.source = b.source GROUP BY ALL"""


def category_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Counts for a fixed list of categories; those without documents show 0."""
    dims = spark.createDataFrame([(k,) for k in ("en", "fr", "de", "es", "si", "ta")], "category string")
    counts = corpus(spark, folder).groupBy(F.col("language").alias("category")).agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("sources"))
    return dims.join(counts, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("sources", F.lit(0)).alias("sources"))


CATEGORY_SQL = "SELECT c AS category, count(doc_id) AS n, count(DISTINCT source) AS sources FROM (SELECT unnest(['en', 'fr', 'de', 'es', 'si', 'ta']) AS c) LEFT JOIN documents ON lang = c GROUP BY c"


def coverage_by_source_year(spark: SparkSession, folder: str) -> DataFrame:
    """Total, labelled and missing by source and year."""
    rows = corpus(spark, folder).join(table(spark, folder, "labels").select("doc_id", F.lit(1).alias("have")), "doc_id", "left")
    out = rows.groupBy("source_id", "year").agg(F.count("*").alias("total"), F.count("have").alias("downloaded"))
    return out.withColumn("missing", F.col("total") - F.col("downloaded"))


COVERAGE_SQL = "SELECT source AS source_id, (1990 + doc_id % 35)::INT AS year, count(*) AS total, count(l.doc_id) AS downloaded, count(*) - count(l.doc_id) AS missing FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1, 2"


def status_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """Events of each type by day as columns."""
    events = table(spark, folder, "events").withColumn("day", F.to_date("ts").cast("string"))
    kinds = ["signup", "error", "click", "view", "purchase"]
    return events.groupBy("day").pivot("event_type", kinds).agg(F.count("event_id")).select("day", *[F.coalesce(k, F.lit(0)).alias(f"n_{k}") for k in kinds])


PIVOT_SQL = "SELECT ts::DATE::VARCHAR AS day, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS n_{k}" for k in ("signup", "error", "click", "view", "purchase")) + " FROM events GROUP BY 1"


def registry_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of equal texts, and issues of single documents."""
    docs = corpus(spark, folder)
    groups = docs.groupBy(tx.stable_hash(F.col("text")).alias("key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1").select(F.lit("duplicate_text").alias("issue"), "key", "n", "first_id")
    issues = docs.select("doc_id", F.explode(F.array_compact(F.array(F.when(F.length("text") < 80, "short_text"), F.when(~F.col("text").contains("\n"), "one_line"), F.when(F.length("title") < 10, "short_title")))).alias("issue"))
    single = issues.groupBy("issue").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).select("issue", F.lit("").alias("key"), "n", "first_id")
    return groups.unionByName(single)


DUP_SQL = """WITH i AS (SELECT doc_id, unnest(list_filter([CASE WHEN length(text) < 80 THEN 'short_text' END, CASE WHEN NOT contains(text, chr(10)) THEN 'one_line' END, CASE WHEN length(substr(split_part(text, chr(10), 1), 1, 60)) < 10 THEN 'short_title' END], lambda x: x IS NOT NULL)) AS issue FROM documents)
SELECT 'duplicate_text' AS issue, sha256(text) AS key, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1 UNION ALL SELECT issue, '' AS key, count(*) AS n, min(doc_id) AS first_id FROM i GROUP BY issue"""


def index_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and labels that the other side lacks, with totals."""
    found = rel.difference(table(spark, folder, "documents"), table(spark, folder, "labels"), "doc_id")
    return found.groupBy("side").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.sum("doc_id").alias("total"))


DIFF_SQL = "SELECT side, count(*) AS n, min(doc_id) AS least, sum(doc_id)::BIGINT AS total FROM (SELECT doc_id, 'only_left' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'only_right' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) GROUP BY side"


def reconciliation(spark: SparkSession, folder: str) -> DataFrame:
    """Three listings of ids and where each id is missing."""
    a = table(spark, folder, "labels").select("doc_id", F.lit(True).alias("csv"))
    b = table(spark, folder, "documents").where("doc_id % 2 = 0").select("doc_id", F.lit(True).alias("search"))
    c = table(spark, folder, "documents").where("doc_id % 3 = 0").select("doc_id", F.lit(True).alias("manifest"))
    both = a.join(b, "doc_id", "full_outer").join(c, "doc_id", "full_outer")
    has = {k: F.coalesce(k, F.lit(False)) for k in ("csv", "search", "manifest")}
    tests = {"csv_not_search": has["csv"] & ~has["search"], "search_not_csv": has["search"] & ~has["csv"], "listed_not_manifest": (has["csv"] | has["search"]) & ~has["manifest"], "manifest_not_listed": has["manifest"] & ~(has["csv"] | has["search"])}
    return both.agg(*[F.count_if(t).alias(k) for k, t in tests.items()])


RECON_SQL = """WITH a AS (SELECT doc_id FROM labels), b AS (SELECT doc_id FROM documents WHERE doc_id % 2 = 0), c AS (SELECT doc_id FROM documents WHERE doc_id % 3 = 0), u AS (SELECT * FROM a UNION SELECT * FROM b)
SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS csv_not_search, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS search_not_csv, (SELECT count(*) FROM (SELECT * FROM u EXCEPT SELECT * FROM c)) AS listed_not_manifest, (SELECT count(*) FROM (SELECT * FROM c EXCEPT SELECT * FROM u)) AS manifest_not_listed"""


def keyset_page(spark: SparkSession, folder: str) -> DataFrame:
    """The page after a cursor in falling order of value and id."""
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type")
    return rel.keyset_page(events, ["user_id", "event_id"], 25, rel.cursor_of({"user_id": 100, "event_id": 5000}))


KEYSET_SQL = "SELECT event_id, user_id, event_type FROM events WHERE (user_id, event_id) < (100, 5000) ORDER BY user_id DESC, event_id DESC LIMIT 26"


def offset_page(spark: SparkSession, folder: str) -> DataFrame:
    """The third page of orders by priority and price, and whether more follow."""
    place = F.when(F.col("o_orderpriority").startswith("1"), 0).when(F.col("o_orderpriority").startswith("2"), 1).otherwise(2)
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", place.alias("p"))
    return rel.offset_page(rows, 20, 40, F.col("p"), F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey")).select("o_orderkey", "p", "has_more")


OFFSET_SQL = "SELECT o_orderkey, (CASE WHEN starts_with(o_orderpriority, '1') THEN 0 WHEN starts_with(o_orderpriority, '2') THEN 1 ELSE 2 END)::INT AS p, (SELECT count(*) FROM orders) > 60 AS has_more FROM orders ORDER BY p, o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 40"


def recent_turns(spark: SparkSession, folder: str) -> DataFrame:
    """The last four turns of each conversation in rising order, with their place."""
    last = rel.first_per_key(table(spark, folder, "conversations"), ["conv_id"], F.col("turn").desc(), n=4)
    return last.select("conv_id", "turn", "role", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("place"), F.substring("text", 1, 40).alias("preview"))


RECENT_SQL = "SELECT conv_id, turn, role, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS place, substr(text, 1, 40) AS preview FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4)"


def rate_limit_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Fixed windows of an hour by user and route: count, whether allowed, when the window ends."""
    start = (F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600) * 3600).cast("long")
    rows = table(spark, folder, "events").groupBy("user_id", F.col("event_type").alias("route"), start.alias("window_start")).agg(F.count("*").alias("n"))
    return rows.select("user_id", "route", "window_start", "n", (F.col("n") <= 2).alias("allowed"), (F.col("window_start") + 3600).alias("reset"))


RATE_SQL = "WITH w AS (SELECT user_id, event_type AS route, (floor(epoch(ts) / 3600) * 3600)::BIGINT AS window_start, count(*) AS n FROM events GROUP BY 1, 2, 3) SELECT user_id, route, window_start, n, n <= 2 AS allowed, window_start + 3600 AS reset FROM w"


def daily_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and sums by day and type inside a range, after the retention cutoff."""
    events = table(spark, folder, "events").where("ts >= timestamp_ntz'2024-01-05' and ts < timestamp_ntz'2024-01-12'")
    kind = F.coalesce("event_type", F.lit("unknown"))
    return events.groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).cast("date").cast("string").alias("day"), kind.alias("metric")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.sha2(F.first(kind), 256).alias("label_hash"))


DAILY_SQL = "SELECT ts::DATE::VARCHAR AS day, coalesce(event_type, 'unknown') AS metric, count(*) AS n, round(sum(value), 4) AS total, sha256(coalesce(any_value(event_type), 'unknown')) AS label_hash FROM events WHERE ts >= '2024-01-05' AND ts < '2024-01-12' GROUP BY 1, 2"


def event_json_extract(spark: SparkSession, folder: str) -> DataFrame:
    """A JSON field, a rebuilt object and its hash, by value of the field."""
    rows = table(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), "event_type")
    made = F.to_json(F.struct(F.col("event_type").alias("a"), F.col("k").alias("k")), {"ignoreNullFields": "false"})
    return rows.select("event_id", "k", made.alias("object"), F.sha2(made, 256).alias("hash"))


JSON_SQL = """WITH e AS (SELECT event_id, (props->>'$.k')::INT AS k, event_type FROM events), m AS (SELECT event_id, k, '{"a":"' || event_type || '","k":' || k || '}' AS object FROM e) SELECT event_id, k, object, sha256(object) AS hash FROM m"""


def argmax_band(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's best event by value with a band, and distinct types."""
    rows = table(spark, folder, "events").where("value is not null")
    out = rows.groupBy("user_id").agg(F.max("value").alias("best"), F.max_by("event_id", F.struct("value", "event_id")).alias("event_id"), F.countDistinct("event_type").alias("types"), F.count_if(F.col("event_type") == "purchase").alias("purchases"))
    return out.select("user_id", F.round("best", 4).alias("best"), "event_id", "types", "purchases", classify.relevance_band(F.col("best") / 100).alias("band"))


ARGMAX_SQL = "WITH a AS (SELECT user_id, max(value) AS best, arg_max(event_id, (value, event_id)) AS event_id, count(DISTINCT event_type) AS types, count(*) FILTER (event_type = 'purchase') AS purchases FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT user_id, round(best, 4) AS best, event_id, types, purchases, CASE WHEN best / 100 >= 0.95 THEN 'direct' WHEN best / 100 >= 0.75 THEN 'strong' WHEN best / 100 >= 0.45 THEN 'moderate' WHEN best / 100 >= 0.10 THEN 'weak' ELSE 'none' END AS band FROM a"


def merge_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Two halves of events merged by user: larger value, newer type, first id."""
    events = table(spark, folder, "events")
    side = lambda test: events.where(test).groupBy("user_id").agg(F.round(F.max("value"), 4).alias("value"), F.max_by("event_type", "event_id").alias("kind"), F.min("event_id").alias("first_id"))
    return rel.merge_by_key(side("event_id % 2 = 0 and user_id % 5 <> 1"), side("event_id % 2 = 1 and user_id % 5 <> 2"), ["user_id"], {"value": "greatest", "kind": "fill", "first_id": "first"})


MERGE_SQL = """WITH s AS (SELECT event_id % 2 AS h, user_id, round(max(value), 4) AS value, arg_max(event_type, event_id) AS kind, min(event_id) AS first_id FROM events WHERE (event_id % 2 = 0 AND user_id % 5 <> 1) OR (event_id % 2 = 1 AND user_id % 5 <> 2) GROUP BY 1, 2), o AS (SELECT * FROM s WHERE h = 0), n AS (SELECT * FROM s WHERE h = 1)
SELECT coalesce(o.user_id, n.user_id) AS user_id, greatest(o.value, n.value) AS value, coalesce(nullif(n.kind, ''), o.kind) AS kind, coalesce(o.first_id, n.first_id) AS first_id FROM o FULL JOIN n ON o.user_id = n.user_id"""


def scope_replace(spark: SparkSession, folder: str) -> DataFrame:
    """Insert if absent, replace of scopes, prune of stale rows: sizes and sums."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    old, new = orders.where("o_orderkey % 4 <> 0"), orders.where("o_orderkey % 4 < 2").withColumn("o_orderstatus", F.lit("N"))
    results = {"insert_absent": rel.insert_absent(old, new, ["o_orderkey"]), "replace_scope": rel.replace_scope(old, new, "o_custkey"), "prune_stale": rel.prune_stale(old, new, "o_custkey", F.col("o_orderstatus") == "F")}
    out = None
    for name, rows in results.items():
        row = rows.agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("total"), F.count_if(F.col("o_orderstatus") == "N").alias("fresh")).withColumn("operation", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


SCOPE_SQL = """WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 4 <> 0), n AS (SELECT o_orderkey, o_custkey, 'N' AS o_orderstatus FROM orders WHERE o_orderkey % 4 < 2),
r AS (SELECT 'insert_absent' AS operation, * FROM o UNION ALL SELECT 'insert_absent', * FROM n WHERE o_orderkey NOT IN (SELECT o_orderkey FROM o) UNION ALL SELECT 'replace_scope', * FROM o WHERE o_custkey NOT IN (SELECT o_custkey FROM n) UNION ALL SELECT 'replace_scope', * FROM n
 UNION ALL SELECT 'prune_stale', * FROM o WHERE o_custkey NOT IN (SELECT o_custkey FROM o WHERE o_orderstatus <> 'F' AND o_custkey NOT IN (SELECT o_custkey FROM n)))
SELECT operation, count(*) AS n, sum(o_orderkey)::BIGINT AS total, count(*) FILTER (o_orderstatus = 'N') AS fresh FROM r GROUP BY 1"""


def latency_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Load summary of each route against thresholds."""
    rows = table(spark, folder, "events").where("value is not null")
    out = rows.groupBy(F.col("event_type").alias("route")).agg(F.count("*").alias("n"), *[F.round(F.percentile("value", p), 6).alias(k) for k, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))], F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("most"), F.round(F.avg((F.col("user_id") % 10 == 0).cast("int")), 6).alias("error_rate"))
    return out.withColumn("status", F.when((F.col("p95") <= 750) & (F.col("error_rate") <= 0.5), "pass").otherwise("fail"))


LATENCY_SQL = "SELECT event_type AS route, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(min(value), 6) AS least, round(max(value), 6) AS most, round(avg((user_id % 10 = 0)::INT), 6) AS error_rate, CASE WHEN quantile_cont(value, 0.95) <= 750 AND avg((user_id % 10 = 0)::INT) <= 0.5 THEN 'pass' ELSE 'fail' END AS status FROM events WHERE value IS NOT NULL GROUP BY 1"


def best_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The best extraction of each page: text, then length, then method, then confidence; methods counted by document."""
    rows = pages(spark, folder)
    rank = F.when(F.col("extraction_method") == "text_layer", 4).when(F.col("extraction_method") == "ocr", 3).otherwise(2)
    best = rel.first_per_key(rows.where("page_number > 0"), ["doc_id", "page_number"], F.length(tx.normalize_text(F.col("text"))).desc(), rank.desc(), F.col("ocr_confidence").desc_nulls_last(), F.col("extraction_method"))
    return best.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.sum(F.length("text")).alias("chars"), F.array_join(F.sort_array(F.collect_set("extraction_method")), "+").alias("methods"))


PAGES_SQL = r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
b AS (SELECT doc_id, (line // 6 + 1)::INT AS page_number, string_agg(t, chr(10) ORDER BY line) AS text FROM l GROUP BY 1, 2),
p AS (SELECT *, 'text_layer' AS m, NULL AS c FROM b UNION ALL SELECT doc_id, page_number, translate(text, 'e', 'c'), 'ocr', 0.6 + doc_id % 40 / 100 FROM b WHERE doc_id % 3 = 0),
n AS (SELECT *, length(array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '[ \t]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))) AS k FROM p),
r AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY doc_id, page_number ORDER BY k DESC, CASE m WHEN 'text_layer' THEN 4 ELSE 3 END DESC, c DESC NULLS LAST, m) = 1)
SELECT doc_id, count(*) AS n_pages, sum(length(text))::BIGINT AS chars, array_to_string(list_sort(list_distinct(list(m))), '+') AS methods FROM r GROUP BY 1"""


def eval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Recall, reciprocal rank and gain of ranked lists against expected ids, with means by label."""
    from corvex.operators import evaluate

    cases = table(spark, folder, "orders").select(F.col("o_orderkey").alias("query_id"), F.when(F.col("o_orderkey") % 3 == 0, "adverse").otherwise("supportive").alias("evidence_label"), F.array(*[((F.col("o_custkey") * k) % 9).cast("string") for k in (1, 2)]).alias("expected"), F.array(*[((F.col("o_custkey") * k + k) % 11).cast("string") for k in range(1, 8)]).alias("ranked"))
    return evaluate.by_label(evaluate.metrics(cases, 5))


EVAL_SQL = """WITH c AS (SELECT o_orderkey AS q, CASE WHEN o_orderkey % 3 = 0 THEN 'adverse' ELSE 'supportive' END AS evidence_label, list_distinct([o_custkey % 9, o_custkey * 2 % 9]) AS e, list_slice([(o_custkey + 1) % 11, (o_custkey * 2 + 2) % 11, (o_custkey * 3 + 3) % 11, (o_custkey * 4 + 4) % 11, (o_custkey * 5 + 5) % 11, (o_custkey * 6 + 6) % 11, (o_custkey * 7 + 7) % 11], 1, 5) AS r FROM orders),
m AS (SELECT *, list_transform(r, lambda x: list_contains(e, x)) AS h FROM c),
v AS (SELECT *, len(list_intersect(e, r)) / len(e) AS recall, CASE WHEN list_contains(h, true) THEN 1.0 / list_position(h, true) ELSE 0 END AS rr, list_sum(list_transform(h, lambda x, i: CASE WHEN x THEN 1 / log2(i + 1) ELSE 0 END)) / list_sum(list_transform(range(1, least(5, len(e)) + 1), lambda i: 1 / log2(i + 1))) AS ndcg FROM m)
SELECT evidence_label, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, avg(recall) >= 0.90 AND avg(rr) >= 0.75 AND avg(ndcg) >= 0.75 AS meets_bar FROM v GROUP BY 1"""

_NAMES = "searchability_audit searchability_summary health_zero_counts invalid_anchor_range item_pages latest_version_top1 latest_status either_match page_preview_listagg readiness_by_source mode_category category_summary coverage_by_source_year status_pivot registry_duplicates index_diff reconciliation keyset_page offset_page recent_turns rate_limit_windows daily_rollup event_json_extract argmax_band merge_upsert scope_replace latency_percentiles best_pages eval_metrics".split()
QUERIES = {n: globals()[n] for n in _NAMES}
SQL = dict(zip(_NAMES, (AUDIT_SQL, AUDIT_SUMMARY_SQL, HEALTH_SQL, RANGE_SQL, ITEM_PAGES_SQL, LATEST_SQL, STATUS_SQL, EITHER_SQL, PREVIEW_SQL, READY_SQL, MODE_SQL, CATEGORY_SQL, COVERAGE_SQL, PIVOT_SQL, DUP_SQL, DIFF_SQL, RECON_SQL, KEYSET_SQL, OFFSET_SQL, RECENT_SQL, RATE_SQL, DAILY_SQL, JSON_SQL, ARGMAX_SQL, MERGE_SQL, SCOPE_SQL, LATENCY_SQL, PAGES_SQL, EVAL_SQL), strict=True))
