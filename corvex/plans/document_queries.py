"""Queries over pages, chunks, anchors, HTML, packs and streams."""

from __future__ import annotations



from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvex.functions import html, registry as reg, text as tx
from corvex.operators import chunking
from corvex.sources import files
from corvex.sources.tables import corpus, pages, table
from corvex.streaming import rates


def chunk_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of all documents' best pages."""
    return chunking.chunk_pages(chunking.best_pages(pages(spark, folder))).drop("chunk_text").withColumn("quality_flags", F.array_join("quality_flags", "|"))


def source_anchors(spark: SparkSession, folder: str) -> DataFrame:
    """The place of a quotation of 40 characters on each document's pages."""
    quotes = corpus(spark, folder).where("length(text) > 200").select("document_id", F.col("document_id").alias("quote_id"), F.regexp_replace(F.substring("text", 101, 40), r"\s+", " ").alias("selected_text"))
    return chunking.anchors(chunking.best_pages(pages(spark, folder)), quotes)


def text_versions(spark: SparkSession, folder: str) -> DataFrame:
    """The current text version of each document: joined pages, their methods, mean confidence and band, all flags."""
    rows = pages(spark, folder).withColumn("ocr_confidence", 100 * F.col("ocr_confidence"))
    flags = reg.page_flags(F.col("text"), F.when(F.col("page_number") % 9 == 0, "e"), F.col("extraction_method"), F.col("ocr_confidence") / 100)
    found = chunking.text_versions(rows.withColumn("quality_flags", flags))
    return found.drop("full_text").withColumn("quality_flags", F.array_join("quality_flags", "|"))


VERSIONS_SQL = r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
b AS (SELECT doc_id, (line // 6 + 1)::INT AS page_number, string_agg(t, chr(10) ORDER BY line) AS text FROM l GROUP BY 1, 2),
p AS (SELECT *, 'text_layer' AS m, NULL::DOUBLE AS c FROM b UNION ALL SELECT doc_id, page_number, translate(text, 'e', 'c'), 'ocr', 100 * (0.6 + doc_id % 40 / 100) FROM b WHERE doc_id % 3 = 0),
n AS (SELECT *, length(array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '[ 	]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))) AS k, regexp_replace(text, '^[ 	

]+|[ 	

]+$', '', 'g') AS s,
  [CASE WHEN page_number % 9 = 0 THEN 'page_extraction_error' END, CASE WHEN length(trim(text)) = 0 THEN 'empty_page_text' END, CASE WHEN m = 'ocr' AND c < 70 THEN 'low_confidence_ocr' END, CASE WHEN length(trim(text)) < 25 THEN 'very_short_page_text' END] AS flags FROM p),
r AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY doc_id, page_number ORDER BY k DESC, CASE m WHEN 'text_layer' THEN 4 ELSE 3 END DESC, c DESC NULLS LAST, m) = 1),
v AS (SELECT doc_id, count(*)::INT AS page_count, string_agg(s, chr(10) || chr(10) ORDER BY page_number) FILTER (s <> '') AS t, array_to_string(list_sort(list_distinct(list(m))), '+') AS extraction_method, round(avg(c) FILTER (m = 'ocr'), 2) AS mean, flatten(list(flags)) AS flags FROM r GROUP BY 1)
SELECT 'doc_' || doc_id AS document_id, page_count, length(t)::INT AS char_count, sha256(t) AS text_hash, extraction_method, mean AS ocr_confidence_mean, CASE WHEN mean >= 85 THEN 'high' WHEN mean >= 70 THEN 'medium' WHEN mean IS NOT NULL THEN 'low' END AS ocr_confidence_band,
  coalesce(array_to_string(list_sort(list_distinct(list_filter(flags, lambda x: x IS NOT NULL))), '|'), '') AS quality_flags FROM v WHERE t IS NOT NULL"""


def html_text(spark: SparkSession, folder: str) -> DataFrame:
    """Visible text of each page: length, hash, start."""
    rows = table(spark, folder, "pages").select("page_id", html.strip_tags(F.col("html")).alias("t"))
    return rows.select("page_id", F.length("t").alias("n"), F.sha2("t", 256).alias("hash"), F.substring("t", 1, 60).alias("start"))


def _sql_strip(x: str) -> str:
    for p in ("(?is)<script.*?</script>", "(?is)<style.*?</style>", "(?s)<!--.*?-->", "(?s)<[^>]*>"):
        x = f"regexp_replace({x}, '{p}', ' ', 'g')"
    for entity, char in html.ENTITIES:
        x = f"replace({x}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


HTML_SQL = f"WITH t AS (SELECT page_id, {_sql_strip('html')} AS t FROM pages) SELECT page_id, length(t)::INTEGER AS n, sha256(t) AS hash, substr(t, 1, 60) AS start FROM t"


def html_links(spark: SparkSession, folder: str) -> DataFrame:
    """All links of all pages with their ids and file names."""
    return html.listing(table(spark, folder, "pages"), "page_id")


_LINK_SQL = html._LINK.replace("'", "''")
LINKS_SQL = f"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '{_LINK_SQL}', 1)) AS href, unnest(regexp_extract_all(html, '{_LINK_SQL}', 2)) AS raw, unnest(range(len(regexp_extract_all(html, '{_LINK_SQL}', 1)))) AS position FROM pages)
SELECT page_id, position::INTEGER AS position, href, {_sql_strip('raw')} AS label, substr(sha1(href), 1, 10) AS url_id, url_decode(regexp_extract(regexp_replace(href, '[?#].*$', ''), '([^/]*)$', 1)) AS name FROM l WHERE NOT regexp_matches(href, '^(\\?|#|\\.\\./|/$)')"""


def pack_seal(spark: SparkSession, folder: str) -> DataFrame:
    """Packs of conversations sealed: canonical payload hash, tokens, warnings, number of items."""
    item = F.struct(F.col("role").alias("role"), F.col("text").alias("text"), F.col("turn").alias("turn"))
    rows = table(spark, folder, "conversations").withColumn("tokens", tx.estimate_tokens(F.col("text")))
    packs = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("item")))), lambda x: x["item"]).alias("items"), F.sum("tokens").alias("token_count"), F.count_if(F.col("tokens") < 20).alias("short"))
    payload = F.to_json(F.struct(F.col("items").alias("items"), F.col("conv_id").alias("pack_id")), {"ignoreNullFields": "false"})
    return packs.select("conv_id", F.sha2(payload, 256).alias("payload_hash"), "token_count", F.size("items").alias("n_items"), F.array_join(F.array_compact(F.array(F.when(F.col("short") > 0, "short_items"), F.when(F.col("token_count") > 500, "over_budget"))), "|").alias("warnings"))


SEAL_SQL = """WITH r AS (SELECT conv_id, turn, '{"role":' || to_json(role) || ',"text":' || to_json(text) || ',"turn":' || turn || '}' AS item, greatest(1, len(regexp_extract_all(text, '\\S+')) * 4 // 3) AS tokens FROM conversations)
SELECT conv_id, sha256('{"items":[' || string_agg(item, ',' ORDER BY turn) || '],"pack_id":' || conv_id || '}') AS payload_hash, sum(tokens)::BIGINT AS token_count, count(*)::INT AS n_items, concat_ws('|', CASE WHEN count(*) FILTER (tokens < 20) > 0 THEN 'short_items' END, CASE WHEN sum(tokens) > 500 THEN 'over_budget' END) AS warnings FROM r GROUP BY 1"""


def pack_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Contract issues of packs, one row for each."""
    rows = table(spark, folder, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.countDistinct("turn").alias("ids"), F.min("turn").alias("first"), F.max("turn").alias("last"), F.count_if(F.length("text") < 30).alias("short"), F.count_if(F.col("role") == "system").alias("system"), F.sum(F.length("text")).alias("chars"))
    tests = {"duplicate_item_ids": F.col("ids") < F.col("n"), "non_canonical_ids": F.col("last") - F.col("first") + 1 != F.col("n"), "missing_text": F.col("short") > 0, "missing_trace": F.col("system") == 0, "over_budget": F.col("chars") > 3000, "single_item": F.col("n") < 2}
    return rows.select("conv_id", F.explode(F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))).alias("issue"))


VALID_SQL = """WITH p AS (SELECT conv_id, count(*) AS n, count(DISTINCT turn) AS ids, min(turn) AS first, max(turn) AS last, count(*) FILTER (length(text) < 30) AS short, count(*) FILTER (role = 'system') AS system, sum(length(text)) AS chars FROM conversations GROUP BY 1)
SELECT conv_id, unnest(list_filter([CASE WHEN ids < n THEN 'duplicate_item_ids' END, CASE WHEN last - first + 1 <> n THEN 'non_canonical_ids' END, CASE WHEN short > 0 THEN 'missing_text' END, CASE WHEN system = 0 THEN 'missing_trace' END, CASE WHEN chars > 3000 THEN 'over_budget' END, CASE WHEN n < 2 THEN 'single_item' END], lambda x: x IS NOT NULL)) AS issue FROM p"""


def evidence_by_stance(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence in four stances, empty ones kept, with the support status that follows from them."""
    stance = F.get(F.array(*map(F.lit, ("supports", "contradicts", "limits", "context"))), (F.col("l_linenumber") % 3).cast("int"))
    rows = table(spark, folder, "lineitem").select("l_orderkey", stance.alias("stance"), "l_quantity")
    by = rows.groupBy("l_orderkey").agg(F.collect_set("stance").alias("s"), F.max("l_quantity").alias("most"))
    has = lambda k: F.array_contains("s", k)  # noqa: E731
    status = F.when(has("supports") & has("contradicts"), "contested").when(has("contradicts"), "contradicted").when(has("supports") & has("limits"), "partly_supported").when(has("supports"), "supported").otherwise("unsupported")
    fixed = spark.createDataFrame([(k,) for k in ("supports", "contradicts", "limits", "context")], "stance string")
    counts = fixed.join(rows.groupBy("stance").agg(F.count("*").alias("n")), "stance", "left").select(F.lit("stance").alias("kind"), F.col("stance").alias("name"), F.coalesce("n", F.lit(0)).alias("n"))
    return counts.unionByName(by.groupBy(status.alias("name")).agg(F.count("*").alias("n")).select(F.lit("status").alias("kind"), "name", "n"))


STANCE_SQL = """WITH r AS (SELECT l_orderkey, ['supports', 'contradicts', 'limits', 'context'][(l_linenumber % 3 + 1)::INT] AS stance FROM lineitem), b AS (SELECT l_orderkey, list(DISTINCT stance) AS s FROM r GROUP BY 1),
st AS (SELECT CASE WHEN list_contains(s, 'supports') AND list_contains(s, 'contradicts') THEN 'contested' WHEN list_contains(s, 'contradicts') THEN 'contradicted' WHEN list_contains(s, 'supports') AND list_contains(s, 'limits') THEN 'partly_supported' WHEN list_contains(s, 'supports') THEN 'supported' ELSE 'unsupported' END AS name FROM b)
SELECT 'stance' AS kind, k AS name, count(r.stance) AS n FROM (SELECT unnest(['supports', 'contradicts', 'limits', 'context']) AS k) LEFT JOIN r ON stance = k GROUP BY k UNION ALL SELECT 'status', name, count(*) FROM st GROUP BY name"""


def requirement_decision(spark: SparkSession, folder: str) -> DataFrame:
    """Requirements by priority: passed, failed, missing, and the decision."""
    orders = table(spark, folder, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "passed").when(F.col("o_orderstatus") == "O", "missing").otherwise("failed")
    rows = orders.groupBy(F.col("o_orderpriority").alias("requirement")).agg(F.count("*").alias("required"), *[F.count_if(status == k).alias(k) for k in ("passed", "missing", "failed")])
    return rows.withColumn("decision", F.when(F.col("failed") > 0, "no_go").when(F.col("missing") > 0, "pending").otherwise("go"))


REQUIRE_SQL = "WITH r AS (SELECT o_orderpriority AS requirement, count(*) AS required, count(*) FILTER (o_orderstatus = 'F') AS passed, count(*) FILTER (o_orderstatus = 'O') AS missing, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS failed FROM orders GROUP BY 1) SELECT *, CASE WHEN failed > 0 THEN 'no_go' WHEN missing > 0 THEN 'pending' ELSE 'go' END AS decision FROM r"


def span_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Share of each text that overlapping spans cover, by a running end over spans in order."""
    from pyspark.sql import Window

    docs = corpus(spark, folder).where("length(text) >= 120").select("doc_id", F.length("text").alias("n"))
    spans = docs.select("doc_id", "n", F.explode(F.array(*[F.struct((F.col("doc_id") * k % 97).cast("int").alias("a"), (F.col("doc_id") * k % 97 + 20 + 5 * k).cast("int").alias("b")) for k in (1, 2, 3)])).alias("s")).select("doc_id", "n", F.least("s.a", "n").alias("a"), F.least("s.b", "n").alias("b"))
    order = Window.partitionBy("doc_id").orderBy("a", "b")
    before = F.coalesce(F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fresh = spans.withColumn("new", F.greatest(F.lit(0), F.col("b") - F.greatest("a", before)))
    out = fresh.groupBy("doc_id").agg(F.round(F.sum("new") / F.max("n"), 4).alias("coverage"))
    return out.withColumn("low", F.col("coverage") < 0.35)


SPAN_SQL = """WITH d AS (SELECT doc_id, length(text) AS n FROM documents WHERE length(text) >= 120), s AS (SELECT doc_id, n, least(n, doc_id * k % 97) AS a, least(n, doc_id * k % 97 + 20 + 5 * k) AS b FROM d, (SELECT unnest([1, 2, 3]) AS k)),
p AS (SELECT doc_id, n, unnest(range(a, b)) AS i FROM s) SELECT doc_id, round(count(DISTINCT i) / max(n), 4) AS coverage, round(count(DISTINCT i) / max(n), 4) < 0.35 AS low FROM p GROUP BY doc_id"""


def metric_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Event counters in the text exposition format."""
    rows = table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("value"))
    return files.prometheus(rows.select(F.lit("events_total").alias("name"), F.create_map(F.lit("type"), "event_type", F.lit("app"), F.lit('a"b')).alias("labels"), "value"))


METRIC_SQL = """SELECT 'events_total{app="a\\"b",type="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY event_type"""


def stream_rate_limit(spark: SparkSession, folder: str) -> DataFrame:
    """Fixed windows of requests counted by a stream over the event files."""
    return rates.run_once(rates.window_counts(rates.read_events(spark, f"{folder}/events.parquet")))


STREAM_SQL = "SELECT user_id, event_type AS route, (floor(epoch(ts) / 3600) * 3600)::BIGINT AS window_start, count(*) AS n, count(*) <= 2 AS allowed FROM events GROUP BY 1, 2, 3"


def stream_daily_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Daily totals kept by a stream."""
    return rates.run_once(rates.daily_totals(rates.read_events(spark, f"{folder}/events.parquet")))


STREAM_DAILY_SQL = "SELECT ts::DATE::VARCHAR AS day, coalesce(event_type, 'unknown') AS metric, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


def filtered_search(spark: SparkSession, folder: str) -> DataFrame:
    """Documents under a conjunction of restrictions that reaches the scan."""
    from corvex.operators import search

    test = search.filters(document_types=["Act", "Gazette", "Bill"], year_from=1995, year_to=2015, language="en")
    return corpus(spark, folder).where(test).groupBy("document_type").agg(F.count("*").alias("n"), F.min("year").alias("first"), F.max("authority_level").alias("level"))


FILTER_SQL = """WITH c AS (SELECT ['Act', 'Constitution', 'Supreme Court Judgment', 'Court of Appeal Judgment', 'Gazette', 'Parliament Paper', 'Law Report', 'Bill'][(substr(source, 4)::INT % 8 + 1)::INT] AS document_type, (1990 + doc_id % 35)::INT AS year, (substr(source, 4)::INT % 9 + 1)::INT AS level FROM documents WHERE lang = 'en')
SELECT document_type, count(*) AS n, min(year) AS first, max(level) AS level FROM c WHERE document_type IN ('Act', 'Gazette', 'Bill') AND year BETWEEN 1995 AND 2015 GROUP BY 1"""


def reading_access(spark: SparkSession, folder: str) -> DataFrame:
    """Orders that customers of a region may see: semi joins over three tables, counts by nation."""
    orders, customers, nations, regions = (table(spark, folder, t) for t in ("orders", "customer", "nation", "region"))
    allowed = nations.join(F.broadcast(regions.where("r_name = 'ASIA' or r_regionkey = 2")), nations["n_regionkey"] == regions["r_regionkey"], "left_semi")
    own = customers.join(F.broadcast(allowed), customers["c_nationkey"] == allowed["n_nationkey"])
    return orders.join(own.select("c_custkey", "n_name"), orders["o_custkey"] == F.col("c_custkey")).groupBy("n_name").agg(F.countDistinct("o_custkey").alias("customers"), F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


ACCESS_SQL = "SELECT n_name, count(DISTINCT o_custkey) AS customers, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' OR r_regionkey = 2 GROUP BY 1"


def workspace_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Cases with their children's counts and newest activity, pre-aggregated and joined to the left."""
    orders, items = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    customers = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    open_orders = orders.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.max("o_orderdate").alias("newest"))
    lines = items.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.count("*").alias("lines"), F.max("l_shipdate").alias("shipped"))
    rows = customers.join(open_orders, F.col("c_custkey") == open_orders["o_custkey"], "left").drop("o_custkey").join(lines, F.col("c_custkey") == lines["o_custkey"], "left")
    return rows.select("c_custkey", "c_mktsegment", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("orders", "open", "lines")], F.greatest("newest", "shipped").cast("date").cast("string").alias("last_activity"))


SNAPSHOT_SQL = """WITH o AS (SELECT o_custkey, count(*) AS orders, count(*) FILTER (o_orderstatus = 'O') AS open, max(o_orderdate) AS newest FROM orders GROUP BY 1), l AS (SELECT o_custkey, count(*) AS lines, max(l_shipdate) AS shipped FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT c_custkey, c_mktsegment, coalesce(orders, 0) AS orders, coalesce(open, 0) AS open, coalesce(lines, 0) AS lines, greatest(newest, shipped)::DATE::VARCHAR AS last_activity FROM customer LEFT JOIN o ON c_custkey = o.o_custkey LEFT JOIN l ON c_custkey = l.o_custkey"""


def context_union(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct ids of two origins and their set algebra by conversation."""
    turns = table(spark, folder, "conversations")
    by = turns.groupBy("conv_id").agg(F.collect_set(F.when(F.col("role") == "user", F.col("turn") % 5)).alias("a"), F.collect_set(F.when(F.col("role") != "user", F.col("turn") % 7)).alias("b"))
    return by.select("conv_id", F.size(F.array_union("a", "b")).alias("both"), F.size(F.array_intersect("a", "b")).alias("common"), F.array_join(F.sort_array(F.array_except("a", "b")), ",").alias("only_a"))


CONTEXT_SQL = "WITH s AS (SELECT conv_id, coalesce(list(DISTINCT turn % 5) FILTER (role = 'user'), []) AS a, coalesce(list(DISTINCT turn % 7) FILTER (role <> 'user'), []) AS b FROM conversations GROUP BY 1) SELECT conv_id, len(list_distinct(list_concat(a, b)))::INT AS both, len(list_intersect(a, b))::INT AS common, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS only_a FROM s"

_NAMES = "chunk_pages source_anchors text_versions html_text html_links pack_seal pack_validation evidence_by_stance requirement_decision span_coverage metric_lines stream_rate_limit stream_daily_rollup filtered_search reading_access workspace_snapshot context_union".split()
QUERIES = {n: globals()[n] for n in _NAMES}
SQL = {"text_versions": VERSIONS_SQL, "pack_seal": SEAL_SQL, "html_text": HTML_SQL, "html_links": LINKS_SQL, "pack_validation": VALID_SQL, "evidence_by_stance": STANCE_SQL, "requirement_decision": REQUIRE_SQL, "span_coverage": SPAN_SQL, "metric_lines": METRIC_SQL, "stream_rate_limit": STREAM_SQL, "stream_daily_rollup": STREAM_DAILY_SQL, "filtered_search": FILTER_SQL, "reading_access": ACCESS_SQL, "workspace_snapshot": SNAPSHOT_SQL, "context_union": CONTEXT_SQL}
