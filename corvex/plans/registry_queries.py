"""Queries over the registry: eligibility, readiness, flags, queues, drafts, reviews, and the hybrid pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvex.functions import registry as reg
from corvex.operators import evaluate, search
from corvex.operators.relational import first_per_key
from corvex.sources.tables import CORPUS_SQL, corpus, pages, table


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    """Corpus rows with registry columns derived from ids and labels."""
    pick = lambda values, n: F.get(F.array(*[F.lit(v) for v in values]), (F.col("doc_id") % n).cast("int"))
    return (
        corpus(spark, folder)
        .join(table(spark, folder, "labels"), "doc_id", "left")
        .withColumns(
            {
                "acquisition": pick(("downloaded", "downloaded", "missing", "failed_http"), 4),
                "extraction": pick(("text_extracted", "ocr_required", "extract_failed"), 3),
                "ocr_required": F.col("doc_id") % 10 == 3,
                "quality_score": F.col("quality") * 0.5 + 0.2,
                "ocr_status": F.when(F.col("doc_id") % 6 == 1, "ocr_completed_full"),
                "ocr_chars": (F.col("doc_id") % 12 - 1).cast("int"),
                "source_name": pick(("GOV_GAZETTES", "PARL_GOV_BILLS", "PARL_HANSARD_1", "LANKALAW_NET", "commentary_x", "other"), 6),
            }
        )
    )


_REG_SQL = f"""{CORPUS_SQL}, r AS (SELECT corpus.*, quality, ['downloaded', 'downloaded', 'missing', 'failed_http'][(doc_id % 4 + 1)::INT] AS acquisition, ['text_extracted', 'ocr_required', 'extract_failed'][(doc_id % 3 + 1)::INT] AS extraction, doc_id % 10 = 3 AS ocr_required, quality * 0.5 + 0.2 AS quality_score,
 CASE WHEN doc_id % 6 = 1 THEN 'ocr_completed_full' END AS ocr_status, (doc_id % 12 - 1)::INT AS ocr_chars, ['GOV_GAZETTES', 'PARL_GOV_BILLS', 'PARL_HANSARD_1', 'LANKALAW_NET', 'commentary_x', 'other'][(doc_id % 6 + 1)::INT] AS source_name FROM corpus LEFT JOIN labels USING (doc_id))"""


def registry_status(spark: SparkSession, folder: str) -> DataFrame:
    """Eligibility, readiness, status, category and reliability of each row."""
    c = F.col
    return _rows(spark, folder).select(
        "document_id",
        reg.eligible(c("language"), c("acquisition"), c("extraction"), c("ocr_required"), c("quality_score"), c("source_name")).alias("eligible"),
        reg.ready_text(c("extraction"), c("ocr_required"), c("quality_score"), c("ocr_status"), c("ocr_chars")).alias("ready"),
        reg.needs_ocr(c("extraction"), c("ocr_required"), c("ocr_status"), c("ocr_chars")).alias("needs_ocr"),
        reg.ingestion_status(c("acquisition"), c("extraction")).alias("status"),
        reg.category(c("source_name"), c("document_type")).alias("category"),
        reg.reliability_tier(c("source_name"), F.when(c("doc_id") % 12 == 5, "https://documents.gov.lk/x")).alias("tier"),
    )


REGISTRY_SQL = f"""WITH {_REG_SQL}, o AS (SELECT *, coalesce(ocr_status IS NOT NULL AND ocr_chars > 0, false) AS done FROM r)
SELECT document_id, acquisition = 'downloaded' AND language = 'en' AND extraction = 'text_extracted' AND NOT ocr_required AND coalesce(quality_score, 0) >= 0.10 AND NOT contains(source_name, 'GAZETTE') AS eligible,
 done OR (extraction = 'text_extracted' AND NOT ocr_required AND coalesce(quality_score, 1) >= 0.60) AS ready, NOT done AND (extraction = 'ocr_required' OR ocr_required) AS needs_ocr,
 CASE WHEN acquisition = 'downloaded' AND extraction = 'text_extracted' THEN 'extracted' WHEN acquisition = 'downloaded' THEN 'downloaded' WHEN acquisition = 'missing' THEN 'skipped' ELSE 'failed' END AS status,
 CASE WHEN source_name = 'GOV_GAZETTES' THEN '01_ordinary_gazettes' WHEN source_name = 'PARL_GOV_BILLS' THEN '04_government_bills' WHEN contains(document_type, 'Supreme Court') THEN '05_supreme_court' WHEN contains(document_type, 'Court of Appeal') THEN '06_court_of_appeal' WHEN starts_with(source_name, 'PARL_HANSARD') THEN '07_hansard' WHEN document_type IN ('Act', 'Constitution') THEN '03_legislation_acts_constitution' WHEN source_name = 'LANKALAW_NET' THEN '15_lankalaw_library' ELSE '99_other' END AS category,
 CASE WHEN starts_with(lower(source_name), 'gov') OR starts_with(lower(source_name), 'parl') THEN 'official' WHEN doc_id % 12 = 5 THEN 'official' WHEN source_name = 'LANKALAW_NET' THEN 'licensed_publisher' WHEN source_name = 'commentary_x' THEN 'secondary' ELSE 'unverified' END AS tier FROM o"""


def page_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of page flags by method, with OCR and text quality summed."""
    rows = pages(spark, folder)
    flags = reg.page_flags(F.col("text"), F.when(F.col("page_number") % 9 == 0, "e"), F.col("extraction_method"), F.col("ocr_confidence"))
    rows = rows.select("extraction_method", F.explode(F.concat(flags, F.array(F.lit("all")))).alias("flag"), reg.ocr_quality(F.coalesce(F.col("ocr_confidence") * 100, F.lit(90.0)), F.length("text"), F.lit(1)).alias("q"), reg.page_text_quality(F.length(F.trim("text")), F.lit(1)).alias("t"))
    return rows.groupBy("extraction_method", "flag").agg(F.count("*").alias("n"), F.round(F.sum("q"), 3).alias("ocr_quality"), F.round(F.sum("t"), 3).alias("text_quality"))


FLAGS_SQL = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents), b AS (SELECT doc_id, (line // 6 + 1)::INT AS p, string_agg(t, chr(10) ORDER BY line) AS text FROM l GROUP BY 1, 2),
pg AS (SELECT *, 'text_layer' AS m, NULL::DOUBLE AS c FROM b UNION ALL SELECT doc_id, p, translate(text, 'e', 'c'), 'ocr', 0.6 + (doc_id % 40) / 100 FROM b WHERE doc_id % 3 = 0),
f AS (SELECT m, unnest(list_filter(['all', CASE WHEN p % 9 = 0 THEN 'page_extraction_error' END, CASE WHEN length(trim(text)) = 0 THEN 'empty_page_text' END, CASE WHEN m = 'ocr' AND c * 100 < 70 THEN 'low_confidence_ocr' END, CASE WHEN length(trim(text)) < 25 THEN 'very_short_page_text' END], lambda x: x IS NOT NULL)) AS flag,
 CASE WHEN length(text) = 0 THEN 0 ELSE round(least(least(1.0, coalesce(c * 100, 90) / 100), CASE WHEN length(text) >= 500 THEN 1.0 WHEN length(text) >= 100 THEN 0.6 ELSE 0.25 END), 4) END AS q, CASE WHEN length(trim(text)) = 0 THEN 0 WHEN length(trim(text)) < 100 THEN 0.25 WHEN length(trim(text)) < 500 THEN 0.6 ELSE 0.9 END AS t FROM pg)
SELECT m AS extraction_method, flag, count(*) AS n, round(sum(q), 3)::DOUBLE AS ocr_quality, round(sum(t), 3)::DOUBLE AS text_quality FROM f GROUP BY 1, 2"""


def recovery_queue(spark: SparkSession, folder: str) -> DataFrame:
    """Documents to recover: none of their labels is good, they have pages, and no version is there; by language."""
    docs, labels = corpus(spark, folder), table(spark, folder, "labels")
    good = labels.where("quality = 1")
    queue = docs.where("length(text) > 100").join(good, "doc_id", "left_anti").join(labels.select("doc_id").distinct(), "doc_id", "left_semi").where(~F.col("source_id").like("src1%"))
    translate = docs.where(F.col("language").isin("fr", "de")).where("trim(text) <> ''").join(labels.where("toxic = 0"), "doc_id", "left_anti")
    count = lambda rows, k: rows.groupBy("language").agg(F.count("*").alias("n")).select(F.lit(k).alias("queue"), "language", "n")
    return count(queue, "recovery").unionByName(count(translate, "translation"))


QUEUE_SQL = """SELECT 'recovery' AS queue, lang AS language, count(*) AS n FROM documents d WHERE length(text) > 100 AND source NOT LIKE 'src1%' AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1) GROUP BY 2
UNION ALL SELECT 'translation', lang, count(*) FROM documents d WHERE lang IN ('fr', 'de') AND trim(text) <> '' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 0) GROUP BY 2"""


def text_version_sync(spark: SparkSession, folder: str) -> DataFrame:
    """What becomes of each text version, counted, and the chain of fallbacks for chunks without a version."""
    docs = corpus(spark, folder).join(table(spark, folder, "labels").select("doc_id", "quality"), "doc_id", "left")
    status = reg.sync_status(F.col("quality"), F.when(F.col("doc_id") % 8 == 0, 0).otherwise(F.length("text")), F.when(F.col("doc_id") % 3 == 0, F.md5("text")), F.md5("text"))
    version = F.coalesce(F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("own_"), "doc_id")), F.when(F.col("quality") == 1, F.concat(F.lit("label_"), "doc_id")), F.lit("current"))
    return docs.select(status.alias("status"), F.split_part(version, F.lit("_"), F.lit(1)).alias("version")).groupBy("status", "version").agg(F.count("*").alias("n"))


SYNC_SQL = """WITH d AS (SELECT documents.*, quality FROM documents LEFT JOIN labels USING (doc_id)) SELECT CASE WHEN quality IS NULL THEN 'missing_source_asset' WHEN doc_id % 8 = 0 OR length(text) = 0 THEN 'no_page_text' WHEN doc_id % 3 = 0 THEN 'skipped_current' ELSE 'synced' END AS status, CASE WHEN doc_id % 4 = 0 THEN 'own' WHEN quality = 1 THEN 'label' ELSE 'current' END AS version, count(*) AS n FROM d GROUP BY 1, 2"""


def intake_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Signals that intake texts lack; sample sentences are put in by turn number."""
    samples = ["We act for the plaintiff since 2019", "Alpha Limited v. Beta", "SC Appeal No. 12", "nothing"]
    text = F.concat_ws(" ", "text", F.get(F.array(*map(F.lit, samples)), ((F.col("conv_id") + F.col("turn")) % 4).cast("int")))
    return table(spark, folder, "conversations").select("conv_id", "turn", F.array_join(reg.missing_signals(text), "|").alias("missing"))


_INTAKE = ", ".join(f"CASE WHEN NOT regexp_matches(t, '{p}') THEN '{c}' END" for c, p in reg.INTAKE)
INTAKE_SQL = f"WITH c AS (SELECT conv_id, turn, text || ' ' || ['We act for the plaintiff since 2019', 'Alpha Limited v. Beta', 'SC Appeal No. 12', 'nothing'][((conv_id + turn) % 4 + 1)::INT] AS t FROM conversations) SELECT conv_id, turn, array_to_string(list_filter([{_INTAKE}], lambda x: x IS NOT NULL), '|') AS missing FROM c"


def cited_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Answers whose uncited sentences get citations; references beyond the pack."""
    rows = table(spark, folder, "supplier").select("s_suppkey", F.concat(F.lit("First point. Second point p_item_00"), F.col("s_suppkey") % 4 + 1, F.lit(". Third!")).alias("answer"), F.array(F.lit("p_item_001"), F.lit("p_item_002")).alias("allowed"))
    found = F.regexp_extract_all("answer", F.lit(reg.ITEM_RE), F.lit(1))
    return rows.select("s_suppkey", reg.cite_sentences(F.col("answer"), F.col("allowed")).alias("answer"), F.array_join(F.array_except(found, "allowed"), "|").alias("unknown"))


CITED_SQL = """WITH a AS (SELECT s_suppkey, s_suppkey % 4 + 1 AS k FROM supplier) SELECT s_suppkey, CASE WHEN k <= 2 THEN 'First point. [p_item_00' || k || '] Second point p_item_00' || k || '. Third! [p_item_00' || k || ']' ELSE 'First point. [p_item_001] [p_item_002] Second point p_item_00' || k || '. Third! [p_item_001] [p_item_002]' END AS answer, CASE WHEN k > 2 THEN 'p_item_00' || k ELSE '' END AS unknown FROM a"""


def translation_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with blank lines between their lines, packed by characters: chunks, characters, longest."""
    rows = corpus(spark, folder).select("doc_id", reg.pack_paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n")), 600).alias("c"))
    return rows.select("doc_id", F.size("c").alias("n"), F.aggregate("c", F.lit(0), lambda a, x: a + F.length(x)).alias("chars"), F.coalesce(F.array_max(F.transform("c", F.length)), F.lit(0)).alias("longest"))


def review_queue(spark: SparkSession, folder: str) -> DataFrame:
    """Open reviews by priority and age, a page of 25, with the newest decision of each."""
    orders = table(spark, folder, "orders")
    last = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_returnflag", F.struct("l_shipdate", "l_linenumber", "l_returnflag")).alias("decision"))
    place = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).when(F.col("o_orderpriority") == "3-MEDIUM", 2).otherwise(3)
    rows = orders.where("o_orderstatus = 'O'").join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select("o_orderkey", place.alias("place"), F.coalesce("decision", F.lit("none")).alias("decision"), "o_orderdate").orderBy("place", "o_orderdate", "o_orderkey").limit(25).drop("o_orderdate")


REVIEW_SQL = """WITH l AS (SELECT l_orderkey, arg_max(l_returnflag, (l_shipdate, l_linenumber, l_returnflag)) AS decision FROM lineitem GROUP BY 1) SELECT o_orderkey, (CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END)::INT AS place, coalesce(decision, 'none') AS decision FROM orders LEFT JOIN l ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O' ORDER BY place, o_orderdate, o_orderkey LIMIT 25"""


def child_versions(spark: SparkSession, folder: str) -> DataFrame:
    """The next version of each parent: one more than the larger of its own and its children's."""
    c = table(spark, folder, "conversations")
    parent, child = c.where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("p")), c.where("role <> 'user'").groupBy("conv_id").agg(F.max("turn").alias("k"))
    return parent.join(child, "conv_id", "left").select("conv_id", (F.greatest("p", F.coalesce("k", F.lit(0))) + 1).alias("next_version"))


VERSION_SQL = "SELECT conv_id, greatest(max(turn) FILTER (role = 'user'), coalesce(max(turn) FILTER (role <> 'user'), 0)) + 1 AS next_version FROM conversations GROUP BY 1 HAVING count(*) FILTER (role = 'user') > 0"


def evidence_assessment(spark: SparkSession, folder: str) -> DataFrame:
    """Claims, citations, items and anchors in a four-way join with counts of each claim."""
    items, orders, parts, suppliers = (table(spark, folder, t) for t in ("lineitem", "orders", "part", "supplier"))
    rows = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(suppliers.select("s_suppkey", "s_acctbal").where("s_acctbal > 0"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return rows.groupBy("o_orderkey").agg(F.count("*").alias("citations"), F.countDistinct("p_brand").alias("sources"), F.count("s_suppkey").alias("anchored"), F.round(F.max("l_discount"), 4).alias("confidence"))


ASSESS_SQL = "SELECT o_orderkey, count(*) AS citations, count(DISTINCT p_brand) AS sources, count(s_suppkey) AS anchored, round(max(l_discount), 4) AS confidence FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal > 0 GROUP BY 1"


def exact_citations(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks made from parts that cite an act and a section, ranked."""
    chunks = table(spark, folder, "part").select(F.col("p_partkey").alias("chunk_id"), F.concat(F.lit("Act No. "), F.col("p_size"), F.lit(" of 1985")).alias("title"), F.concat(F.lit("see section "), F.col("p_partkey") % 30, F.lit("(1) here")).alias("text"), (F.col("p_size") % 9 + 1).cast("int").alias("authority_level"), (1950 + F.col("p_partkey") % 60).cast("int").alias("year"), F.lit(1).alias("page_start"), F.col("p_partkey").alias("chunk_index"))
    found = search.exact_citation(chunks, [(str(n), 1985) for n in (7, 12, 33)], ["5(1)", "11(1)"], [])
    return found.select("chunk_id", "rank", "score")


EXACT_SQL = """SELECT p_partkey AS chunk_id, (row_number() OVER w)::INT AS rank, 1000.0 - row_number() OVER w AS score FROM part WHERE p_size IN (7, 12, 33) AND p_partkey % 30 IN (5, 11) WINDOW w AS (ORDER BY p_size % 9 + 1, 1950 + p_partkey % 60 DESC, p_partkey) ORDER BY rank LIMIT 50"""


def evaluation_gates(spark: SparkSession, folder: str) -> DataFrame:
    """Recall of benchmark items in their five best documents by common runs of eight words; whether it reaches its gate.

    Expected are the documents that hold an item's whole text.  The set must have an adverse case (every third item).
    """
    words = lambda c: F.regexp_extract_all(c, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    runs = lambda w: F.when(F.size(w) >= 8, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - 7), lambda i: F.xxhash64(F.array_join(F.slice(w, i, 8), " ")))))
    bench, docs = table(spark, folder, "benchmark"), corpus(spark, folder)
    # The words are a column of their own, so that the runs don't find them anew.
    asked = bench.select("item_id", words("text").alias("w")).select("item_id", F.explode(runs(F.col("w"))).alias("run"))
    held = docs.select("document_id", words("text").alias("w")).select("document_id", F.explode(runs(F.col("w"))).alias("run"))
    common = held.join(asked, "run").groupBy("item_id", "document_id").agg(F.count("*").alias("n"))
    both = common.join(bench.select("item_id", F.col("text").alias("wanted")), "item_id").join(docs.select("document_id", "text"), "document_id")
    both = both.select("item_id", "document_id", "n", F.contains("text", "wanted").alias("holds"))
    best = first_per_key(both, ["item_id"], F.col("n").desc(), F.col("document_id"), n=5)
    ranked = best.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct(-F.col("n"), "document_id"))).alias("r"))
    cases = both.where("holds").groupBy("item_id").agg(F.array_sort(F.collect_set("document_id")).alias("expected")).join(ranked, "item_id")
    cases = cases.select(F.col("item_id").alias("query_id"), "expected", F.col("r.document_id").alias("ranked"))
    rows = evaluate.metrics(cases, 5)
    return rows.agg(F.count("*").alias("cases"), F.round(F.avg("recall"), 6).alias("recall"), F.sum(F.size("missing")).alias("missing"), (F.avg("recall") >= 0.9).alias("passes"), F.max(F.col("query_id") % 3 == 0).alias("has_adverse"))


_RUNS = r"""list_distinct(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' ')))"""
GATES_SQL = rf"""WITH b AS (SELECT item_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM benchmark), d AS (SELECT 'doc_' || doc_id AS document_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
a AS (SELECT item_id, unnest({_RUNS}) AS run FROM b WHERE len(w) >= 8), h AS (SELECT document_id, unnest({_RUNS}) AS run FROM d WHERE len(w) >= 8),
c AS (SELECT item_id, document_id, count(*) AS n FROM a JOIN h USING (run) GROUP BY 1, 2),
r AS (SELECT c.*, contains(d.text, b.text) AS holds, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, document_id) AS k FROM c JOIN b USING (item_id) JOIN d USING (document_id)),
e AS (SELECT item_id, count(*) FILTER (holds) AS expected, count(*) FILTER (holds AND k <= 5) AS found FROM r GROUP BY 1 HAVING count(*) FILTER (holds) > 0)
SELECT count(*) AS cases, round(avg(found / expected), 6) AS recall, sum(expected - found)::BIGINT AS missing, avg(found / expected) >= 0.9 AS passes, max(item_id % 3 = 0) AS has_adverse FROM e"""

_NAMES = "registry_status page_flags recovery_queue text_version_sync intake_signals cited_answers translation_chunks review_queue child_versions evidence_assessment exact_citations evaluation_gates".split()
QUERIES = {n: globals()[n] for n in _NAMES}
SQL = {"registry_status": REGISTRY_SQL, "page_flags": FLAGS_SQL, "recovery_queue": QUEUE_SQL, "text_version_sync": SYNC_SQL, "intake_signals": INTAKE_SQL, "cited_answers": CITED_SQL, "review_queue": REVIEW_SQL, "child_versions": VERSION_SQL, "evidence_assessment": ASSESS_SQL, "exact_citations": EXACT_SQL, "evaluation_gates": GATES_SQL}
