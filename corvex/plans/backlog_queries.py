"""Queries of backlogs, page loading, tracker and chunk rows, payloads, downloads, listings, reports and case structures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvex.functions import records, structure
from corvex.operators import recovery
from corvex.sources.tables import CORPUS_SQL, corpus, table


def _pick(values: tuple, by: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), by.cast("int"))


def _registry(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with statuses, paths and languages made from their ids."""
    n = F.col("doc_id")
    path = F.concat(F.lit("raw/"), F.when(n % 3 == 0, "English/").otherwise("x/"), F.lit("f"), n, _pick((".pdf", ".zip", ".PDF", ".doc", ".pdf"), n % 5))
    return corpus(spark, folder).withColumns(
        {
            "acquisition_status": F.when(n % 7 == 0, "missing").otherwise("downloaded"),
            "extraction_status": _pick(("text_extracted", "text_empty_needs_ocr", "not_started", "ocr_failed"), n % 4),
            "ocr_required": n % 10 == 3,
            "local_path": F.when(n % 11 > 0, path),
            "language": F.when(F.col("language") == "es", "ta").when(F.col("language") == "fr", "Sinhala").otherwise(F.col("language")),
            "source_document_id": F.concat(F.lit("S:"), n, F.when(n % 6 == 0, ":e").otherwise(":S")),
            "full_text": F.when(n % 13 == 0, " ").otherwise(F.col("text")),
        }
    )


_REGISTRY_SQL = f"""{CORPUS_SQL}, reg AS (SELECT * REPLACE (CASE language WHEN 'es' THEN 'ta' WHEN 'fr' THEN 'Sinhala' ELSE language END AS language), CASE WHEN doc_id % 7 = 0 THEN 'missing' ELSE 'downloaded' END AS acq, ['text_extracted', 'text_empty_needs_ocr', 'not_started', 'ocr_failed'][(doc_id % 4 + 1)::INT] AS ext, doc_id % 10 = 3 AS ocr_required,
  CASE WHEN doc_id % 11 > 0 THEN 'raw/' || CASE WHEN doc_id % 3 = 0 THEN 'English/' ELSE 'x/' END || 'f' || doc_id || ['.pdf', '.zip', '.PDF', '.doc', '.pdf'][(doc_id % 5 + 1)::INT] END AS path, 'S:' || doc_id || CASE WHEN doc_id % 6 = 0 THEN ':e' ELSE ':S' END AS sdi, CASE WHEN doc_id % 13 = 0 THEN ' ' ELSE text END AS full_text FROM corpus)"""


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("doc_id")
    return corpus(spark, folder).where("doc_id % 3 > 0").select("document_id", (n % 2).cast("int").alias("page_number"), F.when(n % 5 == 0, "  ").otherwise(F.substring("text", 1, 50)).alias("text"), F.when(n % 4 == 1, "ocr").otherwise("text_layer").alias("extraction_method"))


def recovery_backlog(spark: SparkSession, folder: str) -> DataFrame:
    """Every document that waits for extraction, OCR, translation or indexing."""
    docs = _registry(spark, folder)
    n = F.col("doc_id")
    chunks = docs.where("doc_id % 9 = 0").select("document_id")
    versions = docs.where("doc_id % 8 = 0").select("document_id", F.lit("translation").alias("text_origin"), F.lit("EN").alias("language"), _pick(("rejected", "reviewed", None), n % 3).alias("translation_review_status"))
    return recovery.queues(docs, _pages(spark, folder), chunks, versions)


BACKLOG_SQL = f"""WITH {_REGISTRY_SQL}, m AS (SELECT *, doc_id % 3 > 0 AS has_page, doc_id % 3 > 0 AND doc_id % 5 > 0 AND length(trim(substr(text, 1, 50))) > 0 AS has_text, doc_id % 4 = 1 AS page_ocr, doc_id % 9 = 0 AS has_chunk, doc_id % 8 = 0 AND doc_id % 3 > 0 AS has_tr FROM reg),
k AS (SELECT *, has_text AND page_ocr AS has_ocr, ext = 'text_empty_needs_ocr' OR ocr_required OR (has_page AND NOT has_text) AS needs, lower(path) AS p FROM m),
q AS (SELECT 'ocr' AS queue, * FROM k WHERE acq = 'downloaded' AND path IS NOT NULL AND (p LIKE '%.pdf' OR p LIKE '%.zip') AND NOT has_chunk AND NOT has_ocr AND needs
UNION ALL SELECT 'extraction', * FROM k WHERE acq = 'downloaded' AND p LIKE '%.pdf' AND NOT has_chunk AND NOT has_page AND ext = 'not_started'
UNION ALL SELECT 'english_ocr', * FROM k WHERE acq = 'downloaded' AND p LIKE '%.pdf' AND ext <> 'ocr_failed' AND NOT has_chunk AND NOT has_ocr AND needs AND (lower(coalesce(language, '')) IN ('english', 'eng', 'en', 'e') OR p LIKE '%/english/%' OR upper(sdi) LIKE '%:E')
UNION ALL SELECT 'index', * FROM k WHERE acq = 'downloaded' AND has_text AND ext IN ('text_extracted', 'text_empty_needs_ocr') AND NOT has_chunk
UNION ALL SELECT 'translation', * FROM k WHERE acq = 'downloaded' AND lower(language) IN ('sinhala', 'sin', 'si', 'tamil', 'tam', 'ta') AND length(trim(full_text)) > 0 AND NOT has_tr)
SELECT queue, document_id, source_id, year FROM q"""


def page_load(spark: SparkSession, folder: str) -> DataFrame:
    """What a load of pages considers, loads and skips, by reason."""
    docs = _registry(spark, folder)
    return recovery.page_load(docs, docs.where("doc_id % 17 > 0"), _pages(spark, folder))[1]


LOAD_SQL = f"""WITH {_REGISTRY_SQL}, r AS (SELECT doc_id % 17 > 0 AS d, doc_id % 3 > 0 AND doc_id % 2 = 1 AS p FROM reg WHERE acq = 'downloaded' AND ext IN ('text_extracted', 'text_empty_needs_ocr'))
SELECT count(*) AS documents_considered, count(*) FILTER (d AND p) AS documents_with_pages, count(*) FILTER (NOT d) AS skipped_missing_document, count(*) FILTER (d AND NOT p) AS skipped_without_pages, count(*) FILTER (d AND p) AS pages_upserted FROM r"""


def chunk_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Typed documents as rows of text, with a hash over all their fields."""
    n = F.col("doc_id")
    rows = _registry(spark, folder).select("document_id", "source_id", "source_document_id", "document_type", "title", "year", F.date_add(F.lit("2020-01-01").cast("date"), (n % 400).cast("int")).alias("document_date"), "language", "local_path", "acquisition_status", "extraction_status", "ocr_required", ((n % 4) / 4).alias("text_quality_score"), F.when(n % 3 == 0, "translation").alias("text_origin"))
    out = records.chunk_rows(rows)
    return out.select("document_id", "date", "ocr_required", "text_quality_score", "text_origin", "source_language", F.sha2(F.concat_ws("|", *records.CHUNK_ROW), 256).alias("row_hash"))


_SCORE = "CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '0.25' WHEN 2 THEN '0.5' ELSE '0.75' END"
_DATE = "(DATE '2020-01-01' + (doc_id % 400)::INT)::VARCHAR"
CHUNK_SQL = f"""WITH {_REGISTRY_SQL} SELECT document_id, {_DATE} AS date, CASE WHEN ocr_required THEN 'True' ELSE '' END AS ocr_required, {_SCORE} AS text_quality_score, CASE WHEN doc_id % 3 = 0 THEN 'translation' ELSE 'source' END AS text_origin, coalesce(language, '') AS source_language,
 sha256(document_id || '|' || source_id || '|' || sdi || '|' || document_type || '|' || coalesce(title, '') || '|' || year || '||' || {_DATE} || '|' || coalesce(language, '') || '|||' || coalesce(path, '') || '||' || acq || '|' || ext || '|' || CASE WHEN ocr_required THEN 'True' ELSE '' END || '|' || {_SCORE} || '|||||||' || CASE WHEN doc_id % 3 = 0 THEN 'translation' ELSE 'source' END || '|' || coalesce(language, '') || '|||') AS row_hash FROM reg"""


def tracker_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Tracker rows of documents that are there, with sources and OCR, and of those that are missing."""
    docs = _registry(spark, folder)
    n = F.col("doc_id")
    notes = F.concat(F.lit("a=1; text_path=t/"), n, F.when(n % 2 == 0, F.concat(F.lit(";pages_path=p/"), n)).otherwise(""))
    rows = docs.withColumns({"notes": notes, "missing_reason": F.lit("gone"), "source_url": F.concat(F.lit("http://h/"), n), "acquisition_status": F.when(n % 14 == 7, records.LICENSED).otherwise(F.col("acquisition_status"))})
    sources = docs.select("source_id").distinct().select("source_id", F.concat(F.lit("Name of "), "source_id").alias("source_name"), F.lit("official").alias("reliability_tier"))
    ocr = docs.where("doc_id % 5 = 1").select("document_id", F.lit("ocr_completed_full").alias("ocr_status"), F.lit("high").alias("confidence_band"), F.concat(F.lit("o/"), "doc_id").alias("ocr_text_path"))
    have = records.have_rows(rows.where("acquisition_status = 'downloaded'"), sources, ocr)
    gaps = records.gap_rows(rows.where("acquisition_status <> 'downloaded'"))
    have = have.select(F.lit("have").alias("tracker"), "document_id", "category_id", "source_name", "reliability_tier", "ocr_status", "ocr_confidence_band", "ocr_text_path", "text_path", "pages_path", F.lit("").alias("missing_id"), F.lit("").alias("status"), F.lit("").alias("probable_source"))
    empty = [F.lit("").alias(c) for c in ("source_name", "reliability_tier", "ocr_status", "ocr_confidence_band", "ocr_text_path", "text_path", "pages_path")]
    return have.unionByName(gaps.select(F.col("tracker_type").alias("tracker"), "document_id", "category_id", *empty, "missing_id", "status", "probable_source"))


_CATEGORY = "CASE WHEN contains(document_type, 'Supreme Court') THEN '05_supreme_court' WHEN contains(document_type, 'Court of Appeal') THEN '06_court_of_appeal' WHEN document_type IN ('Act', 'Constitution') THEN '03_legislation_acts_constitution' ELSE '99_other' END"
TRACKER_SQL = f"""WITH {_REGISTRY_SQL}, c AS (SELECT *, {_CATEGORY} AS category_id FROM reg)
SELECT 'have' AS tracker, document_id, category_id, 'Name of ' || source_id AS source_name, 'official' AS reliability_tier, CASE WHEN doc_id % 5 = 1 THEN 'ocr_completed_full' ELSE '' END AS ocr_status, CASE WHEN doc_id % 5 = 1 THEN 'high' ELSE '' END AS ocr_confidence_band, CASE WHEN doc_id % 5 = 1 THEN 'o/' || doc_id ELSE '' END AS ocr_text_path, 't/' || doc_id AS text_path, CASE WHEN doc_id % 2 = 0 THEN 'p/' || doc_id ELSE '' END AS pages_path, '' AS missing_id, '' AS status, '' AS probable_source FROM c WHERE acq = 'downloaded'
UNION ALL SELECT 'manifest_document_gap', document_id, category_id, '', '', '', '', '', '', '', 'DOC_' || document_id, CASE WHEN doc_id % 14 = 7 THEN 'license_required' ELSE 'open' END, 'http://h/' || doc_id FROM c WHERE acq <> 'downloaded'"""


def payload_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Hits read from payloads in JSON, with numbers that aren't any and provenance that is there already."""
    n = F.col("doc_id")
    meta = F.struct(F.when(n % 3 == 0, "own").alias("text_origin"), F.lit("x").alias("other"))
    payload = F.to_json(F.struct(F.col("document_id").alias("chunk_id"), F.when(n % 2 == 0, F.substring("text", 1, 30)).alias("chunk_text"), F.substring("text", 1, 20).alias("text"), F.when(n % 4 == 0, "none").otherwise(F.col("authority_level").cast("string")).alias("authority_level"), F.when(n % 5 == 0, "x").otherwise(F.col("year").cast("string")).alias("year"), F.lit("").alias("source_url"), F.lit("source").alias("text_origin"), F.when(n % 2 == 0, "reviewed").alias("translation_review_status"), meta.alias("metadata")))
    hit = corpus(spark, folder).select(records.hit(payload).alias("h"))
    return hit.select("h.chunk_id", "h.text", "h.authority_level", "h.year", F.col("h.source_url").isNull().alias("no_url"), F.col("h.metadata")["text_origin"].alias("origin"), F.col("h.metadata")["translation_review_status"].alias("review"), F.size(F.map_keys("h.metadata")).alias("keys"))


HITS_SQL = f"""WITH {CORPUS_SQL} SELECT document_id AS chunk_id, CASE WHEN doc_id % 2 = 0 AND text <> '' THEN substr(text, 1, 30) ELSE substr(text, 1, 20) END AS text, CASE WHEN doc_id % 4 = 0 THEN 9 ELSE authority_level END AS authority_level, CASE WHEN doc_id % 5 > 0 THEN year END AS year, true AS no_url,
 CASE WHEN doc_id % 3 = 0 THEN 'own' ELSE 'source' END AS origin, CASE WHEN doc_id % 2 = 0 THEN 'reviewed' END AS review, (2 + (doc_id % 2 = 0)::INT)::INT AS keys FROM corpus"""


def download_results(spark: SparkSession, folder: str) -> DataFrame:
    """A manifest after a download run whose results cover two thirds of it."""
    n = F.col("doc_id")
    manifest = _registry(spark, folder).select("document_id", F.lit("old").alias("last_checked"), "local_path", F.lit("h").alias("file_hash"), "acquisition_status", F.when(n % 4 > 0, F.col("extraction_status")).alias("extraction_status"), F.lit("r").alias("missing_reason"), F.lit("n").alias("next_action"), F.when(n % 2 == 0, "before").alias("notes"))
    results = table(spark, folder, "documents").where("doc_id % 3 > 0").select(F.concat(F.lit("doc_"), "doc_id").alias("document_id"), F.when(n % 3 == 1, "downloaded").otherwise("failed").alias("status"), F.concat(F.lit("new/"), "doc_id").alias("local_path"), F.lit("nh").alias("file_hash"), n.alias("bytes_downloaded"), F.when(n % 3 == 2, "HTTP 500").otherwise("").alias("error"))
    return records.apply_downloads(manifest, results, "now")


DOWNLOAD_SQL = f"""WITH {_REGISTRY_SQL}, m AS (SELECT *, doc_id % 3 AS k, 'official_bulk_acquire_status=' || CASE doc_id % 3 WHEN 1 THEN 'downloaded' ELSE 'failed' END || '; bytes=' || doc_id || CASE WHEN doc_id % 3 = 2 THEN '; error=HTTP 500' ELSE '' END AS note, CASE WHEN doc_id % 4 > 0 THEN ext END AS e FROM reg)
SELECT document_id, CASE WHEN k > 0 THEN 'now' ELSE 'old' END AS last_checked, CASE WHEN k = 1 THEN 'new/' || doc_id ELSE path END AS local_path, CASE WHEN k = 1 THEN 'nh' ELSE 'h' END AS file_hash, CASE k WHEN 1 THEN 'downloaded' WHEN 2 THEN 'failed' ELSE acq END AS acquisition_status, CASE WHEN k = 1 AND coalesce(e, '') = '' THEN 'not_started' ELSE e END AS extraction_status,
 CASE k WHEN 1 THEN '' WHEN 2 THEN 'HTTP 500' ELSE 'r' END AS missing_reason, CASE k WHEN 1 THEN 'Extract text and OCR if needed.' WHEN 2 THEN 'Retry download or inspect official source manually.' ELSE 'n' END AS next_action, CASE WHEN k > 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'before; ' ELSE '' END || note WHEN doc_id % 2 = 0 THEN 'before' END AS notes FROM m"""


def directory_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Files of listings that stand behind each page, with date and size."""
    n = F.col("page_id")
    row = lambda href, label: F.concat(F.lit('<TR><td><a href="'), href, F.lit(f'">{label}</a></td><td align="right">2024-0'), n % 9 + 1, F.lit('-01 <b>10:00</b> </td><td class=s align="right"> '), n % 50, F.lit("K</td></tr>"))
    more = F.concat(row(F.concat(F.lit("case%20"), n, F.lit(".pdf")), "a"), row(F.lit("?C=M"), "sort"), row(F.lit("/wp-content/uploads/"), "up"), row(F.lit("notes.txt"), "t"), F.lit('<tr><td><a href="old&amp;new.ZIP">z</a></td></tr>'))
    return records.directory_rows(table(spark, folder, "pages").select("page_id", F.concat(F.coalesce("html", F.lit("")), F.lit("<table>"), more).alias("html")), "page_id").where("href like 'case%' or href like 'old%'").drop("position")


LISTING_SQL = """SELECT page_id, 'case%20' || page_id || '.pdf' AS href, 'case ' || page_id || '.pdf' AS name, '2024-0' || (page_id % 9 + 1) || '-01 10:00' AS modified, (page_id % 50) || 'K' AS size FROM pages UNION ALL SELECT page_id, 'old&new.ZIP', 'old&new.ZIP', '', '' FROM pages"""


def report_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts as a report has them: hash of the ASCII line, and whether a cleaned form is taken."""
    text = F.concat("text", F.lit(' “q” – x … ok ??? " end , now'))
    cleaned = F.when(F.col("doc_id") % 3 == 0, F.lit("I am unable to")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("short "), F.substring("text", 1, 10))).otherwise(F.repeat(F.lit("long "), 4000))
    rows = corpus(spark, folder).select("doc_id", records.report_line(text).alias("line"), records.safe_cleaned(text, cleaned).alias("safe"), records.ascii_text(text).alias("a"))
    return rows.select("doc_id", F.sha2("line", 256).alias("line_hash"), F.length("line").alias("n"), F.sha2("safe", 256).alias("safe_hash"))


_FOLD = "text || ' “q” – x … ok ??? \" end , now'"
for _source, _target in records.FOLDED:
    _FOLD = f"replace({_FOLD}, '{_source}', '{_target.replace(chr(39), chr(39) * 2)}')"
_FOLD = rf"regexp_replace({_FOLD}, '[^\x00-\x7F]', '?', 'g')"
REPORT_SQL = rf"""WITH f AS (SELECT doc_id, text, trim(regexp_replace({_FOLD}, '\s+', ' ', 'g')) AS flat FROM documents),
c AS (SELECT *, regexp_replace(regexp_replace(flat, '\?+\s*"', '-', 'g'), '\s+([,.;:])', '\1', 'g') AS line, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace('short ' || substr(text, 1, 10), '‘', ''''), '’', ''''), '“', '"'), '”', '"'), '–', '-'), '—', '-'), '…', '...'), chr(160), ' '), '[^\x00-\x7F]', '?', 'g'), '\s+', ' ', 'g')) ELSE trim(repeat('long ', 4000)) END AS cleaned FROM f)
SELECT doc_id, sha256(line) AS line_hash, length(line)::INT AS n, sha256(CASE WHEN cleaned IS NULL OR length(cleaned) > greatest(length(flat) * 1.35, length(flat) + 350) THEN flat ELSE cleaned END) AS safe_hash FROM c"""

_SPAN = "struct<quote:string,start_char:int,end_char:int>"


def structure_warnings(spark: SparkSession, folder: str) -> DataFrame:
    """Breaches of case structures made from conversation turns: quotes, ids, coverage, missing parts."""
    n = F.col("conv_id") + F.col("turn")
    span = lambda start, size: F.struct(F.substring("text", start, size).alias("quote"), F.lit(0).alias("start_char"), F.lit(0).alias("end_char"))
    other = F.struct(F.when(n % 2 == 0, "no such quote #").otherwise("").alias("quote"), F.lit(None).cast("int").alias("start_char"), F.lit(None).cast("int").alias("end_char"))
    none = F.array().cast(f"array<{_SPAN}>")
    fact = lambda i, label, spans: F.struct(F.lit(i).alias("fact_id"), label.alias("certainty_label"), spans.alias("source_spans"))
    label = F.when(n % 5 == 0, "missing").otherwise("stated")
    rows = table(spark, folder, "conversations").where("length(text) >= 60").select(
        F.concat_ws(":", "conv_id", "turn").alias("case_id"), F.col("text").alias("raw"),
        F.array(fact("f1", label, F.array(span(1, 20))), fact("f2", label, F.when(n % 3 == 0, none).otherwise(F.array(span(11, 40)))), F.struct(F.when(n % 7 == 0, "f1").otherwise("f3").alias("fact_id"), label.alias("certainty_label"), F.array(span(1, 5)).alias("source_spans"))).alias("facts"),
        F.array(F.struct(F.array(span(1, 10), other).alias("source_spans"))).alias("parties"), F.array().cast(f"array<struct<source_spans:array<{_SPAN}>>>").alias("timeline"),
        F.array(F.struct(F.array(F.lit("f2"), F.when(n % 4 == 0, "f9").otherwise("f1")).alias("supporting_fact_ids"), F.lit("inferred").alias("certainty_label"), F.when(n % 6 > 0, "why").alias("inferred_reason"))).alias("issues"),
        F.when(n % 8 > 0, F.array(F.lit("q"))).alias("queries"),
    )
    return structure.warnings(rows)


STRUCTURE_SQL = """WITH c AS (SELECT conv_id || ':' || turn AS case_id, conv_id + turn AS n, text, length(text) AS len FROM conversations WHERE length(text) >= 60),
s AS (SELECT case_id, text, unnest([substr(text, 1, 10), substr(text, 1, 20), substr(text, 1, 5), CASE WHEN n % 3 > 0 THEN substr(text, 11, 40) END]) AS q FROM c),
k AS (SELECT case_id, unnest(range(instr(text, q), instr(text, q) + length(q))) AS i FROM s WHERE q IS NOT NULL), v AS (SELECT case_id, count(DISTINCT i) AS covered FROM k GROUP BY 1)
SELECT case_id, 'parties[1].source_spans[2]' AS path, CASE WHEN n % 2 = 0 THEN 'quote is not an exact substring of raw input' ELSE 'has no exact source quote' END AS warning FROM c
UNION ALL SELECT case_id, 'facts[2]', 'has no source spans' FROM c WHERE n % 3 = 0 AND n % 5 > 0
UNION ALL SELECT case_id, 'facts', 'duplicate fact IDs: f1' FROM c WHERE n % 7 = 0
UNION ALL SELECT case_id, 'issues[1]', 'references unknown supporting facts: f9' FROM c WHERE n % 4 = 0
UNION ALL SELECT case_id, 'issues[1]', 'is inferred but has no inferred_reason' FROM c WHERE n % 6 = 0
UNION ALL SELECT case_id, 'facts', 'structure contains no non-missing facts from non-empty raw input' FROM c WHERE n % 5 = 0
UNION ALL SELECT case_id, 'spans', 'source span coverage is low: ' || printf('%.2f', round(covered / len, 4) * 100) || '%' FROM c JOIN v USING (case_id) WHERE len >= 120 AND length(trim(text)) >= 120 AND round(covered / len, 4) < 0.35
UNION ALL SELECT case_id, 'queries', 'structure has facts or issues but no retrieval queries' FROM c WHERE n % 8 = 0"""

_NAMES = "recovery_backlog page_load chunk_rows tracker_rows payload_hits download_results directory_listing report_texts structure_warnings".split()
QUERIES = {n: globals()[n] for n in _NAMES}
SQL = dict(zip(_NAMES, (BACKLOG_SQL, LOAD_SQL, CHUNK_SQL, TRACKER_SQL, HITS_SQL, DOWNLOAD_SQL, LISTING_SQL, REPORT_SQL, STRUCTURE_SQL), strict=True))
