"""Rows as other parts of the corpus want them: trackers, chunk rows, hits of a payload, download results, listings, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvex.functions import html as hx, registry as reg

# Fields of a chunk row, of the trackers, provenance keys, words of the register.
CHUNK_ROW = (
    "document_id", "source_id", "source_document_id", "document_type", "title", "year", "number", "date", "language", "source_url", "download_url", "local_path", "file_hash", "acquisition_status",
    "extraction_status", "ocr_required", "text_quality_score", "legal_status", "missing_reason", "next_action", "last_checked", "notes", "text_version_id", "text_origin", "source_language",
    "translated_from_language", "translation_review_status", "page_anchor_status",
)
HAVE = CHUNK_ROW[:16] + ("text_quality_score", "legal_status", "next_action", "last_checked", "notes")
GAP = ("document_id", "source_id", "document_type", "title", "year", "number", "date", "language", "source_url", "download_url", "local_path", "acquisition_status", "extraction_status", "missing_reason", "next_action", "last_checked", "notes")
PROVENANCE = ("quality_flags", "text_version_id", "text_origin", "source_language", "translated_from_language", "translation_review_status")
OWNER, LICENSED = "Corpus lead", "licensed_purchase_required"
NEXT_DOWNLOADED, NEXT_FAILED = "Extract text and OCR if needed.", "Retry download or inspect official source manually."
NOTE = "official_bulk_acquire_status"


def _text(rows: DataFrame, column: str) -> Column:
    """A column as text, empty where it is null or missing; truth values begin with a capital."""
    if column not in rows.columns:
        return F.lit("")
    value = F.col(column)
    if rows.schema[column].dataType.simpleString() == "boolean":
        return F.when(value, "True").otherwise("")
    if rows.schema[column].dataType.simpleString() in ("int", "bigint", "double", "float") and column != "year":
        return F.when(value != 0, value.cast("string")).otherwise("")
    return F.coalesce(value.cast("string"), F.lit(""))


def chunk_rows(rows: DataFrame) -> DataFrame:
    """Typed document rows with every field of a chunk row as text; the origin is ``source`` and the source's language the document's unless given."""
    rows = rows.withColumnRenamed("document_date", "date") if "document_date" in rows.columns else rows
    named = {c: _text(rows, c) for c in CHUNK_ROW}
    named["text_origin"] = F.coalesce(F.nullif(named["text_origin"], F.lit("")), F.lit("source"))
    named["source_language"] = F.coalesce(F.nullif(named["source_language"], F.lit("")), named["language"])
    return rows.select(*[c.alias(k) for k, c in named.items()])


def _categorised(rows: DataFrame) -> DataFrame:
    return rows.withColumn("category_id", reg.category(F.coalesce("source_id", F.lit("")), F.coalesce("document_type", F.lit(""))))


def have_rows(rows: DataFrame, sources: DataFrame, ocr: DataFrame) -> DataFrame:
    """Tracker rows of documents that are there, with names of their sources (source_id, source_name, reliability_tier) and their OCR (document_id, ocr_status, confidence_band, ocr_text_path)."""
    out = _categorised(rows).join(sources.select("source_id", "source_name", "reliability_tier"), "source_id", "left")
    out = out.join(ocr.select("document_id", "ocr_status", F.col("confidence_band").alias("ocr_confidence_band"), "ocr_text_path"), "document_id", "left")
    note = lambda key: F.regexp_extract(F.coalesce("notes", F.lit("")), rf"(?:^|;)\s*{key}=([^;]*)", 1)
    named = {c: _text(out, c) for c in ("category_id", "source_name", "reliability_tier", *HAVE, "ocr_status", "ocr_confidence_band", "ocr_text_path")}
    return out.select(*[c.alias(k) for k, c in named.items()], F.trim(note("text_path")).alias("text_path"), F.trim(note("pages_path")).alias("pages_path"))


def gap_rows(rows: DataFrame) -> DataFrame:
    """Tracker rows of documents that are missing."""
    out = _categorised(rows)
    status = F.when(F.col("acquisition_status") == LICENSED, "license_required").otherwise("open")
    named = {c: _text(out, c) for c in ("category_id", *GAP)}
    return out.select(F.lit("manifest_document_gap").alias("tracker_type"), F.concat(F.lit("DOC_"), F.coalesce("document_id", F.lit(""))).alias("missing_id"), *[c.alias(k) for k, c in named.items()], named["missing_reason"].alias("missing_description"), named["source_url"].alias("probable_source"), F.lit(OWNER).alias("owner"), status.alias("status"))


def hit(payload: Column) -> Column:
    """A search hit from a payload in JSON: text under chunk_text or text, numbers read leniently, provenance copied into metadata unless it is there."""
    get = lambda key: F.get_json_object(payload, f"$.{key}")
    number = lambda key: get(key).try_cast("int")
    own = F.coalesce(F.from_json(get("metadata"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    copied = F.map_filter(F.create_map(*[x for k in PROVENANCE for x in (F.lit(k), get(k))]), lambda k, v: v.isNotNull() & ~F.map_contains_key(own, k))
    blank = lambda key: F.coalesce(get(key), F.lit(""))
    level = number("authority_level")
    return F.struct(
        *[blank(k).alias(k) for k in ("chunk_id", "document_id", "title", "document_type", "source_id", "citation")], F.coalesce(F.nullif(get("chunk_text"), F.lit("")), blank("text")).alias("text"),
        F.when(F.coalesce(level, F.lit(0)) == 0, 9).otherwise(level).alias("authority_level"), *[number(k).alias(k) for k in ("year", "page_start", "page_end")],
        *[F.nullif(blank(k), F.lit("")).alias(k) for k in ("source_url", "local_path")], F.map_concat(own, copied).alias("metadata"),
    )


def apply_downloads(manifest: DataFrame, results: DataFrame, now: str) -> DataFrame:
    """Manifest rows after a download run (document_id, status, local_path, file_hash, bytes_downloaded, error); the rest stays as it was."""
    columns = manifest.columns
    r = results.select("document_id", *[F.col(c).alias(f"_{c}") for c in ("status", "local_path", "file_hash", "bytes_downloaded", "error")])
    rows = manifest.join(r, "document_id", "left")
    there, done = F.col("_status").isNotNull(), F.col("_status") == "downloaded"
    note = F.concat(F.lit(f"{NOTE}="), "_status", F.lit("; bytes="), F.col("_bytes_downloaded").cast("string"), F.when(F.coalesce("_error", F.lit("")) != "", F.concat(F.lit("; error="), "_error")).otherwise(""))
    prior = F.coalesce("notes", F.lit(""))
    new = {
        "last_checked": F.when(there, F.lit(now)).otherwise(F.col("last_checked")),
        "local_path": F.when(done, F.col("_local_path")).otherwise(F.col("local_path")),
        "file_hash": F.when(done, F.col("_file_hash")).otherwise(F.col("file_hash")),
        "acquisition_status": F.when(there, F.col("_status")).otherwise(F.col("acquisition_status")),
        "extraction_status": F.when(done & (F.coalesce("extraction_status", F.lit("")) == ""), "not_started").otherwise(F.col("extraction_status")),
        "missing_reason": F.when(done, "").when(there, F.col("_error")).otherwise(F.col("missing_reason")),
        "next_action": F.when(done, NEXT_DOWNLOADED).when(there, NEXT_FAILED).otherwise(F.col("next_action")),
        "notes": F.when(there, F.when(prior != "", F.concat(prior, F.lit("; "), note)).otherwise(note)).otherwise(F.col("notes")),
    }
    return rows.withColumns({k: c for k, c in new.items()}).select(*columns)


def directory_rows(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, position, href, name, modified, size) of the files of a directory listing: one link a row, PDF and ZIP files only, date and size from right-aligned cells."""
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit("(?is)<tr>(.*?)</tr>"), F.lit(1))).alias("position", "row"))
    link = F.regexp_extract_all("row", F.lit('(?is)<a\\s+href="([^"]+)">.*?</a>'), F.lit(1))
    cells = F.regexp_extract_all("row", F.lit('(?is)<td[^>]*align="right"[^>]*>(.*?)</td>'), F.lit(1))
    rows = rows.select(key, "position", hx.unescape(F.get(link, F.lit(0))).alias("href"), cells.alias("cells"))
    rows = rows.where(F.col("href").isNotNull() & ~F.col("href").startswith("?") & ~F.col("href").startswith("/wp-content/uploads/") & F.col("href").rlike(r"(?i)\.(pdf|zip)$"))
    cell = lambda i: hx.strip_tags(F.coalesce(F.get("cells", F.lit(i)), F.lit("")))
    return rows.select(key, "position", "href", hx.file_name(F.col("href")).alias("name"), cell(0).alias("modified"), cell(1).alias("size"))


# Characters that have an ASCII form.
FOLDED = (("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "-"), ("…", "..."), ("\xa0", " "))
REFUSALS = ("cannot", "can't", "unable", "as an ai", "i'm sorry", "i am sorry")


def ascii_text(text: Column) -> Column:
    """Text in ASCII: quotes, dashes and dots folded, what has no form a question mark for each character."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    for source, target in FOLDED:
        text = F.replace(text, F.lit(source), F.lit(target))
    return F.regexp_replace(text, r"[^\x00-\x7F]", "?")


def report_line(text: Column) -> Column:
    """ASCII text on one line, without blanks before marks."""
    flat = F.trim(F.regexp_replace(ascii_text(text), r"\s+", " "))
    return F.regexp_replace(F.regexp_replace(flat, r'\?+\s*"', "-"), r"\s+([,.;:])", "$1")


def safe_cleaned(original: Column, cleaned: Column) -> Column:
    """The cleaned text, or the original where the cleaned one is empty, a refusal, or far longer."""
    flat = lambda c: F.trim(F.regexp_replace(ascii_text(c), r"\s+", " "))
    source, candidate = flat(original), flat(cleaned)
    head = F.substring(F.lower(candidate), 1, 160)
    refused = F.exists(F.array(*map(F.lit, REFUSALS)), lambda w: F.contains(head, w))
    longer = F.length(candidate) > F.greatest(F.length(source) * 1.35, (F.length(source) + 350).cast("double"))
    return F.when((candidate == "") | refused | longer, source).otherwise(candidate)
