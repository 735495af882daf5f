"""Backlogs of a corpus: what to extract, read by OCR, translate and index; loading of pages with what was skipped and why."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Statuses and languages of the queues.
DOWNLOADED, NOT_STARTED, EMPTY = "downloaded", "not_started", "text_empty_needs_ocr"
FAILED_EXTRACTION = ("text_extraction_failed", "ocr_failed", "not_started")
LOADABLE = ("text_extracted", "text_empty_needs_ocr")
ENGLISH = ("english", "eng", "en", "e")
TRANSLATED = ("sinhala", "sin", "si", "tamil", "tam", "ta")
DEAD_REVIEWS = ("rejected", "superseded_by_official")


def _there(*parts: DataFrame) -> DataFrame:
    """document_id and the set of marks that the parts (document_id, mark) give it; one exchange for all of them."""
    return reduce(DataFrame.unionByName, parts).groupBy("document_id").agg(F.collect_set("mark").alias("_m"))


def _text(column: str) -> Column:
    return F.length(F.trim(F.coalesce(F.col(column), F.lit("")))) > 0


def marked(documents: DataFrame, pages: DataFrame, chunks: DataFrame, versions: DataFrame) -> DataFrame:
    """documents with ``_m``: whether they have pages, text pages, pages with text by OCR, chunks, and a live English translation."""
    page = F.array_compact(F.array(F.lit("page"), F.when(_text("text"), F.lit("text")), F.when(_text("text") & (F.col("extraction_method") == "ocr"), F.lit("ocr"))))
    live = (F.col("text_origin") == "translation") & F.lower(F.coalesce("language", F.lit(""))).isin("english", "en") & ~F.coalesce("translation_review_status", F.lit("")).isin(*DEAD_REVIEWS)
    marks = _there(pages.select("document_id", F.explode(page).alias("mark")), chunks.select("document_id", F.lit("chunk").alias("mark")), versions.where(live).select("document_id", F.lit("translation").alias("mark")))
    return documents.join(marks, "document_id", "left").withColumn("_m", F.coalesce("_m", F.array().cast("array<string>")))


def _has(name: str) -> Column:
    return F.array_contains("_m", name)


def _needs_ocr() -> Column:
    return (F.coalesce("extraction_status", F.lit("")) == EMPTY) | F.coalesce("ocr_required", F.lit(False)) | (_has("page") & ~_has("text"))


def _pdf(*more: str) -> Column:
    return reduce(lambda a, b: a | b, [F.lower("local_path").like(f"%.{kind}") for kind in ("pdf", *more)])


def predicates(include_failed: bool = False, retry_failed: bool = False, all_languages: bool = False, force: bool = False) -> dict[str, Column]:
    """The queues over marked documents (local_path, language, source_document_id, acquisition_status, extraction_status, ocr_required, full_text)."""
    downloaded = F.col("acquisition_status") == DOWNLOADED
    status = F.coalesce("extraction_status", F.lit(""))
    recover = _needs_ocr() | (status.isin(*FAILED_EXTRACTION) if include_failed else F.lit(False))
    open_ones = F.lit(True) if force else ~_has("chunk") & ~_has("ocr")
    english = F.lower(F.coalesce("language", F.lit(""))).isin(*ENGLISH) | F.coalesce(F.lower("local_path").like("%/english/%"), F.lit(False)) | F.upper(F.coalesce("source_document_id", F.lit(""))).like("%:E")
    return {
        "ocr": downloaded & _text("local_path") & _pdf("zip") & open_ones & recover,
        "extraction": downloaded & _text("local_path") & _pdf() & ~_has("chunk") & ~_has("page") & (F.lit(True) if retry_failed else status == NOT_STARTED),
        "english_ocr": downloaded & _pdf() & (status != "ocr_failed") & ~_has("chunk") & ~_has("ocr") & _needs_ocr() & (F.lit(True) if all_languages else english),
        "index": downloaded & _has("text") & status.isin(*LOADABLE) & ~_has("chunk"),
        "translation": downloaded & F.lower(F.coalesce("language", F.lit(""))).isin(*TRANSLATED) & _text("full_text") & (F.lit(True) if force else ~_has("translation")),
    }


def queues(documents: DataFrame, pages: DataFrame, chunks: DataFrame, versions: DataFrame, **options: bool) -> DataFrame:
    """(queue, document_id, source_id, year) of every document that waits for something; one pass over marked documents."""
    tests = predicates(**options)
    waits = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in tests.items()]))
    return marked(documents, pages, chunks, versions).select(F.explode(waits).alias("queue"), "document_id", "source_id", "year")


def page_load(manifest: DataFrame, documents: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pages to load, and one row of counts: considered, with pages, loaded, and skipped without a document or without pages.

    manifest: document_id, acquisition_status, extraction_status; pages:
    document_id, page_number and others, of which those numbered from 1 count.
    """
    ready = manifest.where((F.col("acquisition_status") == DOWNLOADED) & F.col("extraction_status").isin(*LOADABLE)).select("document_id")
    own = pages.where("page_number > 0")
    marks = _there(documents.select("document_id", F.lit("document").alias("mark")), own.select("document_id", F.lit("page").alias("mark")))
    rows = ready.join(marks, "document_id", "left").withColumn("_m", F.coalesce("_m", F.array().cast("array<string>")))
    loaded = own.join(rows.where(_has("document")).select("document_id").distinct(), "document_id", "left_semi")
    counts = rows.agg(
        F.count("*").alias("documents_considered"),
        F.count_if(_has("document") & _has("page")).alias("documents_with_pages"),
        F.count_if(~_has("document")).alias("skipped_missing_document"),
        F.count_if(_has("document") & ~_has("page")).alias("skipped_without_pages"),
    )
    return loaded, counts.crossJoin(loaded.agg(F.count("*").alias("pages_upserted")))  # one row each
