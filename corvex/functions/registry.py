"""Eligibility, readiness, categories and flags of corpus rows, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages, statuses and thresholds of the registry.
LANGUAGES = ("", "english", "eng", "en", "sinhala", "sin", "si", "tamil", "tam", "ta", "unknown")
READY_STATUSES = ("text_extracted", "package_extracted", "extracted")
LEAST_QUALITY, READY_QUALITY = 0.10, 0.60
OFFICIAL = ("parl", "gov", "gazette", "printing", "lawnet", "constitution")
COURTS = ("supreme", "court", "coa", "sc_", "ca_", "tribunal")
LICENSED = ("lankalaw", "licensed", "nlr", "slr", "clr")
SECONDARY = ("commentary", "digest", "article", "book")
OFFICIAL_HOSTS = ("parliament.lk", "documents.gov.lk", "lawnet.gov.lk")


def eligible(language: Column, acquisition: Column, extraction: Column, ocr_required: Column, quality: Column, source_id: Column, gazettes: bool = False, empty_language: bool = True) -> Column:
    """Whether a row's text may be chunked; gazettes only where asked for."""
    allowed = LANGUAGES if empty_language else LANGUAGES[1:]
    test = (acquisition == "downloaded") & F.lower(F.coalesce(language, F.lit(""))).isin(*allowed) & extraction.isin(*READY_STATUSES)
    test = test & ~F.coalesce(ocr_required, F.lit(False)) & (F.coalesce(quality, F.lit(0.0)) >= LEAST_QUALITY)
    return test if gazettes else test & ~source_id.contains("GAZETTE")


def ready_text(extraction: Column, ocr_required: Column, quality: Column, ocr_status: Column, ocr_chars: Column, least: float = READY_QUALITY) -> Column:
    """Whether text can be used: OCR that is complete wins, else extracted text of enough or unknown quality."""
    done = F.coalesce(ocr_status.startswith("ocr_completed") & (ocr_chars > 0), F.lit(False))
    return done | (extraction.isin(*READY_STATUSES) & ~F.coalesce(ocr_required, F.lit(False)) & (F.coalesce(quality, F.lit(1.0)) >= least))


def needs_ocr(extraction: Column, ocr_required: Column, ocr_status: Column, ocr_chars: Column) -> Column:
    """Whether OCR is still to be done."""
    done = F.coalesce(ocr_status.startswith("ocr_completed") & (ocr_chars > 0), F.lit(False))
    return ~done & (extraction.isin("ocr_required", "ocr_pending") | F.coalesce(ocr_required, F.lit(False)))


def ingestion_status(acquisition: Column, extraction: Column) -> Column:
    """extracted, downloaded, skipped, failed or queued."""
    return (
        F.when((acquisition == "downloaded") & extraction.isin(*READY_STATUSES), "extracted")
        .when(acquisition == "downloaded", "downloaded")
        .when(acquisition.isin("missing", "not_available"), "skipped")
        .when(acquisition.contains("failed") | extraction.contains("failed"), "failed")
        .otherwise("queued")
    )


def reliability_tier(source_id: Column, url: Column) -> Column:
    """official, court_or_tribunal, licensed_publisher, secondary or unverified."""
    low, url = F.lower(F.trim(source_id)), F.lower(F.coalesce(url, F.lit("")))
    begins = lambda names: reduce(lambda a, b: a | b, [low.startswith(n) for n in names])
    hosted = reduce(lambda a, b: a | b, [url.contains(h) for h in OFFICIAL_HOSTS])
    return F.when(begins(OFFICIAL), "official").when(begins(COURTS), "court_or_tribunal").when(hosted, "official").when(begins(LICENSED), "licensed_publisher").when(begins(SECONDARY), "secondary").otherwise("unverified")


# Types and sources of the categories.
LEGISLATION_TYPES = ("Act", "Acts and Ordinances", "Consolidated Act", "Constitution", "Core Legislation", "Legislation", "Legislative Enactments")
LAW_REPORT_TYPES = ("Ceylon Law Recorder", "Ceylon Law Reports", "Lanka Law Reporter", "New Law Report", "Sri Lanka Law Report")
PARLIAMENT_SOURCES = (
    "PARL_ADDENDUMS", "PARL_COMMITTEE_REPORTS", "PARL_CONSULTATIVE_MONTHLY_REPORTS", "PARL_MINISTERIAL_CONSULTATIVE_REPORTS", "PARL_MINUTES", "PARL_ORDER_BOOKS",
    "PARL_ORDER_OF_BUSINESS", "PARL_ORDER_PAPERS", "PARL_PAPERS_PRESENTED", "PARL_PROGRESS_REPORTS", "PARL_SPEAKER_PAPERS",
)
#: Fixed values: (category, sources, types, part of the type) in the order in which they are tried.
CATEGORIES = (
    ("01_ordinary_gazettes", ("GOV_GAZETTES",), (), None),
    ("02_extraordinary_gazettes", ("GOV_EXTRA_GAZETTES",), (), None),
    ("04_government_bills", ("PARL_GOV_BILLS",), (), None),
    ("05_supreme_court", ("SC_OFFICIAL", "PARL_SC_DECISIONS_ON_BILLS"), (), "Supreme Court"),
    ("06_court_of_appeal", ("CA_OFFICIAL",), (), "Court of Appeal"),
    ("07_hansard", "PARL_HANSARD", (), None),
    ("09_law_reports", (), LAW_REPORT_TYPES, None),
    ("13_provincial_subnational_law", ("UVA_HEALTH_STATUTES",), ("Provincial Statute",), None),
    ("uva", ("UVA_PSC_LEGAL_PROVISIONS",), (), None),
    ("14_administrative_practice_materials", ("CBSL_RULES_DIRECTIONS",), (), None),
    ("03_legislation_acts_constitution", ("PARL_ACTS",), LEGISLATION_TYPES, None),
    ("08_parliament_business_records", PARLIAMENT_SOURCES, (), None),
    ("15_lankalaw_library", ("LANKALAW_NET",), (), None),
)


def category(source_id: Column, document_type: Column, title: Column | None = None) -> Column:
    """The corpus category of a document, the first of CATEGORIES that holds; one source is told apart by type and title."""
    kind, title = F.coalesce(document_type, F.lit("")), F.lit("") if title is None else F.coalesce(title, F.lit(""))
    mixed = F.when(kind.contains("Constitution"), "03_legislation_acts_constitution").when(kind.contains("Provincial") | title.contains("Provincial"), "13_provincial_subnational_law").otherwise("14_administrative_practice_materials")
    out = F.lit("99_other")
    for name, sources, types, part in reversed(CATEGORIES):
        test = source_id.startswith(sources) if isinstance(sources, str) else source_id.isin(*sources)
        test = test | kind.isin(*types) if types else test
        test = test | kind.contains(part) if part else test
        out = F.when(F.coalesce(test, F.lit(False)), mixed if name == "uva" else F.lit(name)).otherwise(out)
    return out


def page_flags(text: Column, error: Column, method: Column, confidence: Column) -> Column:
    """Flags of a page."""
    n = F.length(F.trim(F.coalesce(text, F.lit(""))))
    share = F.when(confidence <= 1, confidence * 100).otherwise(confidence)
    tests = {"page_extraction_error": F.coalesce(error, F.lit("")) != "", "empty_page_text": n == 0, "low_confidence_ocr": (method == "ocr") & (share < 70), "very_short_page_text": n < 25}
    return F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))


def ocr_quality(confidence: Column, chars: Column, n_pages: Column) -> Column:
    """Quality of OCR text: the less of confidence and density."""
    density = chars / F.greatest(F.lit(1), n_pages)
    step = F.when(density >= 500, 1.0).when(density >= 100, 0.6).otherwise(0.25)
    return F.when(chars == 0, F.lit(0.0)).otherwise(F.round(F.least(F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence / 100.0)), step), 4))


def page_text_quality(chars: Column, n_pages: Column) -> Column:
    """Quality of extracted text by characters for each page."""
    return F.when(chars == 0, 0.0).when(n_pages <= 0, 0.5).when(chars / n_pages < 100, 0.25).when(chars / n_pages < 500, 0.6).otherwise(0.9)


def sync_status(asset: Column, n_text_pages: Column, old_hash: Column, new_hash: Column) -> Column:
    """What becomes of a document's text version."""
    return F.when(asset.isNull(), "missing_source_asset").when(n_text_pages == 0, "no_page_text").when(F.coalesce(old_hash == new_hash, F.lit(False)), "skipped_current").otherwise("synced")


#: Signals of an intake text, as (code, pattern).
INTAKE = (
    ("dates", r"(?i)\b(?:19|20)\d{2}\b|\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"),
    ("client_position", r"(?i)\b(?:we act for|acting for|client is|our client|claimant|plaintiff|petitioner|appellant|respondent|defendant|accused|right[- ]holder|employer|employee|union)\b"),
    ("parties", r"(?i)\b(?:v\.| vs | versus |appellant|respondent|plaintiff|defendant|petitioner|company|limited|pvt|ltd)\b"),
    ("case_number", r"(?i)\b(?:sc|ca|hc|dc|mc|lt)\s*(?:appeal|application|case|writ)?\s*no\.?\b"),
)


def missing_signals(text: Column) -> Column:
    """Codes of the intake signals that a text lacks."""
    return F.array_compact(F.array(*[F.when(~text.rlike(p), F.lit(code)) for code, p in INTAKE]))


ITEM_RE = r"\b([A-Za-z0-9][A-Za-z0-9_-]*_item_[0-9]{3})\b"


def cite_sentences(answer: Column, allowed: Column) -> Column:
    """The answer with citations put after each sentence that has none: those it cites elsewhere, else the first five allowed."""
    cited = F.array_sort(F.array_intersect(F.regexp_extract_all(answer, F.lit(ITEM_RE), F.lit(1)), allowed))
    used = F.when(F.size(cited) > 0, cited).otherwise(F.slice(F.array_sort(allowed), 1, 5))
    suffix = F.array_join(F.transform(used, lambda x: F.concat(F.lit("["), x, F.lit("]"))), " ")
    sentences = F.filter(F.split(answer, r"(?<=[.!?])\s+"), lambda x: x != "")
    return F.when(F.size(used) == 0, answer).otherwise(F.array_join(F.transform(sentences, lambda x: F.when(x.rlike(ITEM_RE), x).otherwise(F.concat(x, F.lit(" "), suffix))), " "))


def pack_paragraphs(text: Column, most: int) -> Column:
    """Paragraphs joined up to a number of characters, longer ones cut; a fold over the text's paragraphs."""
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"))
    parts = F.filter(F.transform(F.split(clean, "\n\n"), lambda x: F.trim(x)), lambda x: x != "")
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, p: Column) -> Column:
        flushed = F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"])))
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / most).cast("int")), lambda i: F.substring(p, i * most + 1, F.lit(most)))
        longer = F.when(acc["now"] == "", p).otherwise(F.concat(acc["now"], F.lit("\n\n"), p))
        return (
            F.when(F.length(p) > most, F.struct(F.concat(flushed, cut).alias("done"), F.lit("").alias("now")))
            .when(F.length(longer) <= most, F.struct(acc["done"].alias("done"), longer.alias("now")))
            .otherwise(F.struct(flushed.alias("done"), p.alias("now")))
        )

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))))
