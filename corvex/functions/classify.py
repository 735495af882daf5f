"""Classification, parsing and policy expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Authority levels by document type, and the boost of each level.
AUTHORITY_BY_TYPE = {
    "Constitution": 1, "Act": 2, "Consolidated Act": 2, "Bill": 8, "Government Bill": 8,
    "Supreme Court Judgment": 3, "Supreme Court": 3, "Court of Appeal Judgment": 4, "Court of Appeal": 4,
    "Law Report": 4, "Gazette": 5, "Extraordinary Gazette": 5, "Parliament Hansard": 6,
    "Administrative Practice Material": 6, "Provincial/Subnational Law": 6,
}
AUTHORITY_BOOSTS = {1: 1.35, 2: 1.30, 3: 1.25, 4: 1.15, 5: 1.05, 6: 1.00, 7: 0.95, 8: 0.90, 9: 0.80}
SOURCE_HINTS = (("SUPREME", 3), ("COURT_OF_APPEAL", 4), ("ACT", 2), ("GAZETTE", 5), ("HANSARD", 6))


def _cases(tests: list[tuple[Column, object]], default: object) -> Column:
    return reduce(lambda out, t: F.when(t[0], F.lit(t[1])).otherwise(out), reversed(tests), F.lit(default))


def authority_level(document_type: Column, source_id: Column) -> Column:
    """Level by type, else by parts of the source id, else 8."""
    return _cases([(document_type == k, v) for k, v in AUTHORITY_BY_TYPE.items()] + [(source_id.contains(k), v) for k, v in SOURCE_HINTS], 8)


def authority_boost(level: Column) -> Column:
    """Boost of a level; 0.85 for others."""
    return _cases([(level == k, v) for k, v in AUTHORITY_BOOSTS.items()], 0.85)


def authority_score(level: Column) -> Column:
    """Steps from 1 down to 0.35."""
    return _cases([(level <= 1, 1.0), (level <= 3, 0.9), (level <= 5, 0.72), (level <= 7, 0.55)], 0.35)


def recency_score(year: Column, current_year: int) -> Column:
    """Steps by age; 0.5 where the year is unknown."""
    age = F.greatest(F.lit(0), F.lit(current_year) - year)
    return _cases([(year.isNull(), 0.5), (age <= 5, 1.0), (age <= 20, 0.85), (age <= 50, 0.68)], 0.5)


def citation(title: Column, number: Column, year: Column, page_start: Column, page_end: Column) -> Column:
    """Title, number and year, and pages, joined by commas; absent parts are left out."""
    numbered = F.when((F.coalesce(number, F.lit("")) != "") & year.isNotNull(), F.concat(F.lit("No. "), number, F.lit(" of "), year.cast("string"))).when(year.isNotNull(), year.cast("string"))
    paged = F.when(page_start != page_end, F.concat(F.lit("pp. "), page_start, F.lit("-"), page_end)).when(page_start.isNotNull(), F.concat(F.lit("p. "), page_start))
    return F.concat_ws(", ", title, numbered, paged)


def relevance_band(score: Column) -> Column:
    """Band of a relevance score from 0 to 1."""
    return _cases([(score >= 0.95, "direct"), (score >= 0.75, "strong"), (score >= 0.45, "moderate"), (score >= 0.10, "weak")], "none")


def lenient_int(text: Column) -> Column:
    """A whole number, or null."""
    return F.trim(text).try_cast("int")


def lenient_bool(text: Column) -> Column:
    """true, yes, 1, y; false, no, 0, n; else null."""
    low = F.lower(F.trim(text))
    return F.when(low.isin("true", "yes", "1", "y"), True).when(low.isin("false", "no", "0", "n"), False)


def lenient_date(text: Column) -> Column:
    """An ISO date, or null."""
    return F.substring(F.trim(text), 1, 10).try_cast("date")


def last_year(text: Column) -> Column:
    """The last year from 1940 to 2099 in a text, or null."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(r"\b(19[4-9][0-9]|20[0-9][0-9])\b"), F.lit(1)), F.lit(-1)).cast("int")


def slug(text: Column, most: int = 80) -> Column:
    """Lower-case letters and digits joined by single dashes."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


#: What a text may not say, as (code, pattern, risk).
PROHIBITED = (
    ("final_legal_advice", r"\b(final legal advice|definitive legal advice|you should definitely|you must file|guaranteed legal outcome)\b", "high"),
    ("guaranteed_outcome", r"\b(guaranteed to win|will definitely win|certain to succeed|court will certainly)\b", "high"),
    ("fabricate_authority", r"\b(fabricate|invent|make up|create fake)\b.{0,80}\b(citation|authority|case|evidence|document)\b", "critical"),
    ("hide_adverse_authority", r"\b(hide|omit|conceal|suppress)\b.{0,80}\b(adverse authority|bad authority|unhelpful case|unfavorable case)\b", "critical"),
    ("obstruct_process", r"\b(destroy|backdate|tamper with|alter)\b.{0,80}\b(evidence|document|record|affidavit|filing)\b", "critical"),
    ("bypass_lawyer_review", r"\b(skip|bypass|avoid)\b.{0,80}\b(lawyer review|legal review|human review)\b", "high"),
    ("prompt_injection", r"\b(ignore|disregard|override)\b.{0,80}\b(system|developer|previous instructions|pack boundary)\b|\b(use hidden knowledge|outside the pack|uncited answer)\b", "critical"),
)


def policy_hits(text: Column) -> Column:
    """Codes of the prohibited patterns that a text has."""
    return F.array_compact(F.array(*[F.when(text.rlike(f"(?is){p}"), F.lit(code)) for code, p, _ in PROHIBITED]))


def policy_risk(text: Column) -> Column:
    """The highest risk of a text's prohibited patterns."""
    any_of = lambda risk: reduce(lambda a, b: a | b, [text.rlike(f"(?is){p}") for _, p, r in PROHIBITED if r == risk])
    return F.when(any_of("critical"), "critical").when(any_of("high"), "high").otherwise("low")


def searchability(language: Column, assets: Column, pages: Column, text_pages: Column, versions: Column, english: Column, chunks: Column) -> Column:
    """(classification, recovery_priority) of a document: the first stage that it lacks."""
    low = F.lower(F.trim(F.coalesce(language, F.lit(""))))
    translate = low.isin("sinhala", "sin", "si", "tamil", "tam", "ta")
    pair = lambda a, b: F.struct(F.lit(a).alias("classification"), F.lit(b).alias("recovery_priority"))
    zero = lambda c: F.coalesce(c, F.lit(0)) == 0
    return (
        F.when(zero(assets), pair("needs_original_asset", "critical"))
        .when(zero(pages), pair("needs_page_extraction", "high"))
        .when(zero(text_pages), pair("needs_ocr_or_text_recovery", "high"))
        .when(zero(versions), pair("needs_text_version", "high"))
        .when(translate & zero(english), pair("needs_translation_fallback", "normal"))
        .when(zero(chunks), pair("needs_chunk_indexing", "normal"))
        .otherwise(pair("fully_searchable", "none"))
    )


# How acts, provisions and case names are written, and what ends a list of provisions.
ACT_RE = r"(?i)\b(?:act\s*,?\s*)?no\.?\s*([0-9]+[a-z]?)\s+of\s+(\d{4})\b"
PROVISION_RE = r"(?i)\b(section|sections|sec\.?|s\.|article|articles|art\.?)\s+"
LABEL_RE = r"(?i)[0-9]+[a-z]?(?:\s*\(\s*[a-z0-9]+\s*\))*"
STOP_RE = r"(?i)\b(of|under|from|in|by|for|regarding|concerning|where|which|that|shall|is|are)\b|[.;:\n]"
CASE_RE = r"(?i)\b([A-Z][A-Za-z0-9 .&'’/-]{1,80}?)\s+(?:v\.?|vs\.?|versus)\s+([A-Z][A-Za-z0-9 .&'’/-]{1,80}?)(?=$|[,.;:\n])"
PARTY_LEAD_RE = r"(?i)^(find|search for|locate|case of|judgment in)\s+"
SEGMENT_CHARS = 120


def act_label(number: Column) -> Column:
    """An act's number: letters and digits, upper case."""
    return F.upper(F.regexp_replace(number, "[^0-9A-Za-z]", ""))


def provision_label(label: Column) -> Column:
    """A provision's label without blanks, lower case."""
    return F.lower(F.regexp_replace(label, r"\s+", ""))


def party_name(name: Column) -> Column:
    """A party without marks around it, double blanks and words that lead up to it."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(name, r"^[ ,.;:\n\t]+|[ ,.;:\n\t]+$", ""), r"\s+", " ")), PARTY_LEAD_RE, "")


def citation_signals(text: Column) -> Column:
    """Acts (NUMBER/year), provisions (kind label; all of a list) and case names that a text cites, each once."""
    groups = lambda re, i: F.regexp_extract_all(text, F.lit(re), F.lit(i))
    acts = F.zip_with(groups(ACT_RE, 1), groups(ACT_RE, 2), lambda a, b: F.concat_ws("/", act_label(a), b))
    # What follows an indicator is looked at without being passed over, as the next indicator may stand in it.
    ahead = PROVISION_RE + r"(?=([\s\S]{0,%d}))" % SEGMENT_CHARS

    def labels(kind: Column, segment: Column) -> Column:
        stop = F.regexp_instr(segment, F.lit(STOP_RE))
        cut = F.when(stop > 1, F.substring(segment, F.lit(1), stop - 1)).otherwise(segment)
        found = F.regexp_extract_all(cut, F.lit(LABEL_RE), F.lit(0))
        return F.transform(found, lambda x: F.concat_ws(" ", F.lower(F.regexp_replace(kind, r"\.+$", "")), provision_label(x)))

    provisions = F.flatten(F.zip_with(groups(ahead, 1), groups(ahead, 2), labels))
    names = F.zip_with(groups(CASE_RE, 1), groups(CASE_RE, 2), lambda a, b: F.struct(party_name(a).alias("a"), party_name(b).alias("b")))
    names = F.transform(F.filter(names, lambda x: (x["a"] != "") & (x["b"] != "")), lambda x: F.concat(x["a"], F.lit(" v "), x["b"]))
    low = F.transform(names, lambda x: F.lower(x))
    cases = F.filter(names, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)
    return F.struct(F.array_distinct(acts).alias("acts"), F.array_distinct(provisions).alias("provisions"), cases.alias("cases"))
