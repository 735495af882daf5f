"""Scalar text functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_text(text: Column) -> Column:
    """Control characters to blanks, one kind of line break, blanks collapsed, lines trimmed, empty lines dropped."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f&&[^\r]]", " ")
    text = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"[ \t]+", " ")
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def estimate_tokens(text: Column) -> Column:
    """Four thirds of the words, rounded down, one at least."""
    return F.greatest(F.lit(1), F.floor(F.size(words(text)) * 4 / 3).cast("int"))


def stable_hash(text: Column) -> Column:
    """SHA-256 in hex."""
    return F.sha2(text, 256)


def stable_id(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the parts joined by two colons."""
    return F.substring(F.sha1(F.concat_ws("::", *parts)), 1, 16)


def bm25_tokens(text: Column) -> Column:
    """Lower-case tokens of two or more characters, all occurrences."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9][A-Za-z0-9()./-]*)"), F.lit(1)), F.lower)
    return F.filter(found, lambda x: F.length(x) > 1)


#: Words that carry no meaning in a query.
STOP_WORDS = (
    "and", "the", "for", "with", "from", "that", "this", "into", "under", "about", "after", "before", "between", "where", "which", "says", "wants", "case", "legal", "sri", "lanka", "ceylon",
    "act", "acts", "law", "laws", "section", "article", "ordinance",
)


def query_tokens(text: Column) -> Column:
    """Distinct lower-case words of three or more characters in order of appearance, stop words left out."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z][a-z0-9]{2,})"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda x: ~x.isin(*STOP_WORDS)))


def terms(text: Column) -> Column:
    """Distinct lower-case terms of letters and underscores."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z][a-z_]{2,})"), F.lit(1)))


def important_phrases(text: Column) -> Column:
    """Quoted strings of 4 to 80 characters, then runs of 2 to 6 capitalised words; 16 at most."""
    quoted = F.regexp_extract_all(text, F.lit('"([^"]{4,80})"'), F.lit(1))
    names = F.regexp_extract_all(text, F.lit(r"\b((?:[A-Z][A-Za-z]+(?:\s+|$)){2,6})"), F.lit(1))
    clean = F.transform(F.concat(quoted, names), lambda x: F.lower(F.trim(F.regexp_replace(x, r"\s+", " "))))
    return F.slice(F.array_distinct(F.filter(clean, lambda x: F.length(x) >= 5)), 1, 16)


def excerpt(text: Column, wanted: list[str], radius: int = 420) -> Column:
    """The text on one line around the first of the wanted words, with dots where it is cut; its head if none is there."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    low, n = F.lower(flat), F.length(flat)
    at = F.array_min(F.filter(F.array(*[F.locate(w, low) for w in wanted]), lambda p: p > 0))
    start, end = F.greatest(F.lit(1), at - radius), F.least(n, at - 1 + radius)
    cut = F.concat(F.when(start > 1, "...").otherwise(""), F.trim(F.substring(flat, start, end - start + 1)), F.when(end < n, "...").otherwise(""))
    return F.when(at.isNull(), F.trim(F.substring(flat, 1, 2 * radius))).otherwise(cut)


def extractive_summary(text: Column, wanted: list[str], most: int) -> Column:
    """The text on one line if it is short enough, else what stands around the first of the wanted words, else its head."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.when(any_word(F.lower(flat), wanted), excerpt(flat, wanted, max(120, most // 2))).otherwise(F.rtrim(F.substring(flat, 1, most))))


def any_word(low: Column, wanted: list[str]) -> Column:
    """Whether any of the words stands in a lower-case text."""
    return reduce(lambda a, b: a | b, [low.contains(w) for w in wanted], F.lit(False))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of each lower-case word with two blanks before and one behind."""
    parts = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    grams = F.transform(parts, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    """Common trigrams over all trigrams; 0 if there are none."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def or_rank(tokens: Column, prefixes: list[str]) -> Column:
    """Cover density of a query of alternatives: each matching position counts 0.1, and x becomes x / (x + 1)."""
    hits = F.size(F.filter(tokens, lambda t: reduce(lambda a, b: a | b, [t.startswith(p) for p in prefixes]))) * F.lit(0.1)
    return hits / (hits + 1)


def spread_summary(text: Column, ratio: float = 0.10, least: int = 1200, most: int = 12000) -> Column:
    """The text if short, else its head, middle and tail within a budget."""
    n = F.length(text)
    budget = F.least(n, F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(n * F.lit(ratio)).cast("int"))))
    third = F.greatest(F.lit(1), F.floor(budget / 3.0).cast("int"))
    middle = F.greatest(F.lit(1), F.floor(n / 2.0 - budget / 6.0).cast("int"))
    rest = F.greatest(F.lit(1), budget - 2 * third)
    gap = F.lit("\n\n[...]\n\n")
    return F.when(budget + 18 >= n, text).otherwise(F.concat(F.substring(text, 1, third), gap, F.substring(text, middle, third), gap, F.substring(text, n - rest + 1, rest)))


def alnum_ratio(text: Column) -> Column:
    """Share of letters and digits; 0 for the empty text."""
    n = F.length(text)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")) / n)


def confidence_band(confidence: Column) -> Column:
    """Band of a confidence from 0 to 1."""
    return F.when(confidence.isNull(), "unknown").when(confidence >= 0.95, "high").when(confidence >= 0.85, "medium").when(confidence >= 0.70, "low").otherwise("unusable")


def ocr_band(confidence: Column) -> Column:
    """Band of a confidence from 0 to 100."""
    return F.when(confidence.isNull(), "unknown").when(confidence >= 85, "high").when(confidence >= 70, "medium").otherwise("low")


def extraction_quality(text: Column, method: Column, confidence: Column) -> dict[str, Column]:
    """Flags, score, eligibility and need of review of an extracted text."""
    text = F.trim(F.coalesce(text, F.lit("")))
    band, ocr = confidence_band(confidence), F.lower(method).contains("ocr")
    ratio, n = alnum_ratio(text), F.length(text)
    tests = {
        "empty_text": n == 0,
        "low_alphanumeric_ratio": (n > 0) & (ratio < 0.35),
        "low_confidence_ocr": ocr & (band == "low"),
        "replacement_characters": text.contains("�"),
        "unknown_ocr_confidence": ocr & (band == "unknown"),
        "unusable_ocr": ocr & (band == "unusable"),
        "very_short_text": n < 80,
    }
    flags = F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))
    raw = F.least(F.lit(1.0), n / 500) * 0.25 + ratio * 0.25 + F.coalesce(confidence, F.lit(0.75)) * 0.5
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw - 0.15 * F.size(flags))), 4)
    eligible = ~(tests["empty_text"] | tests["unusable_ocr"] | tests["low_confidence_ocr"] | tests["low_alphanumeric_ratio"])
    review = ~eligible | tests["very_short_text"] | tests["replacement_characters"] | tests["unknown_ocr_confidence"]
    return {"quality_flags": flags, "quality_score": score, "confidence_band": band, "legal_answer_eligible": eligible, "requires_manual_review": review}
