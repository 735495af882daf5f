"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score.

Base kinds (email, ip, card, phone) are decided by pattern and checksum alone.
Further kinds (iban by mod-97, ssn) also need a score of ``THRESHOLD``, to which
words near the span add, or from which they take.  Offsets count code points; ends are exclusive.

Every scan is linear in the text: where the plain pattern would be tried from
each character of a long run, the scan starts at the run or at its anchor.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from corvex.llm.wordhash import lean

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
THRESHOLD = 0.6
#: Code points before and after a span in which context words count.
CONTEXT_CHARS = 48

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits matches from its first digit or not at all, so the look-behind drops no match.
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}")
#: Characters of an IBAN by country.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN_BODY = {
    c: re.compile(rf"(?:\x20?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf"\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + "(?![A-Za-z0-9])")
    for n, names in _IBAN_LENGTHS.items()
    for c in names.split()
}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

#: Score of a confirmed span, and the words that raise it by CONTEXT_GAIN or lower it by CONTEXT_LOSS.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4}
CONTEXT_GAIN, CONTEXT_LOSS = 0.3, 0.3
_FAR = re.compile(r"(?i)\b(?:example|sample|dummy|fictitious|placeholder|version|isbn|part no|order no|invoice|tracking)\b")
_NEAR = {
    "email": re.compile(r"(?i)\b(?:e-?mail|contact|correo|courriel)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|host|server|address)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|credit|carte|tarjeta|kreditkarte)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|call|mobile|telefon|teléfono|téléphone)\b"),
    "iban": re.compile(r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b"),
    "ssn": re.compile(r"(?i)\b(?:ssn|social security)\b"),
}

Span = tuple[str, int, int, float]


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn checksum."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an IBAN without blanks has the remainder 1 modulo 97."""
    if not 15 <= len(iban) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        if (domain := _DOMAIN.match(text, at + 1)) is not None:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, domain.end()
                done = domain.end()
        at = text.find("@", at + 1)


def _proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans, by kind as listed and then by start."""
    for start, end in _emails(text):
        yield "email", start, end
    if _DIGIT.search(text) is None:
        return
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p := x.lstrip("0")) < 4 and (not p or int(p) <= 255) for x in m.groups()):
                yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() and 16 <= len(digits := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                yield "phone", m.start(), m.end()
    for m in _IBAN.finditer(text):
        # The country tells the length, so that no word after the number is taken for a part of it.
        body = _IBAN_BODY[m[1]].match(text, m.end()) if m[1] in _IBAN_BODY else None
        if body and mod97(text[m.start() : body.end()].replace(" ", "")):
            yield "iban", m.start(), body.end()
    if "-" in text:
        for m in _SSN.finditer(text):
            area, group, serial = m.group().split("-")
            if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
                yield "ssn", m.start(), m.end()


def find(text: str | None) -> list[Span]:
    """All spans (kind, start, end, score) of a text, by kind as listed and then by start; none for null."""
    found = []
    for kind, start, end in _proposed(text or ""):
        near = f"{text[max(0, start - CONTEXT_CHARS):start]} {text[end:end + CONTEXT_CHARS]}"
        score = SCORES[kind] + CONTEXT_GAIN * (_NEAR[kind].search(near) is not None) - CONTEXT_LOSS * (_FAR.search(near) is not None)
        score = round(min(1.0, max(0.0, score)), 2)
        if kind in BASE_KINDS or score >= THRESHOLD:
            found.append((kind, start, end, score))
    return found


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the upper-case kind in angle brackets."""
    out, at = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each document: key and ``found``, the array of its spans with scores.

    Null and empty text have no spans; rows that repeat are searched one by
    one; other columns are dropped first, so that names cannot clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, type=kind)], ["_key", "found"])

    rows = docs.select(docs[key].alias("_key"), docs[text].alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"_key {kind}, found array<struct<kind:string,start:int,end:int,score:double>>").withColumnRenamed("_key", key)


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of docs with the spans of the text replaced; n_chars, if there, follows the text.

    Null text stays null, with its n_chars; an empty one stays empty; rows that
    repeat are treated one by one; an empty table stays empty.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = names.index(text)
            texts = [t if t is None else redact(t, find(t)) for t in batch.column(i).to_pylist()]
            columns = list(batch.columns)
            columns[i] = pa.array(texts, type=batch.schema.field(i).type)
            if "n_chars" in names:
                n = names.index("n_chars")
                columns[n] = pa.array([old if t is None else len(t) for t, old in zip(texts, columns[n].to_pylist(), strict=True)], type=batch.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(lean(run), docs.schema)
