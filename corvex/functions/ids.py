"""Deterministic ids: the same parts give the same id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _joined(*parts: Column) -> Column:
    return F.concat_ws(":", *[p.cast("string") for p in parts])


def chunk_id(document: Column, index: Column, text_id: Column) -> Column:
    """The document, the chunk's place and the id of its text."""
    return F.concat(F.lit("chunk_"), document, F.lit("_"), F.lpad(index.cast("string"), 5, "0"), F.lit("_"), text_id)


def page_id(document: Column, method: Column, number: Column) -> Column:
    """A page under its extraction method; twelve hex digits of the SHA-1."""
    digest = F.substring(F.sha1(_joined(document, method, number)), 1, 12)
    return F.concat(F.lit("page_"), document, F.lit("_"), method, F.lit("_"), F.lpad(number.cast("string"), 5, "0"), F.lit("_"), digest)


def anchor_id(item: Column, index: Column, quote: Column) -> Column:
    """The place of a quotation of a pack's item; sixteen hex digits of the SHA-1."""
    return F.concat(F.lit("anchor_"), item, F.lit("_"), F.lpad(index.cast("string"), 3, "0"), F.lit("_"), F.substring(F.sha1(_joined(item, index, quote)), 1, 16))


def relevance_id(case: Column, document: Column, source: Column) -> Column:
    """What a source says of a document's relevance to a case."""
    return F.concat(F.lit("rel_"), F.substring(F.sha2(_joined(case, document, source), 256), 1, 32))


def assessment_id(claim: Column, item: Column, role: Column) -> Column:
    """The assessment of an item as evidence for a claim."""
    return F.concat(F.lit("assess_"), F.substring(F.sha2(_joined(claim, item, role), 256), 1, 32))


def summary_id(version: Column, kind: Column, method: Column) -> Column:
    """A summary of a text version."""
    return F.concat(F.lit("docsum_"), F.md5(_joined(version, kind, method)))


def point_id(namespace: str, name: Column) -> Column:
    """A UUID of version 5: the SHA-1 of the namespace's bytes and the name, under the version's marks."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))
