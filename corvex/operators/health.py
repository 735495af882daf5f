"""Health of a corpus: checks that must count nothing, minimum counts, stored hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvex.operators.chunking import hash_mismatches

# Names of the checks, kinds of assets and digests, states of packs and claims.
ORIGINAL, ORIGINAL_DIGEST, TEXT_DIGEST, ALGORITHM, CURRENT = "original", "original_file", "extracted_full_text", "sha256", "current-pages-v1"
ACTIVE_PACKS = ("complete", "active")


def _blank(column: str) -> Column:
    return F.length(F.trim(F.coalesce(F.col(column).cast("string"), F.lit("")))) == 0


def _empty(column: str) -> Column:
    """Blank text; null is unknown, which counts for nothing."""
    return F.length(F.trim(F.col(column).cast("string"))) == 0


def _counts(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row for each check over the same rows, which are read once."""
    total = rows.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items()])
    return total.select(F.inline(F.array(*[F.struct(F.lit(k).alias("check_name"), F.col(k).alias("n")) for k in checks])))


def zero_counts(t: dict[str, DataFrame]) -> DataFrame:
    """(check_name, n, ok) of the seventeen checks, and of the chunks whose text doesn't have its stored hash.

    t: documents (document_id, provider, bucket, object_key, primary_asset_id),
    pages (document_id, page_number, text), chunks (document_id, chunk_id,
    source_id, document_type, title, authority_level, token_estimate, citation,
    chunk_text, text_hash, page_start, page_end), packs (pack_id, status),
    pack_items (pack_id), case_packs (pack_id, status), claims (claim_id,
    support_status), claim_citations (claim_id), assets (document_id,
    asset_kind, is_primary), digests (document_id, text_version_id, digest_type,
    algorithm), text_versions (document_id, text_version_id, version_label,
    text_asset_id).

    What is there for a document is gathered by one exchange over marks, so
    that no document waits for a join with each table.
    """
    mark = lambda rows, name: rows.select("document_id", F.lit(name).alias("mark"))
    pages = t["pages"].withColumn("_text", ~_blank("text"))
    marks = [
        mark(t["documents"], "document"),
        pages.select("document_id", F.explode(F.array_compact(F.array(F.lit("page"), F.when(F.col("_text"), F.lit("text_page"))))).alias("mark")),
        mark(t["chunks"], "chunk"),
        mark(t["assets"].where((F.col("asset_kind") == ORIGINAL) & F.col("is_primary")), "asset"),
        mark(t["digests"].where((F.col("digest_type") == ORIGINAL_DIGEST) & (F.col("algorithm") == ALGORITHM)), "digest"),
        mark(t["text_versions"].where(F.col("version_label") == CURRENT), "version"),
    ]
    own = reduce(DataFrame.unionByName, marks).groupBy("document_id").agg(F.collect_set("mark").alias("m"))
    has = lambda name: F.array_contains("m", name)
    documents = _counts(
        own,
        {
            "documents_without_pages": has("document") & has("chunk") & ~has("page"),
            "documents_without_text_pages": has("document") & has("chunk") & ~has("text_page"),
            "documents_without_chunks": has("document") & has("text_page") & ~has("chunk"),
            "chunked_documents_without_text_pages": has("chunk") & ~has("text_page"),
            "documents_without_primary_file_asset": has("document") & ~has("asset"),
            "documents_without_original_digest": has("document") & ~has("digest"),
            "documents_with_text_pages_without_text_version": has("document") & has("text_page") & ~has("version"),
        },
    )
    stored = _counts(t["documents"], {"documents_without_object_storage_key": reduce(lambda a, b: a | b, [F.col(c).isNull() for c in ("provider", "bucket", "object_key", "primary_asset_id")])})
    needed = reduce(lambda a, b: a | b, [F.coalesce(_empty(c), F.lit(False)) for c in ("document_id", "source_id", "document_type", "title")])
    chunks = _counts(
        t["chunks"],
        {
            "chunks_with_empty_text": _empty("chunk_text"),
            "chunks_missing_citation": _blank("citation"),
            "chunks_missing_required_metadata": needed | F.col("authority_level").isNull() | (F.coalesce("token_estimate", F.lit(0)) <= 0),
        },
    )
    count = lambda rows, name: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("check_name"), "n")
    # A chunk's pages are looked up one by one: as many rows as pages that chunks span.
    spans = t["chunks"].where("page_start is not null").select("chunk_id", "document_id", "page_start", F.greatest("page_start", F.coalesce("page_end", "page_start")).alias("_end"))
    listed = spans.select("chunk_id", "document_id", F.explode(F.sequence("page_start", "_end")).alias("page_number"))
    found = listed.join(pages.where("_text").select("document_id", "page_number").distinct(), ["document_id", "page_number"], "left_semi").select("chunk_id").distinct()
    packs = t["packs"].where(F.col("status").isin(*ACTIVE_PACKS))
    inactive = t["case_packs"].where("status = 'active'").select("pack_id").join(t["packs"].where(~F.col("status").isin(*ACTIVE_PACKS)).select("pack_id"), "pack_id")
    digested = t["digests"].where((F.col("digest_type") == TEXT_DIGEST) & (F.col("algorithm") == ALGORITHM) & F.col("text_version_id").isNotNull()).select("text_version_id")
    rest = [
        count(spans.join(found, "chunk_id", "left_anti"), "chunks_with_invalid_page_anchor"),
        count(packs.join(t["pack_items"].select("pack_id"), "pack_id", "left_anti"), "active_research_packs_without_items"),
        count(inactive, "active_case_packs_with_inactive_pack"),
        count(t["claims"].where("support_status = 'supported'").join(t["claim_citations"].select("claim_id"), "claim_id", "left_anti"), "supported_claims_without_citations"),
        count(t["text_versions"].where("text_asset_id is null"), "text_versions_without_text_asset"),
        count(t["text_versions"].join(digested, "text_version_id", "left_anti"), "text_versions_without_text_digest"),
        count(hash_mismatches(t["chunks"]), "chunks_with_wrong_text_hash"),
    ]
    every = reduce(DataFrame.unionByName, [documents, stored, chunks, *rest])
    return every.select("check_name", "n", (F.col("n") == 0).alias("ok"))


def minimums(t: dict[str, DataFrame], least: dict[str, int]) -> DataFrame:
    """(check_name, n, ok) of tables that must have a number of rows."""
    rows = [t[k].agg(F.count("*").alias("n")).select(F.lit(f"minimum_{k}").alias("check_name"), "n", (F.col("n") >= n).alias("ok")) for k, n in least.items()]
    return reduce(DataFrame.unionByName, rows)
