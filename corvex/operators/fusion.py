"""Query intents, reciprocal-rank fusion, quality rerank, and packs under a budget."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvex.functions import classify, text as tx

# Expansion words of the five intents, and signal words.
INTENTS = {
    "supportive": ("supports", "establishes", "authority", "legal basis"),
    "adverse": ("contrary authority", "distinguish", "weakens", "adverse"),
    "limitation": ("limitation", "barred", "time limit", "threshold"),
    "exception": ("exception", "unless", "exemption", "qualification"),
    "procedural_risk": ("burden of proof", "jurisdiction", "procedure", "admissibility"),
}
ADVERSE_TERMS = (
    "adverse", "against", "contrary", "distinguish", "distinguished", "overrule", "overruled", "barred", "limitation", "prescription", "exception",
    "unless", "exempt", "qualification", "threshold", "burden", "jurisdiction", "procedure", "admissibility", "delay", "waiver", "estoppel",
)
SUPPORTIVE_TERMS = ("supports", "establishes", "entitled", "right", "shall", "must", "duty", "liable", "remedy", "relief")
EXACT_BOOST, RRF_K = 0.10, 60


def expand(spark: SparkSession, queries: DataFrame) -> DataFrame:
    """Each query (query_id, query) under the five intents."""
    intents = spark.createDataFrame([(k, list(v)) for k, v in INTENTS.items()], "intent string, expansion_terms array<string>")
    base = F.array_join(tx.words(F.col("query")), " ")
    rows = queries.crossJoin(F.broadcast(intents))  # five rows
    return rows.select("query_id", "intent", F.concat_ws(" ", base, F.array_join("expansion_terms", " ")).alias("query"), F.concat_ws(":", "intent", classify.slug(F.concat_ws(" ", base, F.array_join("expansion_terms", " ")))).alias("query_variant_id"), "expansion_terms")


def with_terms(hits: DataFrame) -> DataFrame:
    """Adds the terms of title, citation and the text's beginnings, so that a text needn't go through the cross with the intents."""
    parts = {"_title": F.col("title"), "_citation": F.col("citation"), "_head": F.substring("text", 1, 1000), "_seen": F.concat_ws(" ", "title", "citation", F.substring("text", 1, 2000))}
    return hits.withColumns({k: tx.terms(c) for k, c in parts.items()})


def with_signals(variants: DataFrame) -> DataFrame:
    """Adds the terms of a variant's query and its adverse signals."""
    signals = F.array_union(F.array(*map(F.lit, ADVERSE_TERMS)), tx.terms(F.array_join("expansion_terms", " ")))
    return variants.withColumns({"_asked": tx.terms(F.col("query")), "_signals": signals})


def intent_features(hits: DataFrame, current_year: int) -> DataFrame:
    """Adds the intent scores to hits (query, intent, expansion_terms, title, citation, text, authority_level, year, exact).

    Terms are read from texts and queries unless ``with_terms`` and
    ``with_signals`` have been there before.
    """
    hits = hits if "_seen" in hits.columns else with_terms(hits)
    hits = hits if "_asked" in hits.columns else with_signals(hits)
    asked, seen, signals = F.col("_asked"), F.col("_seen"), F.col("_signals")
    share = lambda c: F.when(F.size(asked) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(asked, F.col(c))) / F.size(asked))
    mixed = 0.45 * share("_title") + 0.45 * share("_citation") + 0.10 * share("_head")
    exactness = F.when(F.col("exact"), F.lit(1.0)).otherwise(F.least(F.lit(1.0), mixed))
    against = F.col("intent") != "supportive"
    adverse = F.when(F.size(seen) == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.size(F.array_intersect(seen, signals)) / 6 + F.when(against, 0.2).otherwise(0.0)))
    supportive = F.least(F.lit(1.0), F.size(F.array_intersect(seen, F.array(*map(F.lit, SUPPORTIVE_TERMS)))) / 5)
    authority, recency = classify.authority_score(F.col("authority_level")), classify.recency_score(F.col("year"), current_year)
    hits = hits.withColumns({"authority_score": authority, "recency_score": recency, "exactness_score": exactness, "adverse_relevance_score": adverse, "_signal": F.when(against, adverse).otherwise(supportive)})
    total = 0.85 + 0.25 * F.col("authority_score") + 0.15 * F.col("recency_score") + 0.25 * F.col("exactness_score") + 0.25 * F.col("_signal") + F.when(against, 0.08).otherwise(0.0)
    return hits.withColumn("intent_score_multiplier", total).drop("_signal", "_title", "_citation", "_head", "_seen", "_asked", "_signals")


def tag(hits: DataFrame) -> DataFrame:
    """Hits with their score multiplied and their intent in the retriever's name."""
    return hits.withColumns({"score": F.col("score") * F.col("intent_score_multiplier"), "retriever": F.concat_ws(":", "retriever", "intent")})


def reciprocal_rank_fusion(hits: DataFrame, k: int = RRF_K) -> DataFrame:
    """One row for each chunk_id of the ranked lists (result_set, rank, chunk_id, score, retriever, authority_level, exact).

    The attributes are those of the hit with the largest raw score, of equal
    ones the first seen.  Where the hits have intents and variants of their
    query (intent, query_variant_id), all that found the chunk are kept, in
    order.  One exchange by chunk_id with sums made before it.
    """
    kept = {name: column for name, column in (("query_intents", "intent"), ("query_variant_ids", "query_variant_id")) if column in hits.columns}
    point = 1.0 / (k + F.col("rank")) + F.when(F.col("exact"), EXACT_BOOST / F.col("rank")).otherwise(0.0)
    first = F.struct((-F.col("score")).alias("s"), F.col("result_set").alias("r"), F.col("rank").alias("k"))
    others = [c for c in hits.columns if c not in ("chunk_id", "score", "rank", "result_set", "retriever")]
    fused = hits.groupBy("chunk_id").agg(
        F.sum(point).alias("points"),
        F.array_sort(F.collect_set(F.concat_ws(" ", "retriever", F.lit("rank"), "rank"))).alias("retrieval_evidence"),
        F.min_by(F.struct(*others), first).alias("best"),
        F.min(F.struct("result_set", "rank")).alias("first_seen"),
        *[F.array_sort(F.collect_set(column)).alias(name) for name, column in kept.items()],
    )
    fused = fused.select("chunk_id", "best.*", "points", "retrieval_evidence", "first_seen", *kept)
    return fused.withColumn("score", F.col("points") * classify.authority_boost(F.col("authority_level")))


# What a quality flag does to a score.
FLAG_MULTIPLIERS = (
    (("low_confidence_ocr", "low_ocr_confidence"), 0.70),
    (("missing_page_anchor",), 0.80),
    (("unofficial_source",), 0.88),
    (("translated_text_fallback",), 0.85),
    (("machine_translation_unreviewed",), 0.75),
    (("current_consolidated_law",), 1.10),
)


def quality_multiplier(level: Column, flags: Column, exact: Column) -> Column:
    """Product of the authority boost, the flags' factors and 1.25 for an exact citation."""
    out = classify.authority_boost(level)
    for names, factor in FLAG_MULTIPLIERS:
        out = out * F.when(F.arrays_overlap(flags, F.array(*map(F.lit, names))), factor).otherwise(1.0)
    return out * F.when(F.array_contains(flags, "exact_citation_match") | F.coalesce(exact, F.lit(False)), 1.25).otherwise(1.0)


def select_pack(hits: DataFrame, max_items: int, max_tokens: int, pack_id: str = "pack_id") -> DataFrame:
    """Items of each pack in order of seq: what would go over the budget is skipped, the first always stays.

    A fold over all of a pack's ranked hits (columns pack_id, seq, chunk_id,
    document_id, tokens).
    """
    entry = F.struct("seq", "chunk_id", "document_id", "tokens")
    listed = hits.groupBy(pack_id).agg(F.array_sort(F.collect_list(entry)).alias("hits"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.expr("cast(array() as array<struct<item:int,chunk_id:string,document_id:string,tokens:bigint,note:string>>)").alias("items"))

    def step(acc: Column, h: Column) -> Column:
        n = F.size(acc["items"])
        full = (n >= max_items) | ((n > 0) & (acc["used"] + h["tokens"] > max_tokens))
        note = F.when(F.exists(acc["items"], lambda i: i["document_id"] == h["document_id"]), "high authority").otherwise("new source document")
        item = F.struct((n + 1).alias("item"), h["chunk_id"].alias("chunk_id"), h["document_id"].alias("document_id"), h["tokens"].cast("long").alias("tokens"), note.alias("note"))
        return F.when(full, acc).otherwise(F.struct((acc["used"] + h["tokens"]).cast("long").alias("used"), F.concat(acc["items"], F.array(item)).alias("items")))

    packed = listed.select(pack_id, F.aggregate("hits", start, step)["items"].alias("items"))
    items = packed.select(pack_id, F.inline("items"))
    return items.withColumn("pack_item_id", F.concat(F.col(pack_id).cast("string"), F.lit("_item_"), F.lpad(F.col("item").cast("string"), 3, "0")))


def normalise_max(column: str, by: str) -> Column:
    """A value over its group's maximum, kept from 0 to 1; 0 where the maximum isn't positive."""
    from pyspark.sql import Window

    most = F.max(column).over(Window.partitionBy(by))
    return F.when(most <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(column) / most)))


def stage2_blend(parts: dict[str, Column]) -> Column:
    """The weighted sum of normalised parts of the second ranking stage."""
    weights = {"stage1": 0.22, "full_text": 0.34, "chunk": 0.20, "coverage": 0.15, "title": 0.07, "phrase": 0.02}
    return reduce(lambda a, b: a + b, [w * parts[k] for k, w in weights.items()])
