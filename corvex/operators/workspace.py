"""Workspaces of cases: who may see what, relevance of documents, reviews and their decisions, load summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvex.functions import ids

# Bands of relevance, states of reviewed items, kinds that are approved as they are.
BANDS = ((0.95, "direct"), (0.75, "strong"), (0.45, "moderate"), (0.10, "weak"))
PLAIN_KINDS = ("draft", "adverse_evidence", "missing_evidence", "clarification_need", "authority_candidate")
DECISIONS = ("approved", "rejected", "changes_requested")


def relevance_band(score: Column) -> Column:
    """The band of a relevance from 0 to 1."""
    out = F.when(score >= BANDS[0][0], BANDS[0][1])
    for least, name in BANDS[1:]:
        out = out.when(score >= least, name)
    return out.when(score > 0, "background").otherwise("irrelevant")


def pack_relevance(items: DataFrame) -> DataFrame:
    """(relevance_id, case_id, document_id, relevance_score, confidence_score, evidence) of the documents of packs.

    items: case_id, document_id, pack_item_id, fused_score, multiplier (null is
    1).  Scores are cut to 0 and 1; the best item gives a document its scores,
    and the ids of its items are listed by score.
    """
    cut = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    score = cut(F.coalesce("fused_score", F.lit(0.0)))
    rows = items.withColumns({"_s": score, "_c": cut(score * F.coalesce("multiplier", F.lit(1.0)))})
    entry = F.struct((-F.col("_s")).alias("s"), F.col("pack_item_id").alias("i"))
    out = rows.groupBy("case_id", "document_id").agg(F.round(F.max("_s"), 6).alias("relevance_score"), F.round(F.max("_c"), 6).alias("confidence_score"), F.array_sort(F.collect_list(entry)).alias("_e"))
    key = ids.relevance_id(F.col("case_id").cast("string"), F.col("document_id"), F.lit("retrieval"))
    return out.select(key.alias("relevance_id"), "case_id", "document_id", "relevance_score", "confidence_score", F.array_join("_e.i", "|").alias("evidence"))


def merge_relevance(old: DataFrame, new: DataFrame) -> DataFrame:
    """The relevance table after an upsert: the larger scores and the band that goes with them; a rejected row is a candidate again; evidence is the new one's."""
    n = new.select("relevance_id", "case_id", "document_id", *[F.col(c).alias(f"_{c}") for c in ("relevance_score", "confidence_score", "evidence")])
    o = old.select("relevance_id", "case_id", "document_id", "relevance_score", "confidence_score", "evidence", "status")
    rows = o.join(n, ["relevance_id", "case_id", "document_id"], "full_outer")
    score = F.greatest("relevance_score", "_relevance_score")
    fresh = F.col("_relevance_score").isNotNull()
    status = F.when(F.col("status").isNull() | (fresh & (F.col("status") == "rejected")), "candidate").otherwise(F.col("status"))
    return rows.select("relevance_id", "case_id", "document_id", score.alias("relevance_score"), F.greatest(F.coalesce("confidence_score", F.lit(0.0)), F.coalesce("_confidence_score", F.lit(0.0))).alias("confidence_score"), relevance_band(score).alias("relevance_band"), status.alias("status"), F.when(fresh, F.col("_evidence")).otherwise(F.col("evidence")).alias("evidence"))


def target_status(kind: Column, decision: Column) -> Column:
    """What a reviewed item becomes; null for a kind or decision that isn't known."""
    known = decision.isin(*DECISIONS)
    claim = F.when(decision == "approved", "lawyer_approved").otherwise(decision)
    return F.when(known & kind.isin(*PLAIN_KINDS), decision).when(known & (kind == "legal_claim"), claim)


def decide(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Review items (review_item_id, item_type, status) after their last decision (review_item_id, decision, decided_at): closed with the item's new status; what is closed already, and what isn't known, stays.

    Of decisions of the same time the one with the smallest ``place`` (any type
    with an order) counts; without that column, the last by name.
    """
    times = decisions
    if "place" in decisions.columns:
        times = decisions.groupBy("review_item_id", "decided_at").agg(F.min_by("decision", "place").alias("decision"))
    last = times.groupBy("review_item_id").agg(F.max_by("decision", F.struct("decided_at", "decision")).alias("decision"))
    rows = items.join(last, "review_item_id", "left")
    target = target_status(F.col("item_type"), F.col("decision"))
    done = (F.col("status") == "pending") & target.isNotNull()
    return rows.select("review_item_id", "item_type", F.when(done, "completed").otherwise(F.col("status")).alias("status"), F.when(done, target).alias("item_status"))


def reachable(user_id: int, permissions: DataFrame, users: DataFrame) -> DataFrame:
    """Cases (case_id) that an active user has a permission for."""
    active = users.where((F.col("user_id") == user_id) & (F.col("status") == "active")).select("user_id")
    return permissions.where(F.col("user_id") == user_id).join(active, "user_id", "left_semi").select("case_id").distinct()


def lookups(cases: DataFrame, threads: DataFrame, messages: DataFrame, runs: DataFrame) -> DataFrame:
    """(lookup, key, case_id) of what belongs to the given cases: threads (thread_id, case_id), messages (message_id, thread_id), agent runs (run_id, thread_id)."""
    own = threads.join(cases.select("case_id"), "case_id", "left_semi").select("thread_id", "case_id").distinct()
    named = lambda rows, name, key: rows.select(F.lit(name).alias("lookup"), F.col(key).cast("string").alias("key"), "case_id")
    return named(own, "thread", "thread_id").unionByName(named(messages.join(own, "thread_id"), "message", "message_id")).unionByName(named(runs.join(own, "thread_id"), "agent_run", "run_id"))


def percentiles(rows: DataFrame, by: str, value: str, shares: tuple[float, ...], accuracy: int = 1000) -> DataFrame:
    """(by, p0, p1, ...) exact percentiles, interpolated between neighbours.

    A mergeable sketch brackets the two ranks that each percentile lies between;
    a second pass counts what is below the bracket and sorts only what is in it,
    so that no task holds all values of a group.  The bracket's ends are two
    errors of the sketch away on both sides, which is more than one rank for
    groups of 2 * accuracy values; smaller groups are their own bracket.
    """
    clean = rows.where(F.col(value).isNotNull()).select(F.col(by).alias("_g"), F.col(value).cast("double").alias("_v"))
    margin = 2.0 / accuracy
    ends = [x for p in shares for x in (max(0.0, p - margin), min(1.0, p + margin))]
    sketch = clean.groupBy("_g").agg(F.count("*").alias("n"), F.percentile_approx("_v", ends, accuracy).alias("e"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    out = None
    for i, p in enumerate(shares):
        small = F.col("n") < 2 * accuracy
        a = F.when(small | (F.lit(p - margin) <= 0), F.col("low")).otherwise(F.col("e")[2 * i])
        b = F.when(small | (F.lit(p + margin) >= 1), F.col("high")).otherwise(F.col("e")[2 * i + 1])
        bracket = sketch.select("_g", "n", a.alias("a"), b.alias("b"))
        found = clean.join(bracket, "_g")
        counts = found.groupBy("_g", "n", "a", "b").agg(F.count_if(F.col("_v") < F.col("a")).alias("below"))
        inside = found.where((F.col("_v") >= F.col("a")) & (F.col("_v") <= F.col("b"))).groupBy("_g", "_v").agg(F.count("*").alias("c"))
        upto = F.sum("c").over(Window.partitionBy("_g").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        placed = inside.withColumn("upto", upto).join(counts, "_g")
        rank = F.lit(p) * (F.col("n") - 1)
        at = lambda r: F.min(F.when(F.col("below") + F.col("upto") > r, F.col("_v")))  # noqa: B023, E731
        part = placed.groupBy("_g").agg(at(F.floor(rank)).alias("x"), at(F.ceil(rank)).alias("y"), F.first(rank).alias("r"))
        part = part.select("_g", (F.col("x") + (F.col("y") - F.col("x")) * (F.col("r") - F.floor("r"))).alias(f"p{i}"))
        out = part if out is None else out.join(part, "_g")
    return out.withColumnRenamed("_g", by)
