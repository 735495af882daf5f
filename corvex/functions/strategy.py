"""Validation of drafted answers against their pack: what is cited, what isn't, and what a lawyer must see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# References to pack items, words of a legal claim, wording of final advice, outputs that need a reasoning pack.
ITEM = r"\b([A-Za-z0-9][A-Za-z0-9_-]*_item_[0-9]{3})\b"
LEGAL = r"(?i)\b(shall|must|may|cannot|can not|prohibited|entitled|liable|valid|invalid|court|tribunal|act|ordinance|section|article|regulation|appeal|petition|affidavit|jurisdiction|burden|standard)\b"
UNSAFE = r"(?i)\b(final legal advice|will win|guaranteed|strong case|definitely entitled|certainly liable)\b"
REASONED = ("for_against_brief", "preliminary_legal_opinion", "lawyer_review_pack")


def references(text: Column) -> Column:
    """Distinct pack items that a text names."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ITEM), F.lit(1)))


def sentences(answer: Column) -> Column:
    """Sentences as (text, legal, cited); one that only cites belongs to the sentence before it.

    Each raw sentence is judged once; a group's head is a raw sentence that
    isn't a citation of the one before it.
    """
    raw = F.filter(F.transform(F.split(F.coalesce(answer, F.lit("")), r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(raw, lambda x, i: F.struct(x.alias("text"), x.rlike(LEGAL).alias("legal"), x.rlike(ITEM).alias("cited"), (x.rlike(ITEM) & ~x.rlike(LEGAL) & (i > 0)).alias("joins")))


def uncited(parts: Column) -> Column:
    """Numbers (from 1, citations joined to their sentence) of the sentences that claim law without a citation."""
    heads = F.filter(F.transform(parts, lambda x, i: F.struct(x["joins"].alias("joins"), (x["legal"] & ~x["cited"] & ~F.coalesce(F.get(parts, i + 1)["joins"], F.lit(False))).alias("bare"))), lambda x: ~x["joins"])
    return F.array_compact(F.transform(heads, lambda x, i: F.when(x["bare"], i + 1)))


def issues(answers: DataFrame) -> DataFrame:
    """(answer_id, code, path, unknown) of every breach; path says where, unknown which items aren't in the pack.

    answers: answer_id, pack_id, response_pack_id, requested_output, answer,
    allowed (ids of the pack's items), claims and risks (arrays of structs with
    ids), counterarguments (array of counterargument, response, supporting_ids,
    response_ids), reasoning (null or ids, checklist, lawyer_verification).
    Null arrays are empty.
    """
    empty = F.array().cast("array<string>")
    rows = answers.withColumns({"allowed": F.coalesce("allowed", empty), "_parts": sentences(F.col("answer"))})
    allowed = F.col("allowed")
    outside = lambda ids: F.array_sort(F.array_except(F.coalesce(ids, empty), allowed))
    issue = lambda code, path, unknown=None: F.struct(F.lit(code).alias("code"), path.alias("path"), (empty if unknown is None else unknown).alias("unknown"))
    when = lambda test, value: F.array_compact(F.array(F.when(test, value)))
    at = lambda name, i: F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]"))

    def listed(column: str, code: str, ids) -> Column:  # noqa: ANN001
        found = F.transform(F.col(column), lambda x, i: F.when(F.size(outside(ids(x))) > 0, issue(code, at(column, i), outside(ids(x)))))
        return F.coalesce(F.array_compact(found), F.array().cast("array<struct<code:string,path:string,unknown:array<string>>>"))

    both = lambda x: F.array_union(F.coalesce(x["supporting_ids"], empty), F.coalesce(x["response_ids"], empty))
    bare = F.transform("counterarguments", lambda x, i: F.when((F.size(both(x)) == 0) & F.concat_ws(" ", x["counterargument"], x["response"]).rlike(LEGAL), issue("uncited_counterargument", at("counterarguments", i))))
    unnamed = outside(references(F.col("answer")))
    reasoning = F.col("reasoning").isNotNull()
    reasoned = F.when(reasoning, outside(F.col("reasoning.ids"))).otherwise(empty)
    found = [
        listed("claims", "claim_out_of_pack", lambda x: x["ids"]),
        when(F.size(unnamed) > 0, issue("answer_out_of_pack", F.lit("answer"), unnamed)),
        when(~F.col("response_pack_id").eqNullSafe(F.col("pack_id")), issue("pack_id_mismatch", F.lit("pack_id"))),
        F.transform(uncited(F.col("_parts")), lambda i: issue("uncited_legal_sentence", at("answer", i))),
        listed("counterarguments", "counterargument_out_of_pack", both),
        F.coalesce(F.array_compact(bare), F.array().cast("array<struct<code:string,path:string,unknown:array<string>>>")),
        listed("risks", "risk_out_of_pack", lambda x: x["ids"]),
        when(F.size(reasoned) > 0, issue("reasoning_pack_out_of_pack", F.lit("reasoning"), reasoned)),
        when(F.col("requested_output").isin(*REASONED) & ~reasoning, issue("missing_reasoning_pack", F.lit("reasoning"))),
        when(F.coalesce("answer", F.lit("")).rlike(UNSAFE), issue("unsafe_final_advice_wording", F.lit("answer"))),
        when(reasoning & (F.size(F.coalesce(F.col("reasoning.checklist"), empty)) == 0), issue("missing_evidence_checklist_required", F.lit("reasoning.checklist"))),
        when(reasoning & ~F.coalesce(F.col("reasoning.lawyer_verification"), F.lit(False)), issue("lawyer_verification_required", F.lit("reasoning.lawyer_verification"))),
    ]
    return rows.select("answer_id", F.inline(F.concat(*found)))
