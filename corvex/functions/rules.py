"""Rules of the corpus as column expressions: trackers, eligibility, intake, policy, keys and JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvex.functions import classify, registry

# Categories of missing sources by parts of the category's name, then by parts of all fields.
MISSING_BY_NAME = (
    ("02_extraordinary_gazettes", ("extraordinary gazette",)),
    ("01_ordinary_gazettes", ("ordinary gazette",)),
    ("03_legislation_acts_constitution", ("acts", "constitution", "legislation", "ordinance")),
    ("04_government_bills", ("government bills", "bill")),
    ("05_supreme_court", ("supreme court",)),
    ("06_court_of_appeal", ("court of appeal",)),
    ("07_hansard", ("hansard", "parliamentary debates")),
    ("08_parliament_business_records", ("parliament business", "papers presented", "committee proceedings")),
    ("09_law_reports", ("law report", "nlr", "slr")),
    ("10_historical_court_material", ("historical court",)),
    ("11_privy_council_ceylon_appellate", ("privy council", "ceylon appellate")),
    ("12_lower_courts_tribunals", ("high court", "tribunal", "lower-court", "lower court")),
    ("13_provincial_subnational_law", ("provincial", "subnational", "local authority")),
    ("14_administrative_practice_materials", ("practice", "administrative", "circular", "forms")),
    ("15_lankalaw_library", ("lankalaw",)),
    ("16_portal_recovery_and_external_collections", ("lawnet", "commonlii", "portal")),
)
#: The order in which the categories are tried on all fields.
MISSING_BY_TEXT = (15, 16, 11, 10, 12, 13, 14, 2, 1, 4, 7, 8, 5, 6, 9, 3)

# Reviews that end a translation, and the least quality of its text.
ENDED_REVIEWS, LEAST_TRANSLATION = ("superseded_by_official", "rejected"), 0.10
# Labels of authority levels.
AUTHORITY_LABELS = {"primary": 1, "official": 1, "statute": 2, "legislation": 2, "case_law": 3, "secondary": 6}
# Terms of statutes and of case law in a wanted authority.
STATUTE_TERMS = ("act", "section", "gazette", "regulation", "ordinance", "statutory")
CASE_TERMS = ("supreme court", "court of appeal", "case", "appeal", "judgment")
# Languages that a translation may start from.
TRANSLATED = ("sinhala", "sin", "si", "tamil", "tam", "ta")


def any_of(text: Column, parts: tuple[str, ...]) -> Column:
    """Whether a text has any of the parts."""
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def _first(tests: list[tuple[Column, object]], default: object) -> Column:
    return reduce(lambda out, t: F.when(t[0], F.lit(t[1])).otherwise(out), reversed(tests), F.lit(default))


def missing_category(name: Column, *fields: Column) -> Column:
    """Category of a missing source: by its category's name, else by all its fields."""
    low, text = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.concat_ws(" ", name, *fields))
    by_number = {int(c[:2]): (c, parts) for c, parts in MISSING_BY_NAME}
    tests = [(any_of(low, parts), c) for c, parts in MISSING_BY_NAME]
    return _first(tests + [(any_of(text, by_number[n][1]), by_number[n][0]) for n in MISSING_BY_TEXT], "99_other")


def note_value(notes: Column, key: str) -> Column:
    """The last value of a key in ``key=value; …``; null if it isn't there."""
    parts = F.transform(F.split(F.coalesce(notes, F.lit("")), ";"), lambda p: F.trim(p))
    own = F.filter(parts, lambda p: p.contains("=") & (F.trim(F.substring_index(p, "=", 1)) == key))
    return F.trim(F.regexp_replace(F.try_element_at(own, F.lit(-1)), "^[^=]*=", ""))


def translation_eligible(origin: Column, ocr_required: Column, quality: Column, text: Column, review: Column, source_id: Column, gazettes: bool = False) -> Column:
    """Whether a translated text may be chunked: it has text of some quality and no review has ended it."""
    blank = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")) == ""
    test = (F.coalesce(origin, F.lit("")) == "translation") & ~F.coalesce(ocr_required, F.lit(False)) & (F.coalesce(quality, F.lit(0.0)) >= LEAST_TRANSLATION)
    test = test & ~blank & ~F.coalesce(review, F.lit("")).isin(*ENDED_REVIEWS)
    return test if gazettes else test & ~source_id.contains("GAZETTE")


def import_filter(rows: DataFrame, source_ids: tuple = (), document_ids: tuple = (), years: tuple = ()) -> DataFrame:
    """Rows of the asked sources, documents and years; an empty list asks for all."""
    for column, wanted in (("source_id", source_ids), ("document_id", document_ids), ("year", years)):
        rows = rows.where(F.col(column).isin(*wanted)) if wanted else rows
    return rows


def prunable(acquisition: Column, extraction: Column, ocr_required: Column, quality: Column) -> Column:
    """Whether a document's chunks are to go, as it may not be retrieved from any more."""
    keep = (acquisition == "downloaded") & extraction.isin(*registry.READY_STATUSES) & ~F.coalesce(ocr_required, F.lit(False)) & (F.coalesce(quality, F.lit(0.0)) >= registry.LEAST_QUALITY)
    return ~F.coalesce(keep, F.lit(False))


def authority_levels(values: Column) -> Column:
    """Levels of an array of numbers and labels; unknown ones are left out."""
    low = F.transform(values, lambda v: F.lower(F.trim(v)))
    named = F.create_map(*[F.lit(x) for kv in AUTHORITY_LABELS.items() for x in kv])
    return F.filter(F.transform(low, lambda v: F.coalesce(F.when(v.rlike("^[0-9]+$"), v).try_cast("int"), F.try_element_at(named, v))), lambda x: x.isNotNull())


def candidate_type(text: Column) -> Column:
    """What kind of authority a text says is missing."""
    low = F.lower(text)
    tests = [("supreme court",), ("court of appeal",), ("gazette",), ("act", "section", "statutory"), ("nipo",)]
    names = ("Supreme Court case", "Court of Appeal case", "Gazette", "Act", "Official registry material")
    return _first([(any_of(low, t), n) for t, n in zip(tests, names, strict=True)], "Missing authority task")


def candidate_class(kind: Column, title: Column, citation: Column) -> Column:
    """The class of the query that looks for a missing authority."""
    low = F.lower(F.concat_ws(" ", kind, title, citation))
    return _first([(any_of(low, STATUTE_TERMS), "statute_lookup"), (any_of(low, CASE_TERMS), "case_law_lookup")], "general_research")


def candidate_filters(kind: Column, title: Column, citation: Column) -> Column:
    """(authority_levels, document_types) of the search for a missing authority."""
    low = F.lower(F.concat_ws(" ", kind, title, citation))
    statute, case = any_of(low, STATUTE_TERMS), any_of(low, CASE_TERMS)
    pick = lambda test, values, kind: F.when(test, F.array(*map(F.lit, values))).otherwise(F.array().cast(f"array<{kind}>"))
    levels = F.concat(F.array(F.lit(1)), pick(statute, [2], "int"), pick(case, [3], "int"))
    types = F.concat(pick(statute, ["statute", "gazette", "regulation"], "string"), pick(case, ["judgment", "case_law"], "string"))
    return F.struct(levels.alias("authority_levels"), types.alias("document_types"))


def prefixed_id(prefix: str, *parts: Column) -> Column:
    """The prefix and 24 hex digits of the SHA-256 of the parts, one a line."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, 24))


def candidate_title(text: Column) -> Column:
    """The first 120 characters of a text without marks at the end."""
    cut = F.regexp_replace(F.substring(text, 1, 120), "[.:; ]+$", "")
    return F.when(cut == "", "Missing authority candidate").otherwise(cut)


def row_key(document_id: Column, url_id: Column, year: Column, number: Column, title: Column) -> Column:
    """A listing row's id, else the id in its address, else year, number and title."""
    blank = lambda c: F.nullif(F.coalesce(c.cast("string"), F.lit("")), F.lit(""))
    return F.coalesce(blank(document_id), blank(url_id), F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("None")) for c in (year, number, title)]))


def canonical_key(document_id: Column, path: Column, url: Column, title: Column, kind: Column, source: Column, year: Column) -> Column:
    """A document's key: its id, path or address, else title, type, source and year."""
    clean = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s+", " ")))
    named = [F.when(clean(c) != "", F.concat(F.lit(f"{n}:"), clean(c))) for n, c in (("document_id", document_id), ("local_path", path), ("source_url", url))]
    return F.coalesce(*named, F.concat(F.lit("fallback:"), F.concat_ws("|", *map(clean, (title, kind, source, year)))))


def act_number(text: Column, fallback_year: Column) -> Column:
    """(number, year) of ``number/year``; an empty number and the fallback's year otherwise."""
    pattern = r"^\s*0*([0-9]+)\s*/\s*([0-9]{4})\s*"
    found = F.coalesce(text, F.lit("")).rlike(pattern)
    part = lambda i: F.regexp_extract(F.coalesce(text, F.lit("")), pattern, i)
    return F.struct(F.when(found, part(1)).otherwise("").alias("number"), F.when(found, part(2)).otherwise(fallback_year.cast("string")).alias("year"))


def json_matches(payload: Column, path: str, expected: Column) -> Column:
    """(matches, value) of a dotted path in JSON text, where expected is JSON text as well.

    Values are compared with their types: true is not "true", 1 is not "1",
    while 1 is 1.0 and true is 1, as truth values are numbers too; objects and
    arrays are compared by their canonical text.  A path that isn't there matches nothing, null
    matches null.  The value is JSON text, null where the path isn't there.
    """
    node = F.try_parse_json(payload)
    found = F.try_variant_get(node, "$" + "".join(f"['{part}']" for part in path.split(".")), "variant")
    wanted = F.try_parse_json(expected)
    kind = lambda v: F.regexp_replace(F.schema_of_variant(v), r"^(BOOLEAN|BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "NUMBER")
    number = lambda v: F.try_variant_get(v, "$", "decimal(38,9)")
    same = (kind(found) == kind(wanted)) & F.when(kind(found) == "NUMBER", number(found) == number(wanted)).otherwise(F.to_json(found) == F.to_json(wanted))
    return F.struct(F.coalesce(same, F.lit(False)).alias("matches"), F.to_json(found).alias("value"))


def json_string(value: Column) -> Column:
    """The inside of a JSON string: quotes, backslashes and control characters escaped."""
    return F.regexp_replace(F.regexp_replace(F.to_json(F.struct(value.alias("v"))), r'^\{"v":"', ""), r'"\}$', "")


def substitute(payload: Column, values: dict[str, Column]) -> Column:
    """JSON text whose string values have each ``{key}`` replaced; keys of objects stay as they are.

    A string is a value where no colon follows it.  Nulls are put in as empty
    text.
    """
    strings = F.regexp_extract_all(payload, F.lit(JSON_TOKEN), F.lit(0))

    def filled(token: Column) -> Column:
        out = token
        for key, value in values.items():
            out = F.replace(out, F.lit("{" + key + "}"), json_string(F.coalesce(value.cast("string"), F.lit(""))))
        return F.when(token.startswith('"') & ~token.rlike(r":\s*$"), out).otherwise(token)

    return F.array_join(F.transform(strings, filled), "")


#: A string with the colon that makes it a key, or what lies between strings.
JSON_TOKEN = r'(?s)"(?:[^"\\]|\\.)*"(?:\s*:)?|[^"]+'


def label_hash(labels: Column) -> Column:
    """SHA-256 of a map of labels as JSON with sorted keys."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(labels)))), 256)


def lenient_float(text: Column) -> Column:
    """A number, or null."""
    return F.trim(text).try_cast("double")


def lenient_timestamp(text: Column) -> Column:
    """An ISO time, where Z stands for UTC, or null."""
    return F.when(F.trim(text).rlike(r"^\d{4}-\d{2}-\d{2}"), F.trim(text).try_cast("timestamp"))


def missing_source(row: dict[str, Column]) -> dict[str, Column]:
    """A missing source's row with defaults; its priority follows from the importance."""
    clean = {k: F.trim(F.coalesce(c, F.lit(""))) for k, c in row.items()}
    some = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])
    importance = F.lower(clean["legal_importance"])
    return {
        "external_missing_id": clean["missing_id"],
        "category": some(clean["data_category"], F.lit("Unclassified")),
        "title": some(clean["missing_description"], clean["data_category"], F.lit("Missing source")),
        "year": classify.lenient_int(row["year"]),
        "reason": some(clean["missing_description"], F.lit("Missing source requires verification.")),
        "next_action": some(clean["next_action"], F.lit("Locate and verify source.")),
        "priority": F.when(importance.isin("critical", "high", "normal", "low"), importance).otherwise("normal"),
        "status": some(clean["status"], F.lit("open")),
        "last_checked": lenient_timestamp(row["last_checked"]),
    }


# What a request asks for, by risk, the first that holds.
REQUEST_RISKS = (
    (r"\b(strategy|argument|counterargument|submission|petition|appeal|affidavit|draft|pleading)\b", "high"),
    (r"\b(court|judge|tribunal|supreme court|court of appeal|high court)\b", "high"),
    (r"\b(summarize|explain|compare|find|search)\b", "medium"),
)
OUTPUT_RISKS = ((("submission", "petition", "affidavit", "strategy", "counterargument"), "high"), (("summary", "research", "memo"), "medium"))
RISKS = ("low", "medium", "high", "critical")


def request_risk(text: Column) -> Column:
    """The risk of what a request asks for."""
    return _first([(text.rlike(f"(?i){p}"), r) for p, r in REQUEST_RISKS], "low")


def output_risk(output: Column) -> Column:
    """The risk of a kind of output."""
    low = F.lower(F.replace(output, F.lit("_"), F.lit(" ")))
    return _first([(any_of(low, parts), r) for parts, r in OUTPUT_RISKS], "low")


def highest(*risks: Column) -> Column:
    """The highest of some risks."""
    places = [F.array_position(F.array(*map(F.lit, RISKS)), r) for r in risks]
    return F.element_at(F.array(*map(F.lit, RISKS)), (F.greatest(*places) if len(places) > 1 else places[0]).cast("int"))


def review_role(risk: Column) -> Column:
    """Who must review work of a risk; ``none`` for low risk."""
    return F.when(risk.isin("high", "critical"), "qualified_lawyer").when(risk == "medium", "lawyer_or_supervised_legal_reviewer").otherwise("none")


def text_policy(text: Column) -> Column:
    """(status, risk, codes, reviewer) of a text: blocked if it has a prohibited pattern, else allowed at low risk only."""
    codes, own = classify.policy_hits(text), classify.policy_risk(text)
    risk = highest(own, request_risk(text))
    status = F.when(F.size(codes) > 0, "block").when(risk == "low", "allow").otherwise("review_required")
    return F.struct(status.alias("status"), risk.alias("risk"), codes.alias("codes"), review_role(risk).alias("reviewer"))


def source_warnings(tiers: Column, levels: Column, flags: Column) -> Column:
    """Codes of the warnings on a pack's sources: arrays of its items' tiers, levels and quality flags."""
    empty = F.size(tiers) == 0
    bad = F.array(*map(F.lit, ("empty_text", "unusable_ocr", "low_confidence_ocr", "low_ocr_confidence", "low_alphanumeric_ratio")))
    tests = (
        (empty, "no_items"),
        (~empty & F.forall(tiers, lambda t: t.isin("secondary", "unverified")), "no_primary_source"),
        (F.array_contains(tiers, "unverified"), "unverified_source"),
        (F.exists(levels, lambda x: x >= 6), "secondary_material"),
        (F.arrays_overlap(flags, bad), "quality_flags"),
        (F.array_contains(flags, "translated_text_fallback"), "translated_fallback"),
        (F.array_contains(flags, "machine_translation_unreviewed"), "unreviewed_translation"),
    )
    return F.array_compact(F.array(*[F.when(t, F.lit(c)) for t, c in tests]))


# Signals of an intake text that only some texts need.
REGISTRATION_RE = r"(?i)\b(?:registration|reg\.?\s*no\.?|trademark\s+no\.?|mark\s+no\.?)\b"
AUTHORITY_TASK_RE = r"(?i)\b(?:act|section|supreme court|court of appeal|gazette|case[- ]law|authority|amendment|current[- ]treatment|nipo|statutory|regulation|ordinance)\b"


def clarifications(text: Column, reasoning: Column) -> Column:
    """(category, blocks) of what an intake text leaves open, in the order in which it is asked."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    low, signals = F.lower(flat), dict(registry.INTAKE)
    tests = (
        (~flat.rlike(signals["client_position"]), "client_position", reasoning),
        (~flat.rlike(signals["parties"]), "parties", F.lit(False)),
        (~flat.rlike(signals["dates"]), "dates", reasoning),
        (low.contains("trademark") & ~flat.rlike(REGISTRATION_RE), "registration_number", F.lit(True)),
        (low.contains("judgment") & ~flat.rlike(signals["case_number"]), "case_number", F.lit(True)),
    )
    return F.array_compact(F.array(*[F.when(t, F.struct(F.lit(c).alias("category"), b.alias("blocks"))) for t, c, b in tests]))


# What is to be done for each searchability class, and the plans for languages.
ACTIONS = {
    "needs_original_asset": "Sync the original document into object storage and record a primary file asset.",
    "needs_page_extraction": "Run PDF text-layer extraction; if it produces empty pages, route the document to OCR.",
    "needs_ocr_or_text_recovery": "Run OCR or manual text recovery, then reload pages and rebuild text versions/chunks.",
    "needs_text_version": "Build current-pages-v1 document_text_versions and extracted-text assets from pages.",
    "needs_translation_fallback": "Generate an English translation document_text_versions row with text_origin='translation' and machine-review status before English-only drafting uses it.",
    "needs_chunk_indexing": "Build retrieval chunks from pages and load them into Postgres/OpenSearch/Qdrant.",
    "fully_searchable": "No action required.",
}
PLANS = {
    "translate": "Keep original source-language text; create an explicitly labelled English translation text version until an official English document is acquired.",
    "detect": "Detect the source language before deciding whether an English translation fallback is required.",
    "original": "Use original English source text.",
}


def recovery_plan(language: Column, classification: Column) -> Column:
    """(next_action, language_plan) of a document by its searchability class."""
    low = F.lower(F.trim(F.coalesce(language, F.lit(""))))
    plan = F.when(low.isin(*TRANSLATED), PLANS["translate"]).when(~low.isin("english", "en", ""), PLANS["detect"]).otherwise(PLANS["original"])
    return F.struct(_first([(classification == k, v) for k, v in ACTIONS.items()], ACTIONS["fully_searchable"]).alias("next_action"), plan.alias("language_plan"))


def latest_run(runs: DataFrame, collection: str) -> DataFrame:
    """The last complete embedding run of a collection or of none in particular; runs without an end come last."""
    own = runs.where((F.col("status") == "complete") & ((F.col("collection") == collection) | F.col("collection").isNull()))
    return own.orderBy(F.col("completed_at").desc_nulls_last(), F.col("run_id").desc()).limit(1)


def run_mismatches(provider: str, model: str, dimensions: int) -> Column:
    """What of a run differs from a configuration; an empty array if they fit together."""
    tests = {"provider": F.col("provider") != provider, "model": F.col("model") != model, "dimensions": F.col("dimensions") != dimensions}
    return F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))


PACK_SCHEMA = "1.0"


def pack_issues(packs: DataFrame, items: DataFrame) -> DataFrame:
    """(pack_id, code, n) of the breaches of a pack's contract.

    packs: pack_id, pack_hash, sealed_hash, schema_version, pack_version,
    token_count, max_tokens, n_trace, n_missing; items: pack_id, item (from 1),
    pack_item_id, citation, text, tokens, n_trace.  Items are combined before
    the packs are joined with them.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    expected = F.concat(F.col("pack_id").cast("string"), F.lit("_item_"), F.lpad(F.col("item").cast("string"), 3, "0"))
    own = items.groupBy("pack_id").agg(
        F.count("*").alias("items"),
        (F.count("*") - F.countDistinct("pack_item_id")).alias("repeated"),
        F.count_if(~F.col("pack_item_id").eqNullSafe(expected)).alias("non_canonical_pack_item_id"),
        F.count_if(blank("citation")).alias("missing_citation"),
        F.count_if(blank("text")).alias("empty_selected_text"),
        F.count_if(F.coalesce(F.col("tokens"), F.lit(0)) <= 0).alias("missing_token_estimate"),
        F.count_if(F.coalesce(F.col("n_trace"), F.lit(0)) == 0).alias("missing_item_retrieval_trace"),
        F.sum(F.coalesce("tokens", F.lit(0))).alias("total"),
    )
    rows = packs.join(own, "pack_id", "left").fillna(0, ["items", "repeated", "total"])
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    counts = {
        "pack_hash_mismatch": flag((F.coalesce("pack_hash", F.lit("")) != "") & (F.col("pack_hash") != F.col("sealed_hash"))),
        "schema_version_mismatch": flag(~F.col("schema_version").eqNullSafe(F.lit(PACK_SCHEMA))),
        "invalid_pack_version": flag(F.col("pack_version") < 1),
        "duplicate_pack_item_id": flag(F.col("repeated") > 0),
        **{k: F.coalesce(F.col(k), F.lit(0)) for k in ("non_canonical_pack_item_id", "missing_citation", "empty_selected_text", "missing_token_estimate", "missing_item_retrieval_trace")},
        "token_count_mismatch": flag(~F.col("token_count").eqNullSafe(F.col("total"))),
        "token_budget_exceeded": flag((F.coalesce("max_tokens", F.lit(0)) > 0) & (F.coalesce("token_count", F.lit(0)) > F.col("max_tokens"))),
        "missing_pack_retrieval_trace": flag((F.col("items") > 0) & (F.coalesce("n_trace", F.lit(0)) == 0)),
        "empty_pack_without_missing_source_warning": flag((F.col("items") == 0) & (F.coalesce("n_missing", F.lit(0)) == 0)),
    }
    found = F.array(*[F.struct(F.lit(k).alias("code"), c.cast("long").alias("n")) for k, c in counts.items()])
    return rows.select("pack_id", F.inline(F.filter(found, lambda x: x["n"] > 0)))
