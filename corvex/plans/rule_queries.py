"""Queries over the rules of the corpus: trackers, eligibility, policy, keys, JSON, packs, built-in patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvex.functions import classify, registry, rules, text as tx
from corvex.sources.tables import CORPUS_SQL, corpus, table


def _pick(values: list, by: Column) -> Column:
    """One of the values by a number."""
    return F.get(F.array(*map(F.lit, values)), F.pmod(by, F.lit(len(values))).cast("int"))


def _sql_pick(values: list, by: str) -> str:
    """The same in SQL."""
    quoted = ", ".join("NULL" if v is None else str(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{quoted}])[(({by}) % {len(values)} + 1)::INT]"


SOURCES = ["GOV_GAZETTES", "GOV_EXTRA_GAZETTES", "PARL_GOV_BILLS", "SC_OFFICIAL", "CA_OFFICIAL", "PARL_HANSARD_2020", "UVA_HEALTH_STATUTES", "UVA_PSC_LEGAL_PROVISIONS", "CBSL_RULES_DIRECTIONS", "PARL_ACTS", "PARL_MINUTES", "LANKALAW_NET", "OTHER"]
KINDS = ["Act", "Supreme Court Judgment", "Court of Appeal Judgment", "New Law Report", "Provincial Statute", "Constitution", "Order Paper", "Provincial Rule"]


def tracker_have(spark: SparkSession, folder: str) -> DataFrame:
    """Tracker rows of documents that are there, by category and status, with names looked up in a small table."""
    names = table(spark, folder, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("owner"))  # 25 rows at any size
    rows = table(spark, folder, "orders").select("o_orderkey", "o_custkey", _pick(SOURCES, F.col("o_orderkey")).alias("source_id"), _pick(KINDS, F.col("o_custkey")).alias("kind"), _pick(["Rules", "Provincial Rules"], F.col("o_custkey")).alias("title"))
    rows = rows.withColumn("category", registry.category(F.col("source_id"), F.col("kind"), F.col("title"))).join(F.broadcast(names), F.pmod("o_custkey", F.lit(25)) == F.col("key"))
    return rows.groupBy("category", "owner").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


_S, _K = _sql_pick(SOURCES, "o_orderkey"), _sql_pick(KINDS, "o_custkey")
HAVE_SQL = f"""WITH r AS (SELECT o_orderkey, o_custkey, {_S} AS s, {_K} AS k, {_sql_pick(["Rules", "Provincial Rules"], "o_custkey")} AS t FROM orders),
c AS (SELECT *, CASE WHEN s = 'GOV_GAZETTES' THEN '01_ordinary_gazettes' WHEN s = 'GOV_EXTRA_GAZETTES' THEN '02_extraordinary_gazettes' WHEN s = 'PARL_GOV_BILLS' THEN '04_government_bills' WHEN s = 'SC_OFFICIAL' OR contains(k, 'Supreme Court') THEN '05_supreme_court'
  WHEN s = 'CA_OFFICIAL' OR contains(k, 'Court of Appeal') THEN '06_court_of_appeal' WHEN starts_with(s, 'PARL_HANSARD') THEN '07_hansard' WHEN k = 'New Law Report' THEN '09_law_reports' WHEN s = 'UVA_HEALTH_STATUTES' OR k = 'Provincial Statute' THEN '13_provincial_subnational_law'
  WHEN s = 'UVA_PSC_LEGAL_PROVISIONS' THEN CASE WHEN contains(k, 'Constitution') THEN '03_legislation_acts_constitution' WHEN contains(k, 'Provincial') OR contains(t, 'Provincial') THEN '13_provincial_subnational_law' ELSE '14_administrative_practice_materials' END
  WHEN s = 'CBSL_RULES_DIRECTIONS' THEN '14_administrative_practice_materials' WHEN s = 'PARL_ACTS' OR k IN ('Act', 'Constitution') THEN '03_legislation_acts_constitution' WHEN s = 'PARL_MINUTES' THEN '08_parliament_business_records' WHEN s = 'LANKALAW_NET' THEN '15_lankalaw_library' ELSE '99_other' END AS category FROM r)
SELECT category, n_name AS owner, count(*) AS n, min(o_orderkey) AS first FROM c JOIN nation ON o_custkey % 25 = n_nationkey GROUP BY 1, 2"""

MISSING = ["Extraordinary Gazette 1990", "ordinary gazettes", "Acts of 1950", "bills", "Supreme Court decisions", "Court of Appeal", "Hansard", "papers presented", "NLR volumes", "historical court", "Privy Council", "Labour Tribunal", "local authority", "circulars", "LankaLaw", "portal", "unsorted", ""]
MISSING_AS = ["02_extraordinary_gazettes", "01_ordinary_gazettes", "03_legislation_acts_constitution", "04_government_bills", "05_supreme_court", "06_court_of_appeal", "07_hansard", "08_parliament_business_records", "09_law_reports", "10_historical_court_material", "11_privy_council_ceylon_appellate", "12_lower_courts_tribunals", "13_provincial_subnational_law", "14_administrative_practice_materials", "15_lankalaw_library", "16_portal_recovery_and_external_collections", "99_other", "99_other"]
NOTES = ["owner=Ann; page = 7;owner=Bob", "nothing", "page=12=x", "the bill and the Supreme Court", "lost acts"]


def tracker_missing(spark: SparkSession, folder: str) -> DataFrame:
    """Missing sources: category by name, else by all fields; defaults, priority, and values of their notes."""
    key = F.col("o_orderkey")
    row = {"missing_id": F.concat(F.lit(" m"), key), "data_category": _pick(MISSING, key), "missing_description": _pick(["", None, "a volume"], F.col("o_custkey")), "year": _pick(["1990", "x", " 2001 "], F.col("o_custkey")), "next_action": _pick(["", "call"], F.col("o_custkey")), "legal_importance": _pick(["High", "urgent", ""], F.col("o_custkey")), "status": F.lit(""), "last_checked": _pick(["2024-05-06T07:08:09Z", "soon", "2023-01-02"], F.col("o_custkey"))}
    notes = _pick(NOTES, F.col("o_custkey"))
    made = rules.missing_source(row)
    return table(spark, folder, "orders").select(
        *[made[k].alias(k) for k in ("external_missing_id", "category", "title", "year", "next_action", "priority", "status")],
        F.unix_seconds(made["last_checked"]).alias("checked"),
        rules.missing_category(row["data_category"], notes).alias("tracker"),
        rules.note_value(notes, "owner").alias("owner"),
        rules.note_value(notes, "page").alias("page"),
    )


MISSING_SQL = f"""WITH r AS (SELECT ' m' || o_orderkey AS id, {_sql_pick(MISSING, "o_orderkey")} AS c, {_sql_pick(MISSING_AS, "o_orderkey")} AS a, {_sql_pick(["", None, "a volume"], "o_custkey")} AS d, o_custkey % 3 AS m, o_custkey % 2 AS b, o_custkey % 5 AS n FROM orders)
SELECT trim(id) AS external_missing_id, CASE WHEN c = '' THEN 'Unclassified' ELSE c END AS category, coalesce(nullif(d, ''), nullif(c, ''), 'Missing source') AS title, ([1990, NULL, 2001])[(m + 1)::INT]::INTEGER AS year, CASE WHEN b = 0 THEN 'Locate and verify source.' ELSE 'call' END AS next_action,
  CASE WHEN m = 0 THEN 'high' ELSE 'normal' END AS priority, 'open' AS status, ([1714979289, NULL, 1672617600])[(m + 1)::INT]::BIGINT AS checked,
  CASE WHEN a <> '99_other' THEN a WHEN n = 3 THEN '04_government_bills' WHEN n = 4 THEN '03_legislation_acts_constitution' ELSE a END AS tracker,
  CASE WHEN n = 0 THEN 'Bob' END AS owner, CASE n WHEN 0 THEN '7' WHEN 2 THEN '12=x' END AS page FROM r"""

REVIEWS = ["reviewed", "rejected", None, "superseded_by_official", "machine"]


def eligibility(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by what they may be used for: chunks (both rules), translations, pruning and import."""
    k = F.col("doc_id")
    docs = corpus(spark, folder).withColumns({"language": _pick(["", "English", "french", "Tamil"], k), "acquisition": _pick(["downloaded", "downloaded", "missing"], k), "extraction": _pick(["extracted", "failed"], k), "ocr": _pick([False, None, True], k), "quality": _pick([0.9, 0.05, None], k), "sid": _pick(["A", "GOV_GAZETTES", "PARL_ACTS", "B"], k), "origin": _pick(["translation", "original"], k), "review": _pick(REVIEWS, k)})
    own = lambda **more: registry.eligible(F.col("language"), F.col("acquisition"), F.col("extraction"), F.col("ocr"), F.col("quality"), F.col("sid"), **more)
    out = docs.select("document_id", "sid", "year", own().alias("chunked"), own(empty_language=False).alias("chunked_strict"), rules.translation_eligible(F.col("origin"), F.col("ocr"), F.col("quality"), F.col("text"), F.col("review"), F.col("sid")).alias("translated"), rules.prunable(F.col("acquisition"), F.col("extraction"), F.col("ocr"), F.col("quality")).alias("pruned"))
    return rules.import_filter(out.withColumnRenamed("sid", "source_id"), source_ids=("A", "B", "PARL_ACTS"), years=tuple(range(1990, 2020)))


ELIGIBLE_SQL = f"""WITH {CORPUS_SQL}, d AS (SELECT document_id, text, year, {_sql_pick(["", "English", "french", "Tamil"], "doc_id")} AS l, doc_id % 3 < 2 AS got, doc_id % 2 = 0 AS ext, doc_id % 3 = 2 AS ocr, coalesce(([0.9, 0.05, NULL])[(doc_id % 3 + 1)::INT], 0) AS q, {_sql_pick(["A", "GOV_GAZETTES", "PARL_ACTS", "B"], "doc_id")} AS s, doc_id % 2 = 0 AS tr, {_sql_pick(REVIEWS, "doc_id")} AS r FROM corpus),
e AS (SELECT *, got AND ext AND NOT ocr AND q >= 0.10 AS ready, NOT contains(s, 'GAZETTE') AS plain FROM d)
SELECT document_id, s AS source_id, year, ready AND plain AND l <> 'french' AS chunked, ready AND plain AND l NOT IN ('french', '') AS chunked_strict,
  tr AND NOT ocr AND q >= 0.10 AND plain AND trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) <> '' AND coalesce(r, '') NOT IN ('rejected', 'superseded_by_official') AS translated, NOT ready AS pruned
FROM e WHERE s IN ('A', 'B', 'PARL_ACTS') AND year BETWEEN 1990 AND 2019"""

WANTED = ["Supreme Court judgment on bail.", "Section 5 of the Act: ", "Gazette notification;", "NIPO file", "something else", "Court of Appeal appeal", " . "]


def missing_authorities(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates made from missing authorities: type, class and filters of the search, title and id."""
    text = _pick(WANTED, F.col("o_orderkey"))
    kind = rules.candidate_type(text)
    filters = rules.candidate_filters(kind, text, F.lit(""))
    return table(spark, folder, "orders").select("o_orderkey", kind.alias("type"), rules.candidate_class(kind, text, F.lit("")).alias("query_class"), F.array_join(filters["authority_levels"].cast("array<string>"), ",").alias("levels"), F.array_join(filters["document_types"], ",").alias("types"), rules.candidate_title(text).alias("title"), rules.prefixed_id("authcand", text, F.col("o_custkey").cast("string")).alias("id"))


_TYPES = ["Supreme Court case", "Act", "Gazette", "Official registry material", "Missing authority task", "Court of Appeal case", "Missing authority task"]
WANTED_SQL = f"""WITH r AS (SELECT o_orderkey, o_custkey, {_sql_pick(WANTED, "o_orderkey")} AS t, {_sql_pick(_TYPES, "o_orderkey")} AS k FROM orders), l AS (SELECT *, lower(k || ' ' || t || ' ') AS x FROM r),
f AS (SELECT *, regexp_matches(x, 'act|section|gazette|regulation|ordinance|statutory') AS s, regexp_matches(x, 'supreme court|court of appeal|case|appeal|judgment') AS c FROM l)
SELECT o_orderkey, k AS type, CASE WHEN s THEN 'statute_lookup' WHEN c THEN 'case_law_lookup' ELSE 'general_research' END AS query_class, concat_ws(',', '1', CASE WHEN s THEN '2' END, CASE WHEN c THEN '3' END) AS levels, concat_ws(',', CASE WHEN s THEN 'statute,gazette,regulation' END, CASE WHEN c THEN 'judgment,case_law' END) AS types,
  CASE WHEN regexp_replace(t, '[.:; ]+$', '') = '' THEN 'Missing authority candidate' ELSE regexp_replace(t, '[.:; ]+$', '') END AS title, 'authcand_' || substr(sha256(t || chr(10) || o_custkey), 1, 24) AS id FROM f"""

TEXTS = ["Draft a petition", "find the trademark", "the judge said", "nothing to see", "you must file the judgment", "summarize 12/05/2019 for our client Alpha Ltd", "judgment in SC Appeal No. 7 on a trademark no. 12"]


def policy_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """Status, risk and reviewer of texts; risk of the output; what intake texts leave open."""
    text, output = _pick(TEXTS, F.col("o_orderkey")), _pick(["case_summary", "petition", "list"], F.col("o_custkey"))
    p, asked = rules.text_policy(text), rules.clarifications(text, F.lit(True))
    rows = table(spark, folder, "orders").select("o_orderkey", p.alias("p"), rules.output_risk(output).alias("output_risk"), asked.alias("asked"))
    return rows.select("o_orderkey", "p.status", "p.risk", F.array_join("p.codes", ",").alias("codes"), "p.reviewer", "output_risk", rules.highest(F.col("p.risk"), F.col("output_risk")).alias("highest"), F.array_join("asked.category", ",").alias("asked"), F.size(F.filter("asked", lambda x: x["blocks"])).alias("blocking"))


_RISK = ["high", "medium", "high", "low", "high", "medium", "high"]
_ASKED_OF = ["client_position,parties,dates", "client_position,parties,dates,registration_number", "client_position,parties,dates", "client_position,parties,dates", "client_position,parties,dates,case_number", "", "client_position,parties,dates"]
_BLOCKING = [2, 3, 2, 2, 3, 0, 2]
POLICY_SQL = f"""WITH r AS (SELECT o_orderkey, o_orderkey % 7 AS i, {_sql_pick(_RISK, "o_orderkey")} AS risk, {_sql_pick(["medium", "high", "low"], "o_custkey")} AS o, {_sql_pick(_ASKED_OF, "o_orderkey")} AS asked, {_sql_pick(_BLOCKING, "o_orderkey")} AS b FROM orders)
SELECT o_orderkey, CASE WHEN i = 4 THEN 'block' WHEN risk = 'low' THEN 'allow' ELSE 'review_required' END AS status, risk, CASE WHEN i = 4 THEN 'final_legal_advice' ELSE '' END AS codes, CASE risk WHEN 'high' THEN 'qualified_lawyer' WHEN 'medium' THEN 'lawyer_or_supervised_legal_reviewer' ELSE 'none' END AS reviewer, o AS output_risk,
  CASE WHEN 'high' IN (risk, o) THEN 'high' WHEN 'medium' IN (risk, o) THEN 'medium' ELSE 'low' END AS highest, asked, b::INTEGER AS blocking FROM r"""


def pack_source_warnings(spark: SparkSession, folder: str) -> DataFrame:
    """Warnings on the sources of packs: an order's lines are its items."""
    tiers, flags = ["official", "secondary", "unverified", "secondary", "secondary"], [None, "empty_text", None, "translated_text_fallback", "machine_translation_unreviewed", None, None]
    items = table(spark, folder, "lineitem").select("l_orderkey", _pick(tiers, F.col("l_partkey")).alias("tier"), F.pmod("l_suppkey", F.lit(7)).alias("level"), _pick(flags, F.col("l_partkey")).alias("flag"))
    packs = items.groupBy("l_orderkey").agg(F.collect_set("tier").alias("tiers"), F.collect_set("level").alias("levels"), F.collect_set("flag").alias("flags"))
    return packs.select("l_orderkey", F.array_join(rules.source_warnings(F.col("tiers"), F.col("levels"), F.col("flags")), ",").alias("warnings"))


WARN_SQL = """WITH i AS (SELECT l_orderkey AS k, l_partkey % 5 AS t, l_suppkey % 7 AS l, l_partkey % 7 AS f FROM lineitem), p AS (SELECT k, bool_and(t > 0) AS none, bool_or(t = 2) AS unver, bool_or(l >= 6) AS sec, bool_or(f = 1) AS bad, bool_or(f = 3) AS fall, bool_or(f = 4) AS mt FROM i GROUP BY 1)
SELECT k AS l_orderkey, concat_ws(',', CASE WHEN none THEN 'no_primary_source' END, CASE WHEN unver THEN 'unverified_source' END, CASE WHEN sec THEN 'secondary_material' END, CASE WHEN bad THEN 'quality_flags' END, CASE WHEN fall THEN 'translated_fallback' END, CASE WHEN mt THEN 'unreviewed_translation' END) AS warnings FROM p"""


def pack_contract(spark: SparkSession, folder: str) -> DataFrame:
    """Breaches of the contract of packs: orders with their lines as items, sealed by a hash over the items."""
    lines = table(spark, folder, "lineitem")
    items = lines.select(F.col("l_orderkey").alias("pack_id"), F.col("l_linenumber").alias("item"), F.concat(F.col("l_orderkey"), F.lit("_item_"), F.lpad(F.when(F.col("l_partkey") % 50 == 0, 1).otherwise(F.col("l_linenumber")).cast("string"), 3, "0")).alias("pack_item_id"), F.when(F.col("l_partkey") % 31 == 0, " ").otherwise("c").alias("citation"), F.when(F.col("l_partkey") % 37 == 0, "").otherwise("t").alias("text"), F.when(F.col("l_partkey") % 41 != 0, F.col("l_quantity").cast("long")).alias("tokens"), F.when(F.col("l_partkey") % 43 != 0, 1).alias("n_trace"))
    sealed = items.groupBy("pack_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("pack_item_id")), ","), 256).alias("sealed_hash"), F.sum("tokens").alias("total"))
    k = F.col("o_orderkey")
    packs = table(spark, folder, "orders").join(sealed, k == F.col("pack_id"), "left").select(k.alias("pack_id"), F.when(k % 11 == 0, "0").otherwise(F.col("sealed_hash")).alias("pack_hash"), "sealed_hash", F.when(k % 13 == 0, "0.9").otherwise("1.0").alias("schema_version"), F.when(k % 17 == 0, 0).otherwise(1).alias("pack_version"), (F.col("total") + F.when(k % 19 == 0, 1).otherwise(0)).alias("token_count"), F.lit(150).alias("max_tokens"), F.when(k % 23 == 0, 0).otherwise(2).alias("n_trace"), F.lit(0).alias("n_missing"))
    return rules.pack_issues(packs, items)


CONTRACT_SQL = """WITH i AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_partkey % 50 = 0 THEN 1 ELSE l_linenumber END AS own, l_partkey AS p, CASE WHEN l_partkey % 41 <> 0 THEN l_quantity::BIGINT END AS t FROM lineitem),
a AS (SELECT k, count(*) AS items, count(*) - count(DISTINCT own) AS rep, count(*) FILTER (own <> n) AS nc, count(*) FILTER (p % 31 = 0) AS mc, count(*) FILTER (p % 37 = 0) AS et, count(*) FILTER (coalesce(t, 0) <= 0) AS mt, count(*) FILTER (p % 43 = 0) AS tr, sum(coalesce(t, 0)) AS total, sum(t) AS sealed FROM i GROUP BY 1),
o AS (SELECT o_orderkey AS k, coalesce(items, 0) AS items, coalesce(rep, 0) AS rep, coalesce(nc, 0) AS nc, coalesce(mc, 0) AS mc, coalesce(et, 0) AS et, coalesce(mt, 0) AS mt, coalesce(tr, 0) AS tr, coalesce(total, 0) AS total, sealed + (o_orderkey % 19 = 0)::INT AS count FROM orders LEFT JOIN a ON o_orderkey = k),
c AS (SELECT k, unnest([{'c': 'pack_hash_mismatch', 'n': (k % 11 = 0 AND items > 0)::BIGINT}, {'c': 'schema_version_mismatch', 'n': (k % 13 = 0)::BIGINT}, {'c': 'invalid_pack_version', 'n': (k % 17 = 0)::BIGINT}, {'c': 'duplicate_pack_item_id', 'n': (rep > 0)::BIGINT}, {'c': 'non_canonical_pack_item_id', 'n': nc}, {'c': 'missing_citation', 'n': mc}, {'c': 'empty_selected_text', 'n': et}, {'c': 'missing_token_estimate', 'n': mt}, {'c': 'missing_item_retrieval_trace', 'n': tr},
  {'c': 'token_count_mismatch', 'n': (count IS DISTINCT FROM total)::BIGINT}, {'c': 'token_budget_exceeded', 'n': (coalesce(count, 0) > 150)::BIGINT}, {'c': 'missing_pack_retrieval_trace', 'n': (items > 0 AND k % 23 = 0)::BIGINT}, {'c': 'empty_pack_without_missing_source_warning', 'n': (items = 0)::BIGINT}]) AS x FROM o)
SELECT k AS pack_id, x.c AS code, x.n AS n FROM c WHERE x.n > 0"""


def row_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of listing rows, numbers of acts, levels from labels, lenient numbers."""
    k = F.col("o_orderkey")
    key = rules.row_key(_pick(["", None, "id7"], k), _pick(["", "u9"], k), _pick([1999, None], F.col("o_custkey")), F.col("o_custkey"), _pick(["T", ""], k))
    act = rules.act_number(_pick([" 007/1999 x", "12/20", None, "5 / 2004"], k), _pick([1980, 1990], k))
    levels = rules.authority_levels(_pick_array([["primary", "x", " 4 "], ["CASE_LAW"], [], ["legislation", "secondary"]], k))
    return table(spark, folder, "orders").select("o_orderkey", key.alias("key"), act["number"].alias("number"), act["year"].alias("year"), F.array_join(levels.cast("array<string>"), ",").alias("levels"), rules.lenient_float(_pick([" 1.5", "x", "2e3"], k)).alias("f"))


def _pick_array(values: list[list[str]], by: Column) -> Column:
    return F.get(F.array(*[F.array(*map(F.lit, v)) if v else F.array().cast("array<string>") for v in values]), F.pmod(by, F.lit(len(values))).cast("int"))


KEYS_SQL = """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN 'id7' WHEN o_orderkey % 2 = 1 THEN 'u9' ELSE CASE WHEN o_custkey % 2 = 0 THEN '1999' ELSE 'None' END || ':' || o_custkey || ':T' END AS key,
  (['7', '', '', '5'])[(o_orderkey % 4 + 1)::INT] AS number, CASE o_orderkey % 4 WHEN 0 THEN '1999' WHEN 3 THEN '2004' WHEN 1 THEN '1990' ELSE '1980' END AS year, (['1,4', '3', '', '2,6'])[(o_orderkey % 4 + 1)::INT] AS levels, ([1.5, NULL, 2000.0])[(o_orderkey % 3 + 1)::INT]::DOUBLE AS f FROM orders"""


def json_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Dotted paths, token substitution and hashes of label maps in events' JSON."""
    events = table(spark, folder, "events")
    payload = F.concat(F.lit('{"a": {"type": "'), "event_type", F.lit('", "to": "{who}", "{who}": '), F.col("user_id") % 3, F.lit(', "b": '), F.when(F.col("user_id") % 2 == 0, F.lit("true")).otherwise(F.lit('"true"')), F.lit("}}"))
    found = rules.json_matches(payload, "a.type", F.lit('"click"'))
    labels = F.create_map(F.lit("type"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k"))
    put = rules.substitute(payload, {"who": F.concat(F.lit('u"\t'), F.col("user_id").cast("string"))})
    typed = {"number": rules.json_matches(payload, "a.{who}", F.lit("1.0")), "truth": rules.json_matches(payload, "a.b", F.lit("true")), "text": rules.json_matches(payload, "a.b", F.lit('"true"')), "none": rules.json_matches(payload, "a.none", F.lit("null"))}
    return events.select("event_id", found["matches"].alias("matches"), found["value"].alias("value"), F.get_json_object(put, "$.a.to").alias("put"), put.contains('"{who}":').alias("key_kept"), *[c["matches"].alias(k) for k, c in typed.items()], rules.json_matches(payload, "a.none.x", F.lit('""'))["matches"].alias("absent"), rules.label_hash(labels).alias("hash"))


JSON_SQL = """SELECT event_id, event_type = 'click' AS matches, '"' || event_type || '"' AS value, 'u"' || chr(9) || user_id AS put, true AS key_kept, user_id % 3 = 1 AS number, user_id % 2 = 0 AS truth, user_id % 2 = 1 AS text, false AS none, false AS absent, sha256('{"k":"' || (props->>'$.k') || '","type":"' || event_type || '"}') AS hash FROM events"""


def embedding_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The latest complete run of each of two collections (without an end last) and what of it differs from a configuration."""
    k = F.col("o_orderkey")
    runs = table(spark, folder, "orders").select(k.alias("run_id"), _pick(["complete", "failed"], F.col("o_custkey")).alias("status"), _pick(["a", None, "b"], k).alias("collection"), F.when(k % 5 > 0, F.col("o_orderdate")).alias("completed_at"), _pick(["local", "remote"], k).alias("provider"), F.lit("m1").alias("model"), (k % 2 * 128 + 256).cast("int").alias("dimensions"))
    out = None
    for name in ("a", "b"):
        one = rules.latest_run(runs, name).select(F.lit(name).alias("asked"), "run_id", F.array_join(rules.run_mismatches("local", "m1", 256), ",").alias("mismatches"))
        out = one if out is None else out.unionByName(one)
    return out


RUNS_SQL = """WITH r AS (SELECT o_orderkey AS run_id, ['a', NULL, 'b'][(o_orderkey % 3 + 1)::INT] AS c, CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate END AS done FROM orders WHERE o_custkey % 2 = 0), q AS (SELECT unnest(['a', 'b']) AS asked)
SELECT asked, run_id, CASE WHEN run_id % 2 = 1 THEN 'provider,dimensions' ELSE '' END AS mismatches FROM q JOIN r ON c = asked OR c IS NULL QUALIFY row_number() OVER (PARTITION BY asked ORDER BY done DESC NULLS LAST, run_id DESC) = 1"""


def listed_order(spark: SparkSession, folder: str) -> DataFrame:
    """Rows in the order of a given list of keys, enriched from another table; keys that are not there stay, without values."""
    wanted = spark.createDataFrame([([9, 3, 7, 100000000, 1],)], "ids array<bigint>").select(F.posexplode("ids").alias("place", "key"))
    suppliers = table(spark, folder, "supplier")
    return wanted.join(suppliers, F.col("key") == F.col("s_suppkey"), "left").select("key", "place", "s_name", F.array_position(F.array(*map(F.lit, [9, 3, 7])), F.col("key").cast("int")).alias("position")).orderBy("place")


LISTED_SQL = """WITH w AS (SELECT unnest([9, 3, 7, 100000000, 1]) AS key, unnest(range(0, 5))::INTEGER AS place) SELECT key::BIGINT AS key, place, s_name, coalesce(list_position([9, 3, 7], key), 0)::BIGINT AS position FROM w LEFT JOIN supplier ON s_suppkey = key"""


def ingestion_finish(spark: SparkSession, folder: str) -> DataFrame:
    """What runs of ingestion end with, from their documents' events: distinct documents, sums, failures; events of documents that a resumed run had done are left out."""
    events = table(spark, folder, "events").select("event_id", F.pmod("user_id", F.lit(20)).alias("run"), F.pmod("event_id", F.lit(97)).alias("doc"), "event_type", "value")
    done = events.where("event_type = 'purchase'").select("run", "doc").distinct()
    left = events.where("event_type <> 'purchase'").join(done, ["run", "doc"], "left_anti").unionByName(events.where("event_type = 'purchase'"))
    return left.groupBy("run").agg(F.countDistinct("doc").alias("documents"), F.round(F.sum("value"), 4).alias("pages"), F.count_if(F.col("event_type") == "view").alias("failed"))


FINISH_SQL = """WITH e AS (SELECT user_id % 20 AS run, event_id % 97 AS doc, event_type, value FROM events), d AS (SELECT DISTINCT run, doc FROM e WHERE event_type = 'purchase'), l AS (SELECT * FROM e WHERE event_type <> 'purchase' AND NOT EXISTS (SELECT 1 FROM d WHERE d.run = e.run AND d.doc = e.doc) UNION ALL SELECT * FROM e WHERE event_type = 'purchase')
SELECT run, count(DISTINCT doc) AS documents, round(sum(value), 4) AS pages, count(*) FILTER (event_type = 'view') AS failed FROM l GROUP BY 1"""

QUERIES = {f.__name__: f for f in (tracker_have, tracker_missing, eligibility, missing_authorities, policy_evaluation, pack_source_warnings, pack_contract, row_keys, json_rules, embedding_runs, listed_order, ingestion_finish)}
SQL = {
    "tracker_have": HAVE_SQL, "tracker_missing": MISSING_SQL, "eligibility": ELIGIBLE_SQL, "missing_authorities": WANTED_SQL, "policy_evaluation": POLICY_SQL, "pack_source_warnings": WARN_SQL, "pack_contract": CONTRACT_SQL, "row_keys": KEYS_SQL,
    "json_rules": JSON_SQL, "embedding_runs": RUNS_SQL, "listed_order": LISTED_SQL, "ingestion_finish": FINISH_SQL,
}
