"""Queries of ingestion runs, stored packs and their lineage, validated answers and expected documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvex.functions import strategy, text as tx
from corvex.operators import packs, selectors
from corvex.plans import text_queries
from corvex.sources import shared
from corvex.sources.tables import CORPUS_SQL, corpus, table
from corvex.streaming import ingestion, rates


def ingestion_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of ingestion runs, kept as keyed state by a stream over the event files."""
    e = rates.read_events(spark, f"{folder}/events.parquet")
    n = F.col("event_id")
    kind = F.when(n % 500 == 0, "finish").otherwise("document")
    status = F.when((F.col("event_type") == "error") & (kind == "document"), "failed").otherwise("complete")
    events = e.select(n.cast("string").alias("event"), F.concat(F.lit("run_"), F.col("user_id") % 20).alias("run"), F.concat(F.lit("doc_"), n % 997).alias("document"), kind.alias("kind"), status.alias("status"), (n % 7).cast("int").alias("pages"), (n % 5).cast("int").alias("chunks"), "ts")
    return ingestion.run_once(events, idle="400 days").drop("status")


INGESTION_SQL = """WITH e AS (SELECT 'run_' || (user_id % 20) AS run, event_id, event_type FROM events WHERE event_id % 500 <> 0), r AS (SELECT DISTINCT 'run_' || (user_id % 20) AS run FROM events)
SELECT r.run, count(DISTINCT event_id % 997) AS documents, coalesce(sum(event_id % 7), 0)::BIGINT AS pages, coalesce(sum(event_id % 5), 0)::BIGINT AS chunks, count(*) FILTER (event_type = 'error') AS errors FROM r LEFT JOIN e USING (run) GROUP BY 1"""


def _packs(spark: SparkSession, folder: str) -> DataFrame:
    """A pack for each conversation: its number of turns and the hash of its texts in order."""
    turns = table(spark, folder, "conversations")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    rows = turns.groupBy("conv_id").agg(F.count("*").alias("pack_version"), F.sha2(texts, 256).alias("text_hash"))
    rows = rows.select(F.concat(F.lit("pack_"), "conv_id").alias("pack_id"), F.when(F.col("conv_id") % 3 > 0, F.concat(F.lit("pack_"), F.col("conv_id") - 1)).alias("parent_pack_id"), F.col("pack_version").cast("int").alias("pack_version"), "text_hash")
    return packs.sealed(rows, ["pack_id", "pack_version", "text_hash"])


def pack_store(spark: SparkSession, folder: str) -> DataFrame:
    """Packs of conversations, stored in two commits that share a half; each with its hash and whether its payload still has it."""
    store = packs.PackStore(spark, f"{shared.shared_dir(spark)}/corvex-packs/{uuid.uuid4().hex}")
    rows = _packs(spark, folder)
    store.save(rows.where("pmod(xxhash64(pack_id), 2) = 0"))
    store.save(rows)
    return packs.verified(store.packs()).drop("payload")


STORE_SQL = """WITH p AS (SELECT conv_id, count(*)::INTEGER AS n, sha256(string_agg(text, chr(10) ORDER BY turn)) AS h FROM conversations GROUP BY 1)
SELECT 'pack_' || conv_id AS pack_id, CASE WHEN conv_id % 3 > 0 THEN 'pack_' || (conv_id - 1) END AS parent_pack_id, n AS pack_version, sha256('{"pack_id":"pack_' || conv_id || '","pack_version":' || n || ',"text_hash":"' || h || '"}') AS pack_hash, true AS intact FROM p"""


def _links(spark: SparkSession, folder: str) -> DataFrame:
    """Each turn of a conversation as a pack whose parent is the turn before."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    name = F.concat_ws(":", "conv_id", "turn")
    return table(spark, folder, "conversations").select("conv_id", "turn", name.alias("pack_id"), F.lag(name).over(order).alias("parent_pack_id"))


def pack_lineage(spark: SparkSession, folder: str) -> DataFrame:
    """All ancestors of every turn's pack."""
    return packs.ancestors(_links(spark, folder), "pack_id", "parent_pack_id")


LINEAGE_SQL = """WITH RECURSIVE l AS (SELECT conv_id || ':' || turn AS p, lag(conv_id || ':' || turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent FROM conversations),
r AS (SELECT p, p AS a, 0 AS d FROM l UNION ALL SELECT r.p, l.parent, d + 1 FROM r JOIN l ON l.p = r.a WHERE l.parent IS NOT NULL) SELECT p AS node, a AS ancestor, d::BIGINT AS distance FROM r"""


def pack_reload(spark: SparkSession, folder: str) -> DataFrame:
    """The last pack of each conversation with its own items and those of all its ancestors, their pages and anchors."""
    links = _links(spark, folder)
    number = F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(1000))
    own = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("own "), "pack_id"))
    items = links.select("pack_id", F.lit(1).alias("rank"), F.concat("pack_id", F.lit("_item_001")).alias("pack_item_id"), F.concat(F.lit("chunk_"), number).alias("chunk_id"), own.alias("text"))
    docs = table(spark, folder, "documents")
    pages = docs.select(F.concat(F.lit("chunk_"), "doc_id").alias("chunk_id"), (F.col("doc_id") % 9).cast("int").alias("page_start"), (F.col("doc_id") % 9 + 1).cast("int").alias("page_end"), F.substring("text", 1, 40).alias("chunk_text"))
    anchors = docs.where("doc_id % 3 = 0").select(F.concat(F.lit("chunk_"), "doc_id").alias("chunk_id"), F.explode(F.array(F.concat(F.lit("b"), "doc_id"), F.concat(F.lit("a"), "doc_id"))).alias("anchor_id"))
    last = links.groupBy("conv_id").agg(F.max_by("pack_id", "turn").alias("pack_id")).select("pack_id")
    return packs.reload(links, items, pages, anchors, last)


RELOAD_SQL = """WITH l AS (SELECT conv_id, turn, conv_id || ':' || turn AS p, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS generation, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
i AS (SELECT *, (conv_id * 7 + turn) % 1000 AS k FROM l)
SELECT conv_id || ':' || last AS pack_id, (generation + 1)::INTEGER AS place, generation, p AS from_pack_id, p || '_item_001' AS pack_item_id, 'chunk_' || k AS chunk_id, CASE WHEN turn % 2 = 1 THEN 'own ' || p ELSE substr(text, 1, 40) END AS text,
  CASE WHEN doc_id IS NOT NULL THEN doc_id % 9 END::INTEGER AS page_start, CASE WHEN doc_id IS NOT NULL THEN doc_id % 9 + 1 END::INTEGER AS page_end, CASE WHEN doc_id % 3 = 0 THEN 'a' || doc_id END AS anchor_id FROM i LEFT JOIN documents d ON d.doc_id = k"""

_SAID = (" The court may act. [p_item_001].", " It must be so!", " See x_item_009 and p_item_002 now.", " You will win; section 5 applies", "")


def strategy_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Breaches of answers made from conversation turns: places of uncited sentences, items from outside, missing parts."""
    turn, conv = F.col("turn"), F.col("conv_id")
    said = F.get(F.array(*map(F.lit, _SAID)), ((conv + turn) % 5).cast("int"))
    ids = lambda test, item: F.when(test, F.array(F.lit(item))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, folder, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("answer_id"), conv.cast("string").alias("pack_id"), F.when(turn % 7 == 3, F.lit("other")).otherwise(conv.cast("string")).alias("response_pack_id"),
        F.when(conv % 2 == 0, "lawyer_review_pack").otherwise("strategy_report").alias("requested_output"), F.concat("text", said).alias("answer"), F.array(F.lit("p_item_001"), F.lit("p_item_002")).alias("allowed"),
        F.array(F.struct(ids(F.lit(True), "p_item_001").alias("ids")), F.struct(ids(conv % 11 == 0, "c_item_001").alias("ids"))).alias("claims"), F.array(F.struct(ids(conv % 13 == 0, "r_item_001").alias("ids"))).alias("risks"),
        F.array(F.struct(F.col("text").alias("counterargument"), said.alias("response"), ids(turn % 3 == 0, "p_item_002").alias("supporting_ids"), ids(conv % 17 == 0, "k_item_001").alias("response_ids"))).alias("counterarguments"),
        F.when(turn % 2 == 0, F.struct(ids(conv % 5 == 0, "z_item_001").alias("ids"), ids(conv % 4 > 0, "paper").alias("checklist"), (conv % 6 > 0).alias("lawyer_verification"))).alias("reasoning"),
    )
    return strategy.issues(rows).withColumn("unknown", F.array_join("unknown", "|"))


def _sql_word(x: str, words: str) -> str:
    """Whole words, whose neighbours are no letters, digits or underscores of any script."""
    return rf"regexp_matches({x}, '(?i)(^|[^\p{{L}}\p{{N}}_])({words})($|[^\p{{L}}\p{{N}}_])')"


_LEGAL = strategy.LEGAL.removeprefix(r"(?i)\b(").removesuffix(r")\b")
_UNSAFE = strategy.UNSAFE.removeprefix(r"(?i)\b(").removesuffix(r")\b")
_ITEM_SQL = r"[A-Za-z0-9][A-Za-z0-9_-]*_item_[0-9]{3}"
STRATEGY_SQL = rf"""WITH c AS (SELECT conv_id, turn, conv_id || ':' || turn AS answer_id, text, [' The court may act. [p_item_001].', ' It must be so!', ' See x_item_009 and p_item_002 now.', ' You will win; section 5 applies', ''][((conv_id + turn) % 5 + 1)::INT] AS said FROM conversations),
a AS (SELECT *, text || said AS answer, list_filter(list_transform(string_split(regexp_replace(text || said, '([.!?])\s+', '\1' || chr(30), 'g'), chr(30)), lambda x: trim(x)), lambda x: x <> '') AS parts FROM c),
s AS (SELECT answer_id, unnest(parts) AS t, unnest(range(len(parts))) AS i FROM a),
f AS (SELECT *, {_sql_word("t", _LEGAL)} AS legal, regexp_matches(t, '{_ITEM_SQL}') AS cited FROM s),
j AS (SELECT *, cited AND NOT legal AND i > 0 AS joins FROM f),
k AS (SELECT *, coalesce(lead(joins) OVER w, false) AS then_cited, sum((NOT joins)::INT) OVER w AS number FROM j WINDOW w AS (PARTITION BY answer_id ORDER BY i))
SELECT answer_id, 'uncited_legal_sentence' AS code, 'answer[' || number || ']' AS path, '' AS unknown FROM k WHERE NOT joins AND legal AND NOT cited AND NOT then_cited
UNION ALL SELECT answer_id, 'claim_out_of_pack', 'claims[1]', 'c_item_001' FROM a WHERE conv_id % 11 = 0
UNION ALL SELECT answer_id, 'answer_out_of_pack', 'answer', u FROM (SELECT answer_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(answer, '{_ITEM_SQL}')), lambda x: x NOT IN ('p_item_001', 'p_item_002'))), '|') AS u FROM a) WHERE u <> ''
UNION ALL SELECT answer_id, 'pack_id_mismatch', 'pack_id', '' FROM a WHERE turn % 7 = 3
UNION ALL SELECT answer_id, 'counterargument_out_of_pack', 'counterarguments[0]', 'k_item_001' FROM a WHERE conv_id % 17 = 0
UNION ALL SELECT answer_id, 'uncited_counterargument', 'counterarguments[0]', '' FROM a WHERE turn % 3 <> 0 AND conv_id % 17 <> 0 AND {_sql_word("text || ' ' || said", _LEGAL)}
UNION ALL SELECT answer_id, 'risk_out_of_pack', 'risks[0]', 'r_item_001' FROM a WHERE conv_id % 13 = 0
UNION ALL SELECT answer_id, 'reasoning_pack_out_of_pack', 'reasoning', 'z_item_001' FROM a WHERE turn % 2 = 0 AND conv_id % 5 = 0
UNION ALL SELECT answer_id, 'missing_reasoning_pack', 'reasoning', '' FROM a WHERE turn % 2 = 1 AND conv_id % 2 = 0
UNION ALL SELECT answer_id, 'unsafe_final_advice_wording', 'answer', '' FROM a WHERE {_sql_word("answer", _UNSAFE)}
UNION ALL SELECT answer_id, 'missing_evidence_checklist_required', 'reasoning.checklist', '' FROM a WHERE turn % 2 = 0 AND conv_id % 4 = 0
UNION ALL SELECT answer_id, 'lawyer_verification_required', 'reasoning.lawyer_verification', '' FROM a WHERE turn % 2 = 0 AND conv_id % 6 = 0"""

_CASE = selectors.Case(
    "recall", text_queries.RANKED_QUERY,
    (selectors.Selector("ids", ("doc_11", "doc_3")), selectors.Selector("titles", title_like="%the%", document_types=("Act", "Constitution", "Gazette"), limit=5), selectors.Selector("words", text_query=text_queries.RANKED_QUERY, limit=8)),
    expected_count=12,
)


def selector_status(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that a case expects, by ids, titles and words, with their ranks in both ranking stages."""
    status = F.when(F.col("doc_id") % 4 < 3, "downloaded").otherwise("missing")
    docs = corpus(spark, folder).select("document_id", "title", "document_type", "year", "source_id", "language", F.lit(None).cast("string").alias("summary_language"), F.col("language").alias("text_language"), status.alias("acquisition_status"), tx.spread_summary(F.col("text")).alias("summary"), F.length("text").alias("char_count"))
    expected = selectors.resolve(docs, [_CASE])
    first = text_queries.stage1_ranking(spark, folder).select(F.lit("recall").alias("case_id"), "document_id", "rank")
    last = text_queries.stage2_blend(spark, folder)
    last = last.select(F.lit("recall").alias("case_id"), "document_id", F.row_number().over(Window.orderBy(F.col("raw_score").desc(), "document_id")).alias("rank"), F.col("relevance").alias("score"))  # 50 rows
    return selectors.status(expected, first, last, 10).select("document_id", "label", "place", "found_in_stage1", "stage1_rank", "found_in_final_top_k", "final_rank", "final_relevance_score")


_HIT = text_queries._HIT
STATUS_SQL = rf"""WITH {CORPUS_SQL}, d AS (SELECT *, doc_id % 4 < 3 AS got, CASE WHEN document_type IN ('Constitution', 'Act') THEN 0 WHEN contains(document_type, 'Judgment') THEN 1 WHEN contains(document_type, 'Gazette') THEN 2 ELSE 3 END AS pr,
  {_HIT(text_queries.sql_summary("text"))} AS s, {_HIT("title")} AS t FROM corpus WHERE length(text) > 0),
w AS (SELECT *, round(s / (s + 1) + 3 * t / (t + 1), 9) AS r FROM d),
e AS (SELECT document_id, 0 AS sel, 'ids' AS label, CASE document_id WHEN 'doc_11' THEN 1 ELSE 2 END AS k, 2 AS lim FROM w WHERE document_id IN ('doc_11', 'doc_3')
  UNION ALL SELECT document_id, 1, 'titles', row_number() OVER (ORDER BY pr, year DESC, title, document_id), 5 FROM w WHERE got AND title ILIKE '%the%' AND document_type IN ('Act', 'Constitution', 'Gazette')
  UNION ALL SELECT document_id, 2, 'words', row_number() OVER (ORDER BY pr, r DESC, year DESC, title, document_id), 8 FROM w WHERE got AND s > 0),
u AS (SELECT * FROM e WHERE k <= lim QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY sel) = 1),
x AS (SELECT document_id, label, row_number() OVER (ORDER BY sel, k)::INT AS place FROM u QUALIFY place <= 12),
one AS (SELECT document_id, rank FROM ({text_queries.STAGE1_SQL})), two AS (SELECT document_id, relevance, row_number() OVER (ORDER BY raw_score DESC, document_id)::INT AS rank FROM ({text_queries.STAGE2_SQL}))
SELECT x.document_id, label, place, one.rank IS NOT NULL AS found_in_stage1, one.rank AS stage1_rank, coalesce(two.rank <= 10, false) AS found_in_final_top_k, two.rank AS final_rank, relevance AS final_relevance_score FROM x LEFT JOIN one USING (document_id) LEFT JOIN two USING (document_id)"""

_NAMES = "ingestion_runs pack_store pack_lineage pack_reload strategy_validation selector_status".split()
QUERIES = {n: globals()[n] for n in _NAMES}
SQL = dict(zip(_NAMES, (INGESTION_SQL, STORE_SQL, LINEAGE_SQL, RELOAD_SQL, STRATEGY_SQL, STATUS_SQL), strict=True))
