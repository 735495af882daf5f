"""The operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    from corvex.llm import quality

    ledger, _ = quality.stored(_table(spark, folder, "documents"))
    rows = quality.decided(quality.apply_policy(ledger), ["base", "v1-lenient"])
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits", F.col("kept_v1-lenient").alias("kept_lenient"), F.col("alone_base").alias("alone_in_base"), F.col("alone_v1-lenient").alias("alone_in_lenient"))


def quality_ablation(spark: SparkSession, folder: str) -> DataFrame:
    """What each rule of each policy removes, alone or with others, from the stored ledger."""
    from corvex.llm import quality

    return quality.stored(_table(spark, folder, "documents"))[1]


def op11_filter_interactions(spark: SparkSession, folder: str) -> DataFrame:
    from corvex.llm import interactions

    return interactions.audit(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op12_sharding(spark: SparkSession, folder: str) -> DataFrame:
    from corvex.llm import sharding

    return sharding.shard(_table(spark, folder, "documents"))


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    from corvex.llm import collocations

    return collocations.mine(_table(spark, folder, "documents")).withColumnRenamed("part", "lang")


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    from corvex.llm import store, warc

    path = store.fresh(spark, "warc")
    return warc.read(warc.write(_table(spark, folder, "pages"), path), path)


def op2_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    from corvex.llm import jaccard

    return jaccard.join(_table(spark, folder, "documents"), shingle=3, percent=90)


def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    from corvex.llm import pieces

    return pieces.encode(_table(spark, folder, "documents"))


def op4_token_packing(spark: SparkSession, folder: str) -> DataFrame:
    from corvex.llm import packing

    return packing.pack(_table(spark, folder, "documents"))


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    from corvex.llm import langid

    docs = _table(spark, folder, "documents")
    docs = docs.withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.predict(docs, model, keep=["doc_id", "held_out"])


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from corvex.llm import substrings

    return substrings.deduplicate(_table(spark, folder, "documents")).drop("kept_text")


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from corvex.llm import decontaminate

    return decontaminate.leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op8_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    from corvex.llm import chat

    turns = _table(spark, folder, "conversations")
    held_out = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4 == 2
    model = chat.train(turns.where(~held_out))
    return chat.parse(turns, model).select("conv_id", "turn", "role", "role_pred", "n_pieces", "rendered")


def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    from corvex.llm import pii

    found = pii.detect(_table(spark, folder, "documents"))
    word = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("found", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(count, pii.BASE_KINDS),
        F.sha2(F.array_join(F.transform(base, word), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("found", word), ",").alias("spans"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)} | {"quality_ablation": quality_ablation}


OP1_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, upper(sha1(coalesce(html, ''))) AS h FROM pages),
d AS (
  SELECT page_id, h, octet_length(encode(html))::BIGINT AS payload_bytes, min(page_id) OVER (PARTITION BY h) AS first,
         list_transform(range(0, 8), lambda i: ('0x' || substr(h, (5 * i + 1)::INTEGER, 5))::BIGINT) AS parts FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(parts, lambda x:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x // 32768 % 32 + 1)::INTEGER, 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x // 1024 % 32 + 1)::INTEGER, 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x // 32 % 32 + 1)::INTEGER, 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x % 32 + 1)::INTEGER, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM d
"""

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) >= 8),
grams AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i+7], ' ')) AS c FROM win),
hit AS (
  SELECT doc_id, least(8, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -100)) AS add FROM grams WHERE c > 1),
rep AS (SELECT doc_id, sum(add) AS n FROM hit GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         length(regexp_replace(t, '[^\p{Lu}]+', '', 'g'))::BIGINT AS n_upper,
         length(regexp_replace(t, '[^!]+', '', 'g'))::BIGINT AS n_exclaim,
         len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)),
b AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN n_words > 0 AND word_chars > 25 * n_words THEN 4 ELSE 0 END
    + CASE WHEN n_words > 0 AND word_chars < 2 * n_words THEN 8 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 16 ELSE 0 END
    + CASE WHEN 100 * n_upper > 40 * word_chars THEN 32 ELSE 0 END
    + CASE WHEN 10 * n_exclaim > 3 * n_words THEN 64 ELSE 0 END
    + CASE WHEN n_lines > 4 AND 100 * n_dup_lines > 50 * n_lines THEN 128 ELSE 0 END)::INTEGER AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits, fail_bits & 51 = 0 AS kept_lenient,
       CASE fail_bits & 3 WHEN 1 THEN 'too_few_words' WHEN 2 THEN 'repeated_words' END AS alone_in_base,
       CASE fail_bits & 51 WHEN 1 THEN 'too_few_words' WHEN 2 THEN 'repeated_words' WHEN 16 THEN 'symbols' WHEN 32 THEN 'upper_case' END AS alone_in_lenient FROM b
"""

_POLICY_BITS = {"base": 3, "v1": 255, "v1-lenient": 51}
_RULE_NAMES = ("too_few_words", "repeated_words", "long_words", "short_words", "symbols", "upper_case", "exclamations", "repeated_lines")
ABLATION_SQL = f"WITH l AS ({OP10_SQL}) " + " UNION ALL ".join(
    f"SELECT '{p}' AS policy, '{name}' AS rule, count(*) AS n_docs, count(*) FILTER (fail_bits & {1 << k} <> 0) AS n_failed, count(*) FILTER (fail_bits & {mask} = {1 << k}) AS n_only_this, count(*) FILTER (fail_bits & {mask & ~(1 << k)} = 0) AS n_kept_without FROM l"
    for p, mask in _POLICY_BITS.items()
    for k, name in enumerate(_RULE_NAMES)
    if mask >> k & 1
)

OP11_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (
  SELECT doc_id, part, (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS mask FROM w),
l AS (SELECT doc_id, coalesce(max((quality = 1)::INTEGER), 0) AS good, coalesce(max((toxic = 1)::INTEGER), 0) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
h AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
c AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS c(x, bit)),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM c a, c b, c c, c d, c e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (SELECT filter_order, step::INTEGER AS step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS earlier FROM o, range(1, 6) AS r(step)),
m AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN mask & (own | earlier) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & own <> 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & own <> 0 AND mask & earlier <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & own <> 0 AND mask & earlier = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & own <> 0 AND mask & earlier = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM h, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM m
"""

OP13_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, 1 AS depth, unnest(w) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' '))) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) FROM w),
f AS (SELECT lang, depth, phrase, count(*)::BIGINT AS a FROM g GROUP BY ALL HAVING count(*) >= 10),
c AS (
  SELECT lang, depth, phrase, a, unnest(range(1, depth)) AS k, string_split(phrase, ' ') AS s FROM f WHERE depth > 1),
cut AS (
  SELECT c.lang, c.depth, c.phrase, c.a, k, x.a AS l, y.a AS r, (1000000::HUGEINT * c.a * c.a // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(s[1:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(s[k + 1:c.depth], ' ')),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_part AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[i:i + 1], ' ') AS phrase, max(a) AS longer FROM f, range(1, 3) AS i(i) WHERE depth = 3 GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN inner_part USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op10_quality_rules": OP10_SQL, "quality_ablation": ABLATION_SQL, "op11_filter_interactions": OP11_SQL, "op13_collocations": OP13_SQL}
