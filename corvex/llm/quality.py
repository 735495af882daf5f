"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; the ledger holds the failure
bits and the measurements they rest on.  Policies are versioned masks over the
bits, so applying another policy, or finding what each rule of a policy removes
on its own, never reads a text again.

Only DataFrame functions are used.  The steps are kept in separate projections,
each of which refers to the one before it by column, so that no expensive
expression is evaluated twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvex.llm import store

#: A word, and a line that has one.
WORD, NOT_SPACE = "[^\\x20\\x09-\\x0D]+", "[^\\x20\\x09-\\x0D]"
WINDOW = 8

#: bit -> (name, predicate on the measurements).  The first two are the base rules.
RULES: dict[int, tuple[str, str]] = {
    0: ("too_few_words", "n_words < 20"),
    1: ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    2: ("long_words", "n_words > 0 and word_chars > 25 * n_words"),
    3: ("short_words", "n_words > 0 and word_chars < 2 * n_words"),
    4: ("symbols", "10 * n_symbols > n_words"),
    5: ("upper_case", "100 * n_upper > 40 * word_chars"),
    6: ("exclamations", "10 * n_exclaim > 3 * n_words"),
    7: ("repeated_lines", "n_lines > 4 and 100 * n_dup_lines > 50 * n_lines"),
}
BASE_MASK = 0b11

#: Versioned policies: a document is kept if no bit of the mask is set.
POLICIES: dict[str, int] = {
    "base": BASE_MASK,
    "v1": sum(1 << bit for bit in RULES),
    "v1-lenient": BASE_MASK | 1 << 4 | 1 << 5,
}


def _count(pattern: str) -> Column:
    """Code points of the text outside the negated class ``pattern``."""
    return F.length(F.regexp_replace("_text", pattern, "")).cast("long")


def _measured(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """_keep (a struct of the columns to keep), measurements and fail_bits."""
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("_keep"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))
    rows = rows.select(
        "_keep",
        F.size("_words").cast("long").alias("n_words"),
        F.aggregate("_words", F.lit(0).cast("long"), lambda total, w: total + F.length(w)).alias("word_chars"),
        _count("[^#*$%&|<>]+").alias("n_symbols"),
        _count("[^\\p{Lu}]+").alias("n_upper"),
        _count("[^!]+").alias("n_exclaim"),
        F.filter(F.split("_text", "\n"), lambda x: x.rlike(NOT_SPACE)).alias("_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    # Each word is hashed once; windows of two, four and eight words are put together from two halves.
    step = 1
    while step < WINDOW:
        rows = rows.withColumn("_hashes", F.expr(f"transform(_hashes, (h, i) -> xxhash64(h, get(_hashes, i + {step})))"))
        step *= 2
    rows = rows.withColumn("_hashes", F.slice("_hashes", 1, F.greatest(F.lit(0), F.size("_hashes") - (WINDOW - 1))))
    rows = rows.withColumn("n_lines", F.size("_lines").cast("long"))
    rows = rows.withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("_lines")))
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    rows = rows.withColumn(
        "_runs",
        F.when(repeats, F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    ).drop("_hashes", "_lines")
    same = lambda p, k, step: F.coalesce(F.get("_runs", k + step)["h"] == p["h"], F.lit(False))
    rows = rows.withColumn(
        "_starts",
        F.when(
            F.col("_runs").isNotNull(),
            F.sort_array(
                F.filter(
                    F.transform("_runs", lambda p, k: F.when(same(p, k, -1) | same(p, k, 1), p["i"])),
                    lambda i: i.isNotNull(),
                )
            ),
        ),
    ).drop("_runs")
    covered = F.aggregate(
        "_starts",
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_starts")
    failed = [F.when(F.expr(rule), F.lit(1 << bit)).otherwise(F.lit(0)) for bit, (_, rule) in RULES.items()]
    # The row number, always true here, keeps the optimiser from moving a later filter below the projections, which
    # would write each measurement's expression out wherever it is used.
    bits = reduce(lambda a, b: a.bitwiseOR(b), failed)
    return rows.withColumn("fail_bits", F.when(F.monotonically_increasing_id() >= 0, bits).otherwise(F.lit(0)))


def ledger(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each document: its key, the measurements and ``fail_bits``.

    Null or blank text has no words, so that it fails ``too_few_words``; a null
    key stays null; rows that repeat are judged one by one; an empty table
    gives an empty ledger.  Other columns are dropped before anything is
    computed, so that their names cannot clash.  Repeated windows are found by
    64-bit hashes that are put together from those of their words.  A text is
    judged whole, however long it is.
    """
    rows = _measured(docs, text, [key])
    return rows.select(F.col(f"_keep.{key}"), *[c for c in rows.columns if c != "_keep"])


def stored(docs: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The ledger, written once to the shared folder, and the ablation of all policies read off it, written beside it.

    Whatever policy comes later reads the stored bits and measurements, no text.
    """
    rows = store.stage(ledger(docs, text, key), "quality-ledger")
    return rows, store.stage(ablation(rows), "quality-ablation")


def decided(rows: DataFrame, policies: list[str] | None = None) -> DataFrame:
    """Adds, for each policy, what one pass over the bits says of it: kept under it, and the one rule that alone removes the document (null if none or several do)."""
    out = {}
    for p in policies or POLICIES:
        own = F.col("fail_bits").bitwiseAND(F.lit(POLICIES[p]))
        alone = F.when(own == 0, None)
        for bit, (name, _) in RULES.items():
            alone = alone.when(own == (1 << bit), name)
        out |= {f"kept_{p}": own == 0, f"alone_{p}": alone}
    return rows.withColumns(out)


def passing(docs: DataFrame, policy: str = "v1", text: str = "text") -> DataFrame:
    """The documents that the policy keeps, with all their columns and no others.

    Null and blank texts go, as they have too few words; rows that repeat are
    judged one by one; a null key changes nothing.
    """
    rows = _measured(docs, text, docs.columns)
    return rows.where(F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy] | BASE_MASK)) == 0).select("_keep.*")


def apply_policy(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """Adds base_failed and kept under the policy; kept implies that the base rules hold."""
    base = F.col("fail_bits").bitwiseAND(F.lit(BASE_MASK)) != 0
    kept = F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy] | BASE_MASK)) == 0
    return rows.withColumns({"base_failed": base, "kept": kept, "policy": F.lit(policy)})


def ablation(rows: DataFrame, policies: list[str] | None = None) -> DataFrame:
    """For each policy and rule of it: documents the rule fails, those that it alone removes, and those kept without it.

    One pass over the ledger's bits; the sums are combined before the shuffle.
    An empty ledger gives counts of 0.
    """
    asked = [(p, bit) for p in policies or POLICIES for bit in RULES if POLICIES[p] >> bit & 1]
    bits, sums = F.col("fail_bits"), {}
    for p, bit in asked:
        own = bits.bitwiseAND(F.lit(POLICIES[p]))
        hits = {"failed": own.bitwiseAND(F.lit(1 << bit)) != 0, "alone": own == (1 << bit), "without": own.bitwiseAND(F.lit(~(1 << bit))) == 0}
        sums |= {f"{p}/{bit}/{k}": F.count_if(x) for k, x in hits.items()}
    total = rows.agg(F.count("*").alias("n"), *[x.alias(k) for k, x in sums.items()])
    entry = lambda p, bit: F.struct(F.lit(p).alias("policy"), F.lit(RULES[bit][0]).alias("rule"), F.col("n").alias("n_docs"), *[F.col(f"`{p}/{bit}/{k}`").alias(name) for k, name in (("failed", "n_failed"), ("alone", "n_only_this"), ("without", "n_kept_without"))])
    return total.select(F.inline(F.array(*[entry(p, bit) for p, bit in asked])))
