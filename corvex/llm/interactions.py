"""Filter interaction audit as a product with incidence matrices.

Each document's failures are a mask of five bits.  What any order of the
filters does to a part of the corpus depends on nothing but the part's
histogram over the 32 masks, so texts are read once: histograms (all documents,
good ones, toxic ones) are stacked as rows, and fixed integer matrices of 32
masks by 600 columns (120 orders of five steps) turn them into what is kept,
removed, redundant and uniquely failed.

Masks and histograms are DataFrame functions; numpy multiplies, in tasks that
hold a batch of parts each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = "[^\\x20\\x09-\\x0D]+"
FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = range(1, len(FILTERS) + 1)

SCHEMA = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def matrices() -> dict[str, np.ndarray]:
    """32 by 600 matrices of 0 and 1: which masks count towards an outcome of (order, step)."""
    masks = np.arange(MASKS)[:, None]
    bits = np.array([[1 << FILTERS.index(c) for c in order] for order in ORDERS])
    before = (np.cumsum(bits, axis=1) - bits).reshape(1, -1)
    own = bits.reshape(1, -1)
    fails, earlier = (masks & own) != 0, (masks & before) != 0
    found = {"kept": ~fails & ~earlier, "removed": fails & ~earlier, "redundant": fails & earlier, "unique_fails": np.broadcast_to(masks == own, fails.shape)}
    return {k: v.astype(np.int64) for k, v in found.items()}


def _base_mask(text: str) -> Column:
    """Bits of the filters that look at one text alone, from _words and the text."""
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    tests = [
        F.col("n_words") < 200,
        100 * F.col("n_distinct") < 50 * F.col("n_words"),
        100 * upper > 3 * F.length(text),
        F.col(text).rlike("[#$%&*|]"),
    ]
    return sum((F.when(t, F.lit(1 << i)).otherwise(F.lit(0)) for i, t in enumerate(tests)), F.lit(0))


def _texts(docs: DataFrame, text: str, part: str, key: str) -> DataFrame:
    """key, part, digest and the mask of filters A to D of every document."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))
    rows = rows.select("key", "part", "_text", F.size("_words").cast("long").alias("n_words"), F.size(F.array_distinct("_words")).cast("long").alias("n_distinct"))
    return rows.select("key", "part", F.unhex(F.sha2("_text", 256)).alias("digest"), _base_mask("_text").cast("byte").alias("mask"))


def histograms(docs: DataFrame, labels: DataFrame, text: str = "text", part: str = "lang", key: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): the incidence histogram, one row for each part and mask that occurs.

    Texts are known by SHA-256.  Copies are combined before every exchange:
    first rows of one key and text, then copies of one part, so that a group of
    copies that holds a third of the table is a few rows for each task.  The
    holder of a text's smallest key, found across parts, passes filter E.
    """
    rows = _texts(docs, text, part, key).groupBy("digest", "part", "mask", "key").agg(F.count("*").alias("n"))
    # A document without a key has no label: its digest spreads such rows over the exchange, and no key looks like it.
    rows = rows.withColumn("_key", F.coalesce(F.col("key").cast("string"), F.concat(F.lit("~"), F.hex("digest"))))
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).cast("long")
    marks = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("_key")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    rows = rows.join(marks, "_key", "left")
    rows = rows.select("digest", "part", "mask", "key", "n", *[(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")])
    # A document without a key has no smaller or larger one: it passes E and doesn't count among the copies.
    keyed = lambda c: F.sum(F.when(F.col("key").isNotNull(), F.col(c)).otherwise(0))
    held = F.min(F.when(F.col("key").isNotNull(), F.struct("key", "n", "good", "toxic"))).alias("held")
    counts = ("n", "good", "toxic")
    texts = rows.groupBy("digest", "part", "mask").agg(*[keyed(c).alias(c) for c in counts], *[(F.sum(c) - keyed(c)).alias(f"free_{c}") for c in counts], held)
    # One row for each part now, so that the least key of a text needs no more than a join on what occurs in several parts.
    least = texts.groupBy("digest").agg(F.min("held.key").alias("least"))
    texts = texts.join(least, "digest")
    first = F.coalesce(F.col("held.key") == F.col("least"), F.lit(False))
    passed = [(F.col(f"free_{c}") + F.when(first, F.col(f"held.{c}")).otherwise(0)).alias(c) for c in counts]
    failed = [(F.col(c) - F.when(first, F.col(f"held.{c}")).otherwise(0)).alias(c) for c in counts]
    bit = F.lit(1 << FILTERS.index("E"))
    both = F.array(F.struct(F.col("mask").cast("int").alias("mask"), *passed), F.struct((F.col("mask") + bit).cast("int").alias("mask"), *failed))
    cells = texts.select("part", F.inline(both)).where("n > 0")
    return cells.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in counts])


def outcomes(cells: DataFrame) -> DataFrame:
    """600 rows for each part of a histogram: every order and step of the filters, zeros included.

    A part is one row of 3 times 32 counts; a task multiplies a batch of parts
    at once.  All counts are 64-bit integers.
    """
    entry = F.struct("mask", "n", "good", "toxic")
    stacked = cells.groupBy("part").agg(F.collect_list(entry).alias("cells"))  # 32 entries at most
    column = lambda c: F.transform(F.sequence(F.lit(0), F.lit(MASKS - 1)), lambda m: F.coalesce(F.get(F.filter("cells", lambda x: x["mask"] == m), F.lit(0))[c], F.lit(0).cast("long"))).alias(c)
    return stacked.select("part", column("n"), column("good"), column("toxic")).mapInPandas(_multiply, SCHEMA)


def _multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    maps = matrices()
    letters = np.array([FILTERS.index(c) for order in ORDERS for c in order])
    share = (letters[:, None] == np.arange(len(FILTERS))[None, :]).astype(np.int64)
    for batch in batches:
        for start in range(0, len(batch), 256):
            rows = batch.iloc[start : start + 256]
            n, good, toxic = (np.array(rows[c].tolist(), np.int64).reshape(len(rows), MASKS) for c in ("n", "good", "toxic"))
            removed = n @ maps["removed"]
            out = {k: n @ maps[k] for k in ("kept", "redundant", "unique_fails")}
            out |= {"removed": removed, "good_lost": good @ maps["removed"], "toxic_lost": toxic @ maps["removed"], "shapley": (removed @ share)[:, letters]}
            cells = len(letters)
            yield pd.DataFrame(
                {
                    "part": np.repeat(rows["part"].to_numpy(), cells),
                    "filter_order": np.tile(np.repeat(ORDERS, len(FILTERS)), len(rows)),
                    "step": np.tile(np.array(STEPS, np.int32), len(rows) * len(ORDERS)),
                }
                | {k: v.ravel() for k, v in out.items()}
            )[[c.split()[0] for c in SCHEMA.split(", ")]]


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", part: str = "lang", key: str = "doc_id") -> DataFrame:
    """What each order of the filters A to E does to each part, step by step.

    A null text is empty (it fails A and, as an empty text, C never); a null
    part is the empty string; rows that repeat a key and a text count one by
    one and are no copies of each other; a null key passes E and has no label;
    several labels of one key are joined by or, and a null one is none.  Very
    long texts are judged whole.  An empty table has no parts and gives no
    rows.  Other columns are dropped first, so that their names cannot clash.
    """
    return outcomes(histograms(docs, labels, text, part, key))
