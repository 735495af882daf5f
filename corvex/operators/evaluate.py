"""Retrieval evaluation: recall, reciprocal rank, discounted gain, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The least recall, reciprocal rank and gain.
BAR = {"recall": 0.90, "mrr": 0.75, "ndcg": 0.75}


def _gain(hits: Column) -> Column:
    return F.aggregate(F.transform(hits, lambda h, i: F.when(h, 1.0 / F.log2(i + 2.0)).otherwise(0.0)), F.lit(0.0), lambda a, b: a + b)


def metrics(cases: DataFrame, k: int) -> DataFrame:
    """Adds recall, rr, ndcg and missing to cases (expected, ranked arrays); no expected id gives 1."""
    if k < 1:
        raise ValueError("k must be positive")
    expected, top = F.array_distinct("expected"), F.slice("ranked", 1, k)
    rows = cases.withColumns({"_e": expected, "_top": top})
    rows = rows.withColumn("_hits", F.transform("_top", lambda x: F.array_contains(F.col("_e"), x)))
    none = F.size("_e") == 0
    first = F.array_position("_hits", True)
    ideal = _gain(F.transform(F.sequence(F.lit(1), F.least(F.lit(k), F.size("_e"))), lambda i: F.lit(True)))
    rows = rows.withColumns(
        {
            "recall": F.when(none, 1.0).otherwise(F.size(F.array_intersect("_e", "_top")) / F.size("_e")),
            "rr": F.when(none, 1.0).when(first > 0, 1.0 / first).otherwise(0.0),
            "ndcg": F.when(none, 1.0).otherwise(_gain(F.col("_hits")) / ideal),
            "missing": F.array_except("_e", "_top"),
        }
    )
    return rows.drop("_e", "_top", "_hits")


def by_label(rows: DataFrame, label: str = "evidence_label") -> DataFrame:
    """Means by label and whether they meet the bar."""
    out = rows.groupBy(label).agg(F.count("*").alias("n"), F.avg("recall").alias("recall"), F.avg("rr").alias("mrr"), F.avg("ndcg").alias("ndcg"))
    met = (F.col("recall") >= BAR["recall"]) & (F.col("mrr") >= BAR["mrr"]) & (F.col("ndcg") >= BAR["ndcg"])
    return out.withColumn("meets_bar", met).withColumns({c: F.round(c, 6) for c in ("recall", "mrr", "ndcg")})
