"""Relational patterns: newest of a key, first n of a key, either-or joins, ranges, pages of results, merges."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, keys: list[str], *order: Column, n: int = 1) -> DataFrame:
    """The first n rows of each key by order; Spark limits the groups before the exchange."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def join_on_either(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id) of rows that agree in any of the column pairs: a union of equi-joins, no nested loop."""
    found = None
    for a, b in pairs:
        part = left.join(right, left[a] == right[b]).select(left[left_id], right[right_id])
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def outside_ranges(points: DataFrame, ranges: DataFrame, key: str, point: str, low: str, high: str) -> DataFrame:
    """Points whose key has no range around them; the end of a range is its start where it is null."""
    other = ranges.select(F.col(key).alias("_k"), F.col(low).alias("_low"), F.coalesce(high, low).alias("_high"))
    inside = (points[key] == other["_k"]) & points[point].between(other["_low"], other["_high"])
    return points.join(other, inside, "left_anti")


def keyset_page(rows: DataFrame, keys: list[str], limit: int, cursor: str | None = None) -> DataFrame:
    """One row more than limit of what follows the cursor in falling order of the keys."""
    if cursor:
        values = json.loads(base64.urlsafe_b64decode(cursor))
        after = F.struct(*[F.lit(values[k]).cast(dict(rows.dtypes)[k]).alias(k) for k in keys])
        rows = rows.where(F.struct(*keys) < after)
    return rows.orderBy(*[F.col(k).desc() for k in keys]).limit(limit + 1)


def cursor_of(values: dict) -> str:
    """The cursor of a row's keys."""
    return base64.urlsafe_b64encode(json.dumps(values, sort_keys=True, default=str).encode()).decode()


def offset_page(rows: DataFrame, limit: int, offset: int, *order: Column, most: int = 1000) -> DataFrame:
    """A page and has_more on each row."""
    limit = min(limit, most)
    place = F.row_number().over(Window.orderBy(*order))
    probe = rows.orderBy(*order).limit(offset + limit + 1).withColumn("_place", place).where(F.col("_place") > offset)
    return probe.withColumn("has_more", F.max("_place").over(Window.partitionBy(F.lit(1))) > offset + limit).where(F.col("_place") <= offset + limit).drop("_place")


def merge_by_key(old: DataFrame, new: DataFrame, keys: list[str], policies: dict[str, str]) -> DataFrame:
    """The table after an upsert; each column has a policy.

    overwrite: new; keep: new unless null; fill: new unless null or empty;
    greatest: the larger; first: old unless null.  Keys must be unique in new.
    """
    joined = old.alias("o").join(new.alias("n"), [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full_outer")
    there = F.coalesce(*[F.col(f"n.{k}").cast("string") for k in keys]).isNotNull()

    def pick(c: str, how: str) -> Column:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        return {
            "overwrite": F.when(there, n).otherwise(o),
            "keep": F.coalesce(n, o),
            "fill": F.coalesce(F.nullif(n, F.lit("")), o) if how == "fill" else n,
            "greatest": F.greatest(o, n),
            "first": F.coalesce(o, n),
        }[how].alias(c)

    return joined.select(*[F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys], *[pick(c, how) for c, how in policies.items()])


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old, and the rows of new whose key it lacks."""
    return old.unionByName(new.join(old, keys, "left_anti").select(*old.columns))


def replace_scope(old: DataFrame, new: DataFrame, scope: str) -> DataFrame:
    """old without the scopes that new has, and new."""
    return old.join(new.select(scope).distinct(), scope, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def prune_stale(old: DataFrame, candidates: DataFrame, key: str, protect: Column) -> DataFrame:
    """old without rows that are neither candidates nor protected."""
    stale = old.where(~F.coalesce(protect, F.lit(False))).join(candidates.select(key).distinct(), key, "left_anti").select(key)
    return old.join(stale, key, "left_anti")


def difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of the keys that only one side has."""
    a, b = left.select(key).distinct().withColumn("_a", F.lit(1)), right.select(key).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, key, "full_outer")
    return both.where("_a is null or _b is null").select(key, F.when(F.col("_a").isNull(), "only_right").otherwise("only_left").alias("side"))
