"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvex.llm import store


def components(edges: DataFrame, scratch: store.Scratch | None = None, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has an edge to another; root is the component's least node.  Staged.

    Large-star and small-star steps alternate until the edges form stars around
    their least nodes.  Each step sends a node's least neighbour to its
    neighbours, so that it makes no more rows than there are edges; edges stay
    in the shared folder, and only the number of nodes that hinder comes back.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    scratch = scratch or store.Scratch(edges.sparkSession)
    now = scratch.stage(now, "edges")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = scratch.stage(large, "edges")
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(lows.select("u", F.col("m").alias("v"))).distinct()
        before, now = now, scratch.stage(small, "edges")
        scratch.drop(before, large)
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
    out = scratch.stage(stars, "components")
    scratch.drop(now)
    return out


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one lesser neighbour at most, and none if it is itself one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("low")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("low")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("low").alias("low"))
    return not nodes.agg(F.count_if((F.col("up") > 1) | (F.col("up") + F.col("low") > 1))).first()[0]
