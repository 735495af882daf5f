"""Exact neighbours against plain numpy; the index's recall, filters, hot cells and odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvex.operators import vectors
from corvex.sources import shared


def brute(rows, asked, k, keep=lambda r: True):
    m = {i: np.array(v, float) for i, v, *_ in rows if v is not None}
    unit = {i: v / np.linalg.norm(v) if np.linalg.norm(v) else v for i, v in m.items()}
    out = set()
    for q in asked:
        found = sorted((-round(float(unit[q] @ unit[i]), 12), i) for i, v, *rest in rows if v is not None and i != q and keep((i, v, *rest)))
        out |= {(q, i, rank) for rank, (_, i) in enumerate(found[:k], 1)}
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_exact_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).astype("float32").tolist(), 0) for i in range(150)]
    rows += [(1000 + i, rows[i % 3][1], 0) for i in range(30)] + [(5000, None, 0), (5001, [0.0] * 6, 0)]
    random.Random(2).shuffle(rows)
    df = frame(spark, rows).repartition(5)
    got = {(r.query_id, r.vec_id, r["rank"]) for r in vectors.nearest(df, df.where("vec_id % 10 = 0"), 7).collect()}
    assert got == brute(rows, [i for i, v, _ in rows if i % 10 == 0 and v is not None], 7)


def test_many_queries(spark):
    """More queries than any block holds."""
    rng = np.random.default_rng(3)
    df = frame(spark, [(i, rng.normal(size=4).astype("float32").tolist(), 0) for i in range(10_000)])
    found = vectors.nearest(df.where("vec_id < 300"), df, 1)
    assert found.count() == 10_000


@pytest.fixture(scope="module")
def indexed(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 32)) * 2
    rows = [(i, (centres[i % 40] + rng.normal(size=32)).astype("float32").tolist(), i % 100) for i in range(6000)]
    rows += [(10_000 + i, rows[0][1], 7) for i in range(3000)] + [(20_000, None, 1)]  # a third are one vector
    df = frame(spark, rows).repartition(6).cache()
    return rows, df, vectors.build(df, f"{shared.shared_dir(spark)}/test-vectors-{random.random()}", ["label"])


def test_recall(spark, indexed):
    rows, df, index = indexed
    asked = df.where("vec_id % 50 = 0 and vec_id < 10000")
    assert index.rows.count() == 9000
    truth = vectors.nearest(df.where("vec_id < 10000"), asked, 10)
    found = vectors.search(index, asked, 10, test=F.col("vec_id") < 10000)
    assert vectors.recall(found, truth) >= 0.9
    assert found.groupBy("query_id").count().where("count <> 10").count() == 0
    again = vectors.search(vectors.open_index(spark, index.path), asked, 10, test=F.col("vec_id") < 10000)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, found.collect()))


def test_filter_before_probing(spark, indexed):
    """A test that one row in a hundred passes leaves cells nearly empty: the exact way answers."""
    rows, df, index = indexed
    asked = df.where("vec_id in (50, 100, 10001)")
    got = {(r.query_id, r.vec_id, r["rank"]) for r in vectors.search(index, asked, 60, probes=2, test=F.col("label") == 33).collect()}
    assert got == brute(rows, [50, 100, 10001], 60, lambda r: r[2] == 33)
    plan = index.rows.where(F.col("label") == 33)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(label,33)" in plan


def test_copies_in_one_cell(spark, indexed, monkeypatch):
    rows, df, index = indexed
    got = vectors.search(index, df.where("vec_id = 10005"), 20, probes=4)
    assert [r.vec_id for r in got.orderBy("rank").collect()] == [0, *range(10_000, 10_005), *range(10_006, 10_020)]
    monkeypatch.setattr(vectors, "PIECE", 500)
    split = vectors.build(df, f"{shared.shared_dir(spark)}/test-vectors-{random.random()}", ["label"], cells=16)
    assert split.rows.groupBy("cell", "piece").count().agg(F.max("count")).first()[0] < 700
    got = vectors.search(split, df.where("vec_id = 10005"), 20, probes=4)
    assert [r.vec_id for r in got.orderBy("rank").collect()] == [0, *range(10_000, 10_005), *range(10_006, 10_020)]


def test_probes_for_vectors_without_clusters(spark):
    """A fixed number of probes misses a third of the neighbours here; few cells do for clusters."""
    rng = np.random.default_rng(7)
    df = frame(spark, [(i, rng.normal(size=64).astype("float32").tolist(), i % 10) for i in range(2000)]).cache()
    asked, test = df.where("vec_id % 25 = 0"), F.col("label") % 2 == 0
    index = vectors.build(df, f"{shared.shared_dir(spark)}/test-vectors-{random.random()}", ["label"])
    truth = vectors.nearest(df.where(test), asked, 10).cache()
    probes = vectors.probes_for(index, asked, 10, test=test)
    assert vectors.recall(vectors.search(index, asked, 10, probes=probes, test=test), truth) >= 0.9
    assert vectors.recall(vectors.search(index, asked, 10, probes=16, test=test), truth) < 0.9
    assert vectors.probes_for(index, asked.where("vec_id < 0"), 10) == 1
    centres = rng.normal(size=(40, 32)) * 20
    near = frame(spark, [(i, (centres[i % 40] + rng.normal(size=32)).astype("float32").tolist(), 0) for i in range(2000)]).cache()
    index = vectors.build(near, f"{shared.shared_dir(spark)}/test-vectors-{random.random()}", ["label"], cells=40)
    assert vectors.probes_for(index, near.where("vec_id % 50 = 0"), 10) < 10
