"""Nearest vectors: exact in blocks, and by an index of cells and product codes with payload filters."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvex.sources import shared

#: Vectors of a block.
BLOCK = 2048
#: Rows that cells and codes are fitted on; every row is indexed.
SAMPLE = 32768
#: Parts of a vector that are coded apart, and codes of a part.
PARTS, CODES = 16, 256
ITERATIONS = 12
#: Queries that the number of probes is read off.
ASKED = 64
#: Rows of a cell that lie together; larger cells are dealt over more pieces.
PIECE = 65536


def _unit(rows: list) -> np.ndarray:
    m = np.array([np.asarray(r, np.float64) for r in rows], np.float64)
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _packed(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Blocks of unit vectors: ids and the bytes of a matrix; rows without a vector are left out."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), BLOCK):
                part = batch.iloc[k : k + BLOCK]
                yield pd.DataFrame({"ids": [part[key].to_numpy(np.int64)], "m": [_unit(part[vector].tolist()).tobytes()]})

    return rows.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(key, vector).mapInPandas(pack, "ids array<long>, m binary")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, vec_id, score, rank) of the k nearest vectors by cosine of every query, itself left out.

    Both sides are packed in blocks; each pair of blocks is one matrix product
    that leaves k rows for a query.  Nothing is sent whole to any task, however
    many queries there are.  Equal scores (to 12 digits) are ordered by id.
    """

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for q_ids, q, ids, m in zip(batch["q_ids"], batch["q"], batch["ids"], batch["m"]):
                a, b = (np.frombuffer(x, np.float64).reshape(len(n), -1) for x, n in ((q, q_ids), (m, ids)))
                found = np.round(a @ b.T, 12)
                found[np.asarray(q_ids)[:, None] == np.asarray(ids)[None, :]] = -np.inf
                # The block's ids are in order, so that a stable sort puts the smaller of equals first.
                order = np.argsort(-found, axis=1, kind="stable")[:, : k + 1]
                best = np.take_along_axis(found, order, axis=1)
                keep = np.isfinite(best)
                yield pd.DataFrame({"query_id": np.repeat(np.asarray(q_ids), order.shape[1])[keep.ravel()], key: np.asarray(ids)[order].ravel()[keep.ravel()], "score": best.ravel()[keep.ravel()]})

    right = _packed(vectors, key, vector).select(F.col("ids"), "m")
    # Ids in order within a block.
    left = _packed(queries, key, vector).select(F.col("ids").alias("q_ids"), F.col("m").alias("q"))
    pairs = left.crossJoin(_ordered(right))
    scored = pairs.mapInPandas(score, f"query_id long, {key} long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _ordered(blocks: DataFrame) -> DataFrame:
    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, m in zip(batch["ids"], batch["m"]):
                order = np.argsort(ids, kind="stable")
                yield pd.DataFrame({"ids": [np.asarray(ids)[order]], "m": [np.frombuffer(m, np.float64).reshape(len(ids), -1)[order].tobytes()]})

    return blocks.mapInPandas(sort, "ids array<long>, m binary")


def _means(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means of a sample; cells that lose all rows take one that lies far from its mean."""
    k = min(k, len(rows))
    means = rows[rng.choice(len(rows), k, replace=False)].copy()
    for _ in range(ITERATIONS):
        far = (rows * rows).sum(1)[:, None] - 2 * rows @ means.T + (means * means).sum(1)[None, :]
        own = far.argmin(axis=1)
        sums, n = np.zeros_like(means), np.bincount(own, minlength=k)
        np.add.at(sums, own, rows)
        means[n > 0] = sums[n > 0] / n[n > 0, None]
        lost = np.flatnonzero(n == 0)
        if len(lost):
            means[lost] = rows[np.argsort(-far[np.arange(len(rows)), own], kind="stable")[: len(lost)]]
    return means


def _closest(rows: np.ndarray, means: np.ndarray) -> np.ndarray:
    return ((means * means).sum(1)[None, :] - 2 * rows @ means.T).argmin(axis=1)


@dataclass
class VectorIndex:
    """Means of the cells, code books of the residuals' parts, and the folder of the rows."""

    spark: SparkSession
    path: str
    means: np.ndarray
    books: np.ndarray  # parts, codes, width

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")


def _encoder(means: np.ndarray, books: np.ndarray):  # noqa: ANN202
    def run(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = _closest(m, means)
        rest = m - means[cell]
        width = books.shape[2]
        codes = np.stack([_closest(rest[:, p * width : (p + 1) * width], books[p]) for p in range(len(books))], axis=1)
        return cell, codes.astype(np.uint8)

    return run


def build(vectors: DataFrame, path: str, payload: list[str], cells: int | None = None, key: str = "vec_id", vector: str = "embedding") -> VectorIndex:
    """Writes the index: every row with its cell, piece, codes, unit vector and payload, in folders by cell.

    Means and code books are fitted on a sample of at most SAMPLE rows or so.
    Without a number of cells, there are as many as the square root of the rows,
    4096 at most.
    """
    spark = vectors.sparkSession
    whole = vectors.where(F.col(vector).isNotNull() & F.col(key).isNotNull())
    n = whole.count()
    if not n:
        raise ValueError("no vectors")
    cells = cells or max(1, min(4096, int(n**0.5)))
    sample = whole.select(vector).sample(min(1.0, SAMPLE / n * 0.98), seed=5).limit(SAMPLE).collect() or whole.select(vector).limit(1).collect()
    rng = np.random.default_rng(5)
    fit = _unit([r[0] for r in sample])
    means = _means(fit, cells, rng)
    rest = fit - means[_closest(fit, means)]
    dims = fit.shape[1]
    parts = max(p for p in range(1, PARTS + 1) if dims % p == 0)
    width = dims // parts
    found = [_means(rest[:, p * width : (p + 1) * width], CODES, rng) for p in range(parts)]
    books = np.stack(found)
    encode = _encoder(means, books)
    columns = ", ".join(f"{c} {whole.schema[c].dataType.simpleString()}" for c in payload)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                m = _unit(batch[vector].tolist())
                cell, codes = encode(m)
                yield pd.DataFrame({key: batch[key].to_numpy(), **{c: batch[c] for c in payload}, "codes": [c.tobytes() for c in codes], "unit": [r.tobytes() for r in m], "cell": cell.astype(np.int32)})

    rows = whole.select(key, vector, *payload).mapInPandas(run, f"{key} long, {columns + ', ' if columns else ''}codes binary, unit binary, cell int")
    rows.write.parquet(f"{path}/build")
    rows = spark.read.parquet(f"{path}/build")
    pieces = rows.groupBy("cell").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))  # a row for each cell
    dealt = rows.join(F.broadcast(pieces), "cell").withColumn("piece", F.pmod(F.xxhash64(key), F.col("pieces")).cast("int")).drop("pieces")
    dealt.repartition("cell", "piece").sortWithinPartitions("cell", "piece", key).write.partitionBy("cell").parquet(f"{path}/rows")
    spark.createDataFrame([(len(means), dims, len(books), books.shape[1], means.tobytes(), books.tobytes())], "cells int, dims int, parts int, codes int, means binary, books binary").coalesce(1).write.parquet(f"{path}/model")
    shared.delete(spark, f"{path}/build")
    return VectorIndex(spark, path, means, books)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    """An index that has been written."""
    r = spark.read.parquet(f"{path}/model").first()
    means = np.frombuffer(bytes(r.means), np.float64).reshape(r.cells, r.dims)
    return VectorIndex(spark, path, means, np.frombuffer(bytes(r.books), np.float64).reshape(r.parts, r.codes, r.dims // r.parts))


def probes_for(index: VectorIndex, queries: DataFrame, k: int, share: float = 0.95, test: Column | None = None, key: str = "vec_id", vector: str = "embedding") -> int:
    """The fewest probes whose cells hold that share of the k nearest rows that pass the test.

    Read off at most ASKED of the queries, answered exactly.  Vectors without
    clusters need nearly all cells, as any index does with them.
    """
    usable = queries.where(F.col(vector).isNotNull() & F.col(key).isNotNull())
    asked = usable.orderBy(F.xxhash64(key), key).limit(ASKED).select(key, vector).collect()
    if not asked:
        return 1
    cells = np.argsort(-(_unit([r[1] for r in asked]) @ index.means.T), axis=1, kind="stable")
    place = {r[0]: np.argsort(c) for r, c in zip(asked, cells)}
    rows = index.rows if test is None else index.rows.where(test)
    some = index.spark.createDataFrame([(r[0], [float(x) for x in r[1]]) for r in asked], f"{key} long, {vector} array<double>")
    truth = nearest(rows.select(key, _array(F.col("unit")).alias(vector)), some, k, key, vector)
    found = rows.select(key, "cell").join(F.broadcast(truth.select("query_id", key)), key).collect()  # ASKED * k rows
    if not found:
        return 1
    places = sorted(int(place[r.query_id][r.cell]) for r in found)
    return 1 + places[max(0, int(np.ceil(share * len(places))) - 1)]


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int = 8, spare: int = 20, test: Column | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, vec_id, score, rank): nearly the k nearest of the rows that pass the payload test, for every query.

    The test reaches the scan, before any cell is probed.  Each query goes to
    the ``probes`` nearest cells; codes rank k * spare rows of each piece, whose
    own vectors decide.  A query that finds fewer than k this way (a narrow test
    leaves its cells nearly empty) is answered by the exact way over all rows
    that pass.
    """
    means, books = index.means, index.books
    probes = min(probes, len(means))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                q = _unit(batch[vector].tolist())
                near = np.argsort(-(q @ means.T), axis=1, kind="stable")[:, :probes]
                yield pd.DataFrame({"query_id": np.repeat(batch[key].to_numpy(), probes), "q": np.repeat([r.tobytes() for r in q], probes), "cell": near.ravel().astype(np.int32)})

    def score(keys: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], key: [], "score": []})
        right = right.sort_values(key)  # of rows with equal codes, the smaller ids are kept
        q = np.stack([np.frombuffer(x, np.float64) for x in left["q"]])
        codes = np.stack([np.frombuffer(x, np.uint8) for x in right["codes"]])
        width, ids = books.shape[2], right[key].to_numpy()
        rough = (q @ means[keys[0]])[:, None] + np.zeros((1, len(ids)))
        for p in range(len(books)):
            rough += (q[:, p * width : (p + 1) * width] @ books[p].T)[:, codes[:, p]]
        short = min(len(ids), k * spare + 1)
        pick = np.argsort(-np.round(rough, 9), axis=1, kind="stable")[:, :short]
        units = np.stack([np.frombuffer(x, np.float64) for x in right["unit"]])
        exact = np.round(np.einsum("qd,qsd->qs", q, units[pick]), 12)
        order = np.lexsort((ids[pick], -exact), axis=1)[:, : k + 1]
        out = pd.DataFrame({"query_id": np.repeat(left["query_id"].to_numpy(), order.shape[1]), key: np.take_along_axis(ids[pick], order, axis=1).ravel(), "score": np.take_along_axis(exact, order, axis=1).ravel()})
        return out[out["query_id"] != out[key]]

    rows = index.rows if test is None else index.rows.where(test)
    asked = queries.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(key, vector)
    routed = asked.mapInPandas(route, "query_id long, q binary, cell int")
    pieces = rows.select("cell", F.col("piece").alias("to_piece")).distinct()
    sent = routed.join(pieces, "cell")
    # Queries of one cell and piece meet its rows in blocks of queries, so that no group holds all of them.
    lots = 8
    sent = sent.withColumn("lot", F.pmod(F.xxhash64("query_id"), F.lit(lots)))
    held = rows.select("cell", "piece", key, "codes", "unit").withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lots - 1).cast("long"))))
    found = sent.groupBy("cell", "to_piece", "lot").cogroup(held.groupBy("cell", "piece", "lot")).applyInPandas(score, f"query_id long, {key} long, score double")
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), key)
    best = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    path = f"{index.path}/found-{uuid.uuid4().hex}"
    best.write.parquet(path)
    best = index.spark.read.schema(best.schema).parquet(path)
    enough = best.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias(key))
    poor = asked.join(enough, key, "left_anti")
    if not poor.limit(1).count():
        return best
    exact = nearest(rows.select(key, _array(F.col("unit")).alias(vector)), poor, k, key, vector)
    return best.join(enough.withColumnRenamed(key, "query_id"), "query_id", "left_semi").unionByName(exact)


def _array(unit: Column) -> Column:
    """The numbers of a stored vector."""

    @F.pandas_udf("array<double>")
    def read(units: pd.Series) -> pd.Series:
        return units.map(lambda x: np.frombuffer(x, np.float64))

    return read(unit)


def recall(found: DataFrame, truth: DataFrame, key: str = "vec_id") -> float:
    """The share of the truth's pairs that were found."""
    hits = truth.join(found.select("query_id", key), ["query_id", key], "left_semi").count()
    return hits / max(1, truth.count())
