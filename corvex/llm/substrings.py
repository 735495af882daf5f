"""Removal of repeated passages with a log-structured fingerprint index.

A window of 35 words that occurs twice holds, in both places, the same gram of
18 words whose hash is the least of its 18 grams.  Those grams (about one word
in nine) are a document's fingerprints.  The index keeps postings (fingerprint,
document) in sorted, immutable runs, all of them in the same buckets by
fingerprint, so that a new batch is merge-joined with each run without moving or
sorting the run.  The postings of a hot fingerprint are dealt over many buckets
by a salt.  The batch becomes a run itself, and runs are compacted before the
next batch once there are enough of them.  Windows around a fingerprint that
occurred before are then verified by 128 bits of all 35 words, 64 each from two
independent functions of the words' bytes.

Nothing is lost by the choice: equal windows have equal least grams.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvex.llm import store
from corvex.llm.wordhash import Words, chunks, combine, lean, lists

WINDOW, GRAM = 35, 18
#: Runs of one level that are compacted into one of the next.
FANOUT = 4
#: Batches in which the whole-table query feeds the index.
BATCHES = 3
#: A fingerprint of a run is hot from this number of its postings on, if they are half a bucket's mean as well.
HOT_LEAST = 256
#: Hot fingerprints of a run at most, and the counters by which they are found; one that is left has less than 1 / HOT_MOST of the postings.
HOT_MOST, HOT_COUNTERS = 4096, 1 << 16


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost least value in each ``width`` consecutive ones."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    at, size = np.arange(len(values)), 1

    def merged(at: np.ndarray, step: int) -> np.ndarray:
        a, b = at[: len(at) - step], at[step:]
        return np.where(values[b] < values[a], b, a)

    while 2 * size <= width:
        at, size = merged(at, size), 2 * size
    return merged(at, width - size)[:n] if size < width else at[:n]


def window_anchors(words: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each window that lies in one document, its fingerprint's word, gram hashes)."""
    n, grams = len(words.hash), words.grams(gram)
    if n < window:
        none = np.zeros(0, dtype=np.int64)
        return none, none, grams
    doc = words.word_doc()
    starts = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
    return starts, least(grams, window - gram + 1)[starts], grams


def _rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(docs[key].alias("_key"), docs[text].cast("binary").alias("_text"))


def _sha(raw: bytes) -> bytes:
    """SHA-256 of the words, joined by one space."""
    return hashlib.sha256(b" ".join(raw.split())).digest()


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """_key, n_words, sha (over the words) and anchors (fingerprints) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in chunks(batch.column(1)):
                words = Words(data, offsets)
                _, anchor, grams = window_anchors(words, window, gram)
                anchor = anchor[np.concatenate([[True], anchor[1:] != anchor[:-1]])] if len(anchor) else anchor
                bound = np.searchsorted(anchor, words.first)
                raw = data.tobytes()
                sha = [_sha(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                columns = [batch.column(0).slice(low, high - low), pa.array(np.diff(words.first)), pa.array(sha, pa.binary()), lists(grams[anchor].view(np.int64), bound, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["_key", "n_words", "sha", "anchors"])

    rows = _rows(docs, text, key)
    return rows.mapInArrow(lean(run), f"_key {rows.schema['_key'].dataType.simpleString()}, n_words long, sha binary, anchors array<long>")


class FingerprintIndex:
    """Sorted immutable runs of postings (hash, salt, doc) under a shared folder.

    A run is a Parquet folder ``run-<level>-<number>-<buckets>``; it counts once
    its writer has committed it (_SUCCESS), so a lost writer leaves no half run.
    All runs have as many buckets as the first one, which Spark is told by
    registering the folder as an external table.  The salt is 0 but for hot
    fingerprints, whose postings have salts from 1 to the number that the run's
    folder ``hot-...`` gives, about 1 / 32 of a bucket each.
    """

    def __init__(self, spark: SparkSession, path: str, fanout: int = FANOUT, doc_type: str = "bigint", hot_least: int = HOT_LEAST) -> None:
        self.spark, self.path, self.fanout, self.doc_type, self.hot_least = spark, path.rstrip("/"), fanout, doc_type, hot_least

    def runs(self) -> list[str]:
        """Names of the committed runs."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(root):
            return []
        names = [f.getPath().getName() for f in system.listStatus(root)]
        done = lambda n: system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))
        return sorted(n for n in names if n.startswith("run-") and done(n))

    def _table(self, name: str) -> str:
        return f"corvex_{hashlib.sha256(self.path.encode()).hexdigest()[:20]}_{name.replace('-', '_')}"

    def read(self, name: str) -> DataFrame:
        """The postings of a run, in its buckets."""
        table, buckets = self._table(name), int(name.split("-")[3])
        if not self.spark.catalog.tableExists(table):
            self.spark.sql(f"CREATE TABLE {table} (hash BIGINT, salt INT, doc {self.doc_type}) USING parquet CLUSTERED BY (hash, salt) SORTED BY (hash, salt) INTO {buckets} BUCKETS LOCATION '{self.path}/{name}'")
        return self.spark.table(table)

    def hot(self, name: str) -> DataFrame:
        """hash and salts of the hot fingerprints of a run, HOT_MOST at most."""
        return F.broadcast(self.spark.read.schema("hash long, salts int").parquet(f"{self.path}/hot-{name}"))

    def _hot_rows(self, rows: DataFrame, buckets: int) -> list[tuple[int, int]]:
        """(hash, salts) of the fingerprints with more postings than half a bucket's mean.

        Counts are over by less than a fifth of the least share, so each of them occurs more than once.
        """
        n, top = rows.agg(F.count("*"), F.expr(f"approx_top_k(hash, {HOT_MOST}, {HOT_COUNTERS})")).first()
        least = max(self.hot_least, n / (2 * buckets), n / HOT_MOST)
        # Many small parts, as several salts may meet in one bucket; a run has about 32 parts for each bucket at most.
        return [(t["item"], int(-(-32 * buckets * t["count"] // n))) for t in top or [] if t["count"] > least]

    def _write(self, rows: DataFrame, level: int) -> str:
        runs = self.runs()
        buckets = int(runs[0].split("-")[3]) if runs else int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"run-{level:02d}-{1 + max([int(n.split('-')[2]) for n in runs], default=0):06d}-{buckets}"
        # Before the run, so that a committed run has its list.
        self.spark.createDataFrame(self._hot_rows(rows, buckets), "hash long, salts int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/hot-{name}")
        salt = F.coalesce(1 + F.pmod(F.xxhash64("doc"), F.col("salts")), F.lit(0)).cast("int").alias("salt")
        rows = rows.select("hash", "doc").join(self.hot(name), "hash", "left").select("hash", salt, "doc")
        # Dealt by the buckets' own hash, so that each bucket is one file.
        rows = rows.repartition(buckets, "hash", "salt")
        rows.write.format("parquet").bucketBy(buckets, "hash", "salt").sortBy("hash", "salt").option("path", f"{self.path}/{name}").saveAsTable(self._table(name))
        return name

    def add(self, posts: DataFrame) -> DataFrame:
        """Adds a batch (hash, doc; a row for each occurrence) as a run; returns the hashes of it that have occurred twice by now."""
        self.compact()
        old, name = self.runs(), self._write(posts, 0)
        new = self.read(name).where("salt = 0").groupBy("hash", "salt").agg(F.count("*").alias("n"))
        once = new.where("n = 1").select("hash", "salt")
        seen = new.where("n > 1").select("hash").unionByName(self.hot(name).select("hash"))
        for run in old:
            seen = seen.unionByName(once.hint("merge").join(self.read(run).where("salt = 0").select("hash", "salt"), ["hash", "salt"], "left_semi").select("hash"))
            seen = seen.unionByName(once.join(self.hot(run), "hash", "left_semi").select("hash"))
        return store.stage(seen.distinct(), "repeated")

    def postings(self, hashes: DataFrame) -> DataFrame:
        """hash and doc of the hashes in all runs; the runs stay where they are, each hash goes to all of its salts."""

        def of(run: str) -> DataFrame:
            salts = F.when(F.col("salts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.col("salts")))
            wanted = hashes.join(self.hot(run), "hash", "left").select("hash", F.explode(salts).alias("salt"))
            return self.read(run).join(wanted.hint("merge"), ["hash", "salt"], "left_semi").select("hash", "doc")

        return reduce(DataFrame.unionByName, map(of, self.runs()))

    def compact(self) -> None:
        """Merges the runs of any level that has reached the fanout into one of the next."""
        level = 0
        while levels := [n for n in self.runs() if int(n.split("-")[1]) == level]:
            if len(levels) >= self.fanout:
                self._write(reduce(DataFrame.unionByName, map(self.read, levels)), level + 1)
                for n in levels:
                    self._forget(n)
            level += 1

    def _forget(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table(name)}")
        store.drop(self.spark, f"{self.path}/{name}")
        store.drop(self.spark, f"{self.path}/hot-{name}")

    def close(self) -> None:
        """Takes the runs' tables out of the session's catalog; the runs stay."""
        for name in self.runs():
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(name)}")

    def delete(self) -> None:
        """Deletes the index."""
        for name in self.runs():
            self._forget(name)
        store.drop(self.spark, self.path)


def _passages(docs: DataFrame, touched: DataFrame, text: str, key: str) -> DataFrame:
    """content, n, hits and _text of the touched (content, _key, sha, n, hits)."""
    texts = _rows(docs, text, key).withColumnRenamed("_key", "k")
    near = texts.join(touched, F.col("k").eqNullSafe(F.col("_key"))).select("content", "n", "hits", "_text", "sha")

    def own(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Another row may have the same key.
        for batch in rows:
            right = [sha is None or _sha(t or b"") == sha for t, sha in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield batch.filter(pa.array(right, pa.bool_())).select([0, 1, 2, 3])

    kind = near.schema["content"].dataType.simpleString()
    return near.mapInArrow(lean(own), f"content {kind}, n long, hits array<long>, _text binary")


def _windows(near: DataFrame, window: int, gram: int) -> DataFrame:
    """content, start, h1, h2 (two hashes) and n (2 at most) of all windows at the hits of the passages."""
    kind = near.schema["content"].dataType.simpleString()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for low, high, data, offsets in chunks(batch.column(3)):
                words = Words(data, offsets)
                starts, anchor, grams = window_anchors(words, window, gram)
                wanted = batch.column(2).slice(low, high - low).flatten().to_numpy()
                starts = starts[np.isin(grams[anchor].view(np.int64), wanted)]
                first, second = words.grams(window), combine(words.second(), window)
                doc = words.word_doc()[starts]
                n = batch.column(1).slice(low, high - low).to_numpy()
                columns = [batch.column(0).slice(low, high - low).take(pa.array(doc)), *map(pa.array, [(starts - words.first[doc]).astype(np.int32), first[starts].view(np.int64), second[starts].view(np.int64), np.minimum(n[doc], 2).astype(np.int32)])]
                yield pa.RecordBatch.from_arrays(columns, ["content", "start", "h1", "h2", "n"])

    return near.mapInArrow(lean(run), f"content {kind}, start int, h1 long, h2 long, n int")


def _cut(parts: DataFrame, window: int) -> DataFrame:
    """content, n_removed and kept (bytes) of passages (content, _text, starts of their repeated windows)."""
    kind = parts.schema["content"].dataType.simpleString()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            removed, kept = [], []
            starts = batch.column(2)
            for i, raw in enumerate(batch.column(1).to_pylist()):
                words, at = raw.split(), starts[i].values.to_numpy()
                change = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(change, at, 1)
                np.add.at(change, at + window, -1)
                keep = np.cumsum(change)[:-1] == 0
                removed.append(len(words) - int(keep.sum()))
                kept.append(b" ".join(compress(words, keep.tolist())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["content", "n_removed", "kept"])

    return parts.mapInArrow(lean(run), f"content {kind}, n_removed long, kept binary")


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id", batches: int = BATCHES, window: int = WINDOW, gram: int = GRAM, fanout: int = FANOUT) -> DataFrame:
    """key, n_words, n_removed, kept_sha256 and kept_text (null where nothing is removed) of each document.

    A word is removed if a window over it occurs anywhere else too.  Null text
    has no words; documents of fewer words than a window lose nothing; rows
    that repeat are occurrences like any other, so both lose all their windows;
    other columns are dropped first.  Documents with equal words (by SHA-256)
    have equal results, so one of each is worked on, counted twice.  A text is
    hashed whole, however long it is.  The table is fed to a new index in
    batches, as it would grow over time; runs are compacted on the way where
    there are more batches than the fanout.
    """
    spark = docs.sparkSession
    store.small_batches(spark)
    scratch = store.Scratch(spark)
    marks = scratch.stage(fingerprints(docs, text, key, window, gram), "fingerprints")
    groups = marks.groupBy("sha").agg(F.count("*").alias("n"), F.min("_key").alias("rep")).withColumn("content", F.monotonically_increasing_id())
    groups = scratch.stage(groups, "contents")
    other = groups.select(F.col("sha").alias("s"), "rep", "content")
    own = marks.where(F.size("anchors") > 0).join(other, (F.col("sha") == F.col("s")) & F.col("_key").eqNullSafe(F.col("rep")))
    own = scratch.stage(own.select(F.col("content").alias("doc"), F.explode("anchors").alias("hash"), F.pmod(F.xxhash64("content"), F.lit(batches)).alias("batch")), "anchors")
    marks, before = scratch.stage(marks.drop("anchors"), "marks"), marks
    scratch.drop(before)

    index = FingerprintIndex(spark, store.fresh(spark, "index"), fanout)
    seen = [index.add(own.where(F.col("batch") == b).select("hash", "doc")) for b in range(batches)]
    scratch.drop(own)
    # Staged, so that below the join stands nothing but its own exchange, whose hot partitions can be split.
    hits = scratch.stage(reduce(DataFrame.unionByName, seen).distinct(), "hits")
    touched = index.postings(hits).groupBy(F.col("doc").alias("content")).agg(F.collect_set("hash").alias("hits"))
    touched = touched.join(groups, "content").select("content", F.col("rep").alias("_key"), "sha", "n", "hits")
    near = scratch.stage(_passages(docs, touched, text, key), "passages")
    index.delete()
    found = scratch.stage(_windows(near, window, gram), "windows")
    twice = found.groupBy("h1", "h2").agg(F.sum("n").alias("total")).where("total > 1").select("h1", "h2")
    twice = scratch.stage(twice, "twice")
    repeated = found.where("n = 1").select("content", "start", "h1", "h2").join(twice, ["h1", "h2"], "left_semi")
    cuts = scratch.stage(repeated.groupBy("content").agg(F.collect_set("start").alias("starts")), "cuts")
    scratch.drop(found, twice, hits)

    parts = _cut(near.where("n = 1").select("content", "_text").join(cuts, "content"), window)
    # Contents that occur more than once are removed whole, without another look at the text.
    parts = parts.unionByName(groups.where("n > 1").select("content", F.lit(None).cast("long").alias("n_removed"), F.lit(None).cast("binary").alias("kept")))
    parts = groups.select(F.col("sha").alias("s"), "content").join(parts, "content")
    out = marks.join(parts, F.col("sha") == F.col("s"), "left")
    whole = F.col("s").isNotNull() & F.col("n_removed").isNull() & (F.col("n_words") >= window)
    return out.select(
        F.col("_key").alias(key),
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(whole, F.sha2(F.lit(b""), 256)).when(F.col("kept").isNotNull(), F.sha2("kept", 256)).otherwise(F.lower(F.hex("sha"))).alias("kept_sha256"),
        F.when(whole, F.lit("")).otherwise(F.col("kept").cast("string")).alias("kept_text"),
    )


def deduplicate_batch(docs: DataFrame, index: FingerprintIndex, history: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """key, n_words, n_removed, kept_sha256 and kept_text of each document of a new batch; the index then has the batch too.

    A word is removed if a window over it occurs elsewhere in the batch or in an
    earlier one, whose documents history holds (empty for the first batch).
    Keys are unique over all batches and not null.  Of history only documents
    that share a fingerprint with the batch are read as texts.
    """
    store.small_batches(docs.sparkSession)
    scratch = store.Scratch(docs.sparkSession)
    marks = scratch.stage(fingerprints(docs, text, key, window, gram), "fingerprints")
    seen = index.add(marks.select(F.explode("anchors").alias("hash"), F.col("_key").alias("doc")))
    touched = index.postings(seen).groupBy(F.col("doc").alias("content")).agg(F.collect_set("hash").alias("hits"))
    touched = scratch.stage(touched.select("content", F.col("content").alias("_key"), F.lit(None).cast("binary").alias("sha"), F.lit(1).cast("long").alias("n"), "hits"), "touched")
    both = docs.select(key, text).unionByName(history.select(key, text))
    near = scratch.stage(_passages(both, touched, text, key), "passages")
    found = scratch.stage(_windows(near, window, gram), "windows")
    twice = found.groupBy("h1", "h2").agg(F.sum("n").alias("total")).where("total > 1").select("h1", "h2")
    repeated = found.join(marks.select(F.col("_key").alias("content")), "content", "left_semi").join(twice, ["h1", "h2"], "left_semi")
    cuts = repeated.groupBy("content").agg(F.collect_set("start").alias("starts"))
    parts = scratch.stage(_cut(near.select("content", "_text").join(cuts, "content"), window), "cut")
    scratch.drop(touched, near, found)
    out = marks.join(parts, F.col("_key") == F.col("content"), "left")
    kept = F.coalesce(F.sha2("kept", 256), F.lower(F.hex("sha")))
    return out.select(F.col("_key").alias(key), "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), kept.alias("kept_sha256"), F.col("kept").cast("string").alias("kept_text"))
