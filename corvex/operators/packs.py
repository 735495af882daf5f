"""Immutable packs: content-addressed snapshots, commits that never overwrite, lineage and reload."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvex.sources import shared


class PackConflict(ValueError):
    """A pack of this id is stored with other content."""


def canonical(rows: DataFrame, columns: list[str]) -> Column:
    """A pack's payload as JSON with its fields in order of their names; nulls are written."""
    return F.to_json(F.struct(*[F.col(c).alias(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def sealed(packs: DataFrame, columns: list[str]) -> DataFrame:
    """Adds payload and pack_hash (SHA-256 of the payload)."""
    return packs.withColumn("payload", canonical(packs, columns)).withColumn("pack_hash", F.sha2("payload", 256))


class PackStore:
    """Packs under a path: folders of Parquet, and a log that names them in order.

    A commit writes its folder first and then creates the next file of the log,
    which can be created only once.  Who comes second checks what the first one
    has added, and takes the next number.  Folders without a log entry, left by
    a writer that died, are never read.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str = "pack_id string, parent_pack_id string, pack_version int, payload string, pack_hash string") -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _folders(self) -> list[str]:
        found = []
        while shared.exists(self.spark, name := f"{self.path}/log/{len(found):012d}"):
            found.append(shared.read_text(self.spark, name))
        return found

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f}" for f in folders])

    def packs(self) -> DataFrame:
        """All packs."""
        return self._read(self._folders())

    def _check(self, new: DataFrame, old: DataFrame) -> None:
        both = new.select("pack_id", F.col("pack_hash").alias("_new")).join(old.select("pack_id", "pack_hash"), "pack_id")
        clash = both.where("_new <> pack_hash").select("pack_id").limit(5).collect()
        if clash:
            raise PackConflict(f"stored with other content: {', '.join(str(r.pack_id) for r in clash)}")

    def save(self, packs: DataFrame) -> int:
        """Stores the packs that aren't there yet; their number.

        The same pack again adds nothing.  An id with another hash, within the
        packs given or against the store, is an error, and nothing is stored.
        """
        folder = uuid.uuid4().hex
        columns = [c.split()[0] for c in self.schema.split(", ")]
        rows = packs.select(*columns)
        twice = rows.groupBy("pack_id").agg(F.countDistinct("pack_hash").alias("n")).where("n > 1").limit(5).collect()
        if twice:
            raise PackConflict(f"given with two contents: {', '.join(str(r.pack_id) for r in twice)}")
        seen = self._folders()
        self._check(rows, self._read(seen))
        fresh = rows.dropDuplicates(["pack_id"]).join(self._read(seen).select("pack_id"), "pack_id", "left_anti")
        fresh.select(*columns).write.parquet(f"{self.path}/data/{folder}")
        mine = self._read([folder])
        n = mine.count()
        if not n:
            shared.delete(self.spark, f"{self.path}/data/{folder}")
            return 0
        while not shared.put_if_absent(self.spark, f"{self.path}/log/{len(seen):012d}", folder):
            now = self._folders()
            others = self._read(now[len(seen) :])
            try:
                self._check(mine, others)
            except PackConflict:
                shared.delete(self.spark, f"{self.path}/data/{folder}")
                raise
            # What another writer has stored meanwhile goes, so that no pack is there twice.
            if mine.join(others.select("pack_id"), "pack_id", "left_semi").limit(1).count():
                again = uuid.uuid4().hex
                mine.join(others.select("pack_id"), "pack_id", "left_anti").select(*columns).write.parquet(f"{self.path}/data/{again}")
                shared.delete(self.spark, f"{self.path}/data/{folder}")
                folder, mine = again, self._read([again])
                n = mine.count()
                if not n:
                    shared.delete(self.spark, f"{self.path}/data/{folder}")
                    return 0
            seen = now
        return n


def verified(packs: DataFrame) -> DataFrame:
    """Adds ``intact``: whether a stored payload still has its hash."""
    return packs.withColumn("intact", F.sha2("payload", 256) == F.col("pack_hash"))


def ancestors(links: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, ancestor, distance) of every node and all its ancestors, itself at distance 0.  Staged.

    Pointer doubling: a round joins paths of up to 2^k steps with paths of 2^k
    steps, so that a chain of depth d takes log2(d) rounds.  Rounds are written
    to the shared folder.  A parent that isn't a node itself is an ancestor
    without ancestors; null parents end a chain; repeated links count once.  A
    cycle is an error.
    """
    spark = links.sparkSession
    root = f"{shared.shared_dir(spark)}/corvex-lineage/{uuid.uuid4().hex}"
    edges = links.where(F.col(node).isNotNull()).select(F.col(node).alias("node"), F.col(parent).alias("ancestor")).distinct()
    if edges.where("ancestor is not null").groupBy("node").count().where("count > 1").limit(1).count():
        raise ValueError("a node has two parents")
    edges.write.parquet(f"{root}/edges")
    edges = spark.read.parquet(f"{root}/edges")
    n = edges.count()

    def staged(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    # jump: the ancestor exactly 2^k steps up; reach: all ancestors within 2^k - 1 steps.
    jump = staged(edges.where("ancestor is not null"), "jump0")
    reach = staged(edges.select("node", F.col("node").alias("ancestor"), F.lit(0).cast("long").alias("distance")).distinct(), "reach0")
    step, k = 1, 0
    while jump.limit(1).count():
        if step > n:
            raise ValueError("the links hold a cycle")
        up = jump.select(F.col("node"), F.col("ancestor").alias("via"))
        far = up.join(reach.select(F.col("node").alias("via"), "ancestor", "distance"), "via", "left")
        far = far.select("node", F.coalesce("ancestor", "via").alias("ancestor"), (F.coalesce("distance", F.lit(0)) + step).alias("distance"))
        k += 1
        reach = staged(reach.unionByName(far), f"reach{k}")
        jump = staged(up.join(jump.select(F.col("node").alias("via"), "ancestor"), "via").select("node", "ancestor"), f"jump{k}")
        step *= 2
    return reach


def reload(store: DataFrame, items: DataFrame, pages: DataFrame, anchors: DataFrame, wanted: DataFrame) -> DataFrame:
    """The items of wanted packs and of all their ancestors, with page and anchor of each, in order.

    store: pack_id, parent_pack_id; items: pack_id, rank, pack_item_id,
    chunk_id, text (null where the chunk's own is meant); pages: chunk_id,
    page_start, page_end, chunk_text; anchors: chunk_id, anchor_id (the first of
    several counts); wanted: pack_id.  The item's own text goes before the
    chunk's; items of chunks that are gone stay, without a page.
    """
    line = ancestors(store, "pack_id", "parent_pack_id").join(wanted.select(F.col("pack_id").alias("node")).distinct(), "node", "left_semi")
    own = line.select(F.col("node").alias("pack_id"), F.col("ancestor").alias("from_pack_id"), F.col("distance").alias("generation"))
    rows = own.join(items.withColumnRenamed("pack_id", "from_pack_id"), "from_pack_id")
    first = anchors.groupBy("chunk_id").agg(F.min("anchor_id").alias("anchor_id"))
    rows = rows.join(pages, "chunk_id", "left").join(first, "chunk_id", "left")
    place = F.row_number().over(Window.partitionBy("pack_id").orderBy("generation", "rank", "pack_item_id"))
    return rows.select("pack_id", place.alias("place"), "generation", "from_pack_id", "pack_item_id", "chunk_id", F.coalesce("text", "chunk_text").alias("text"), "page_start", "page_end", "anchor_id")
