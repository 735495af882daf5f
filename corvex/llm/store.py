"""Intermediate tables in the folder that driver and executors share.

A staged table is written once and read again, which cuts the lineage: if an
executor is lost later, nothing before the table runs again.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from corvex.sources import shared


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.

    Where it is unset (tests), a local session gets a temporary folder; on a
    cluster an unset folder is an error, as no local folder is shared there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="corvex-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Lowers the bytes of text that go to a Python worker at once, which else is 64 MB for each running task."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def fresh(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/corvex/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes df as Parquet (in folders of ``by``, if given) and reads it again."""
    path = fresh(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path) if not by else df.sparkSession.read.parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a staged path."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Staged tables of one computation; each is dropped when its last reader is staged itself.

    Spark deletes the shuffle files of each write when it is done.  With collect
    the driver's collector is asked to run at each drop, for those of other
    plans; in a long computation that makes its heap grow.
    """

    def __init__(self, spark: SparkSession, collect: bool = True) -> None:
        self.spark, self.collect, self.paths = spark, collect, {}

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh(self.spark, name)
        with shared.brief_shuffles(self.spark):
            df.select("*").write.parquet(path)  # a new plan, as the setting is read when a plan is made
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            _, path = self.paths.pop(id(table))
            drop(self.spark, path)
        if self.collect:
            self.spark._jvm.System.gc()

    def drop_all(self) -> None:
        """Drops what is left."""
        self.drop(*[table for table, _ in self.paths.values()])
        self.spark._jvm.System.gc()
