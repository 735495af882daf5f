"""Streaming forms of the request counters and rollups, and the sink that streams write to."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructType

from corvex.sources import shared


def read_events(spark: SparkSession, path: str, files: int = 8) -> DataFrame:
    """Events as a stream of files."""
    schema = spark.read.parquet(path).schema
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isFile():
        # A stream reads folders; one file is its folder under a filter.
        reader, path = reader.option("pathGlobFilter", target.getName()), str(target.getParent())
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, seconds: int = 3600, limit: int = 2, late: str | None = None) -> DataFrame:
    """Requests by user, route and fixed window, and whether they stay within the limit.

    ``late`` is how long a window waits for late requests before its state is
    dropped, which takes the place of pruning.
    """
    rows = events.withWatermark("ts", late) if late else events
    counts = rows.groupBy("user_id", F.col("event_type").alias("route"), F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n"))
    return counts.select("user_id", "route", F.unix_seconds("w.start").alias("window_start"), "n", (F.col("n") <= limit).alias("allowed"))


def retry_after(window_start, now, seconds: int = 3600):  # noqa: ANN001, ANN201
    """Seconds until a window that is used up ends, one at least."""
    return F.greatest(F.lit(1), (window_start + seconds - now).cast("long"))


def daily_totals(events: DataFrame) -> DataFrame:
    """Counts and sums by day and type."""
    return events.groupBy(F.to_date("ts").cast("string").alias("day"), F.coalesce("event_type", F.lit("unknown")).alias("metric")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def start(result: DataFrame, path: str, mode: str = "append", once: bool = True) -> StreamingQuery:
    """Starts a stream into the table of ``path``, or resumes the one whose checkpoint is there.

    Rows are written by the executors.  In append and update mode each batch has
    a folder of its own, named by its id: a batch that runs again after a
    failure replaces its folder, so that it counts once.  In complete mode every
    batch is the whole table, and replaces it.
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/table/batch={0 if mode == 'complete' else batch}")

    stream = result.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint")
    return (stream.trigger(availableNow=True) if once else stream).start()


def written(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table of a stream, with the batch that each row came with; empty before the first batch."""
    whole = StructType([*schema.fields]).add("batch", LongType())
    if not shared.exists(spark, f"{path}/table"):
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).option("basePath", f"{path}/table").parquet(f"{path}/table")


def new_path(spark: SparkSession) -> str:
    """A new place for a stream's table and checkpoint in the shared folder."""
    return f"{shared.shared_dir(spark)}/corvex-streams/{uuid.uuid4().hex}"


def run_once(result: DataFrame, mode: str = "complete", path: str | None = None) -> DataFrame:
    """Runs a stream over all that is there now and returns its table.

    Table and checkpoint lie in the folder that executors share; with a path,
    a later call goes on where this one ended.  In append mode, windows that are
    not closed yet stay in the state and are no rows.
    """
    spark = result.sparkSession
    path = path or new_path(spark)
    start(result, path, mode).awaitTermination()
    return written(spark, path, result.schema).drop("batch")
