"""Ingestion runs as keyed state: counts of each run, kept over restarts, with a timer for runs that fall silent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from corvex.operators.relational import first_per_key
from corvex.streaming import rates

#: Documents of one run are dealt over so many keys, so that a run with a third of all events isn't one key.
BUCKETS = 16

OUTPUT = "run string, bucket int, status string, documents long, pages long, chunks long, errors long, last_ms long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RunTotals(StatefulProcessor):
    """Totals of the documents of one run and bucket.

    documents are distinct ids; pages, chunks and errors are sums over events,
    each of which counts once, however often it is delivered.  A run that sends
    nothing for ``idle_ms`` is interrupted; its next event resumes it with all
    its counts.  A finish event's status stays until an event resumes the run.
    """

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "status string, documents long, pages long, chunks long, errors long, last_ms long")
        self.events = handle.getMapState("events", "event string", "seen int")
        self.documents = handle.getMapState("documents", "document string", "seen int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        held = self.totals.get() if self.totals.exists() else ("running", 0, 0, 0, 0, 0)
        status, documents, pages, chunks, errors, last = held
        for batch in rows:
            for r in batch.sort_values(["ms", "event"]).itertuples(index=False):
                if self.events.containsKey((r.event,)):
                    continue
                self.events.updateValue((r.event,), (1,))
                if r.ms >= last:
                    status = r.status if r.kind == "finish" else "running"
                last = max(last, r.ms)
                if r.kind != "document":
                    continue
                if isinstance(r.document, str) and not self.documents.containsKey((r.document,)):
                    self.documents.updateValue((r.document,), (1,))
                    documents += 1
                pages, chunks, errors = pages + int(r.pages), chunks + int(r.chunks), errors + (r.status == "failed")
        self.totals.update((status, documents, pages, chunks, errors, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if status == "running":
            self.handle.registerTimer(max(last + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield self._row(key, (status, documents, pages, chunks, errors, last))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        held = ("interrupted", *self.totals.get()[1:])
        self.totals.update(held)
        yield self._row(key, held)

    def _row(self, key: tuple, held: tuple) -> pd.DataFrame:
        return pd.DataFrame([(key[0], key[1], *held)], columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def run_totals(events: DataFrame, idle: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The stream of each run's totals, by bucket, whenever they change.

    events: event (id), run, document, kind (document or finish), status,
    pages, chunks, ts.  A finish event reaches every bucket of its run.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    every = F.sequence(F.lit(0), F.lit(BUCKETS - 1))
    own = F.array(F.pmod(F.xxhash64("document"), F.lit(BUCKETS)).cast("int"))
    rows = events.withWatermark("ts", late).select(
        "run", F.explode(F.when(F.col("kind") == "finish", every).otherwise(own)).alias("bucket"), "event", "document", "kind",
        F.coalesce("status", F.lit("")).alias("status"), F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("chunks", F.lit(0)).alias("chunks"), F.unix_millis("ts").alias("ms"), "ts",
    )
    return rows.groupBy("run", "bucket").transformWithStateInPandas(RunTotals(idle_ms), OUTPUT, "update", "eventTime")


def start(totals: DataFrame, path: str, once: bool = True) -> StreamingQuery:
    """Starts or resumes the stream of totals; keyed state lies in RocksDB under the checkpoint."""
    conf, name = totals.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, ROCKS)
    try:
        return rates.start(totals, path, "update", once)
    finally:
        conf.set(name, before)


def runs(table: DataFrame) -> DataFrame:
    """(run, status, documents, pages, chunks, errors) from a stream's table: the newest totals of each bucket, summed.

    A run is what its newest bucket is; buckets without a document, which only
    the finish event reached, add nothing.
    """
    last = first_per_key(table, ["run", "bucket"], F.col("batch").desc(), F.col("last_ms").desc())
    newest = F.max_by("status", F.struct("last_ms", "status"))
    return last.groupBy("run").agg(newest.alias("status"), *[F.sum(c).alias(c) for c in ("documents", "pages", "chunks", "errors")])


def run_once(events: DataFrame, path: str | None = None, idle: str = "1 hour") -> DataFrame:
    """Takes in all events that are there now and returns the runs so far."""
    spark = events.sparkSession
    path = path or rates.new_path(spark)
    totals = run_totals(events, idle)
    start(totals, path).awaitTermination()
    return runs(rates.written(spark, path, totals.schema))


def batch_runs(events: DataFrame) -> DataFrame:
    """The same totals of a table of events in one pass, without a stream (and so without interrupted runs)."""
    once = events.groupBy("event").agg(*[F.first(c).alias(c) for c in ("run", "document", "kind", "status", "pages", "chunks", "ts")])
    document = F.col("kind") == "document"
    last = F.max_by(F.when(document, F.lit("running")).otherwise(F.col("status")), F.struct("ts", "event"))
    return once.groupBy("run").agg(last.alias("status"), F.countDistinct(F.when(document, F.col("document"))).alias("documents"), *[F.coalesce(F.sum(F.when(document, F.col(c))), F.lit(0)).alias(c) for c in ("pages", "chunks")], F.count_if(document & (F.col("status") == "failed")).alias("errors"))

