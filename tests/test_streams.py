"""Streams over many files: every closed window once, over restarts; runs resumed after a failure."""

import pytest
from pyspark.sql import functions as F

from corvex.streaming import ingestion, rates


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """24 files of 10 events, one hour a file, in order."""
    root = tmp_path_factory.mktemp("events")
    for k in range(24):
        rows = spark.range(10).select(
            (F.col("id") + 10 * k).alias("event_id"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(k), F.col("id").cast("int") * 5)).cast("timestamp_ntz").alias("ts"),
            (F.col("id") % 3).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"),
        )
        rows.coalesce(1).write.mode("append").parquet(str(root / "all"))
    return str(root / "all")


def windows(spark, path):
    counts = rates.window_counts(spark.read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp")))
    return {(r.user_id, r.route, r.window_start): r.n for r in counts.collect()}


def test_append_keeps_every_closed_window_once(spark, files):
    stream = rates.window_counts(rates.read_events(spark, files, files=8), late="10 minutes")
    got = [((r.user_id, r.route, r.window_start), r.n) for r in rates.run_once(stream, "append").collect()]
    want = windows(spark, files)
    last = max(k[2] for k in want)
    assert len(got) == len(dict(got)) and dict(got) == {k: n for k, n in want.items() if k[2] < last}


def test_append_over_restarts(spark, files):
    """A batch fails after it wrote, then the stream goes on from its checkpoint."""
    path = rates.new_path(spark)
    failing = {"left": 2}

    def broken(rows, batch):
        rows.write.mode("overwrite").parquet(f"{path}/table/batch={batch}")
        if batch in (1, 3) and failing["left"]:
            failing["left"] -= 1
            raise RuntimeError("lost")

    make = lambda: rates.window_counts(rates.read_events(spark, files, files=4), late="10 minutes")
    for _ in range(2):
        stream = make().writeStream.outputMode("append").foreachBatch(broken).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        with pytest.raises(Exception):  # noqa: B017, PT011
            stream.awaitTermination()
    got = [((r.user_id, r.route, r.window_start), r.n) for r in rates.run_once(make(), "append", path).collect()]
    want = windows(spark, files)
    last = max(k[2] for k in want)
    assert len(got) == len(dict(got)) and dict(got) == {k: n for k, n in want.items() if k[2] < last}


def test_nothing_yet(spark, tmp_path):
    spark.createDataFrame([], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(str(tmp_path / "e"))
    assert rates.run_once(rates.window_counts(rates.read_events(spark, str(tmp_path / "e")), late="1 hour"), "append").count() == 0


EVENTS = "event string, run string, document string, kind string, status string, pages int, chunks int, ts timestamp"


def event_files(spark, folder):
    """Ten files: run a in all of them, b in the first two and then silent, c finished and taken up again."""
    import datetime

    at = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)
    for k in range(10):
        rows = [(f"a{k}-{i}", "a", f"doc{(k * 7 + i) % 40}", "document", "failed" if i % 5 == 0 else "complete", i, 2 * i, at(k, i)) for i in range(20)]
        rows.append((f"a{k}-3", "a", f"doc{(k * 7 + 3) % 40}", "document", "complete", 3, 6, at(k, 3)))  # delivered twice
        if k < 2:
            rows += [(f"b{k}", "b", f"doc{k}", "document", "complete", 5, 1, at(k, 1))]
        if k in (1, 7):
            rows += [(f"c{k}", "c", "doc1", "document", "complete", 1, 1, at(k, 2))]
        if k == 3:
            rows += [("c-end", "c", None, "finish", "complete", None, None, at(k, 3))]
        if k == 9:
            rows += [("a-end", "a", None, "finish", "failed", None, None, at(k, 59))]
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(folder)


def read(spark, folder):
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)


def test_runs_resume_after_a_kill(spark, tmp_path):
    folder = str(tmp_path / "events")
    event_files(spark, folder)
    whole = {r.run: tuple(r) for r in ingestion.run_once(read(spark, folder), idle="2 hours").collect()}
    plain = {r.run: tuple(r) for r in ingestion.batch_runs(spark.read.schema(EVENTS).parquet(folder)).collect()}
    assert {k: v[2:] for k, v in whole.items()} == {k: v[2:] for k, v in plain.items()}
    assert (whole["a"][1], whole["b"][1], plain["b"][1]) == ("failed", "interrupted", "running")
    path = rates.new_path(spark)
    totals = ingestion.run_totals(read(spark, folder), "2 hours")

    def broken(rows, batch):
        rows.write.mode("overwrite").parquet(f"{path}/table/batch={batch}")
        if batch == 4:
            raise RuntimeError("killed")

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ingestion.ROCKS)
    try:
        stream = totals.writeStream.outputMode("update").foreachBatch(broken).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        with pytest.raises(Exception):  # noqa: B017, PT011
            stream.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    half = {r.run: tuple(r) for r in ingestion.runs(rates.written(spark, path, totals.schema)).collect()}
    assert half["a"][2:] != whole["a"][2:]
    assert {r.run: tuple(r) for r in ingestion.run_once(read(spark, folder), path, idle="2 hours").collect()} == whole
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
