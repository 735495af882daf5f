"""File formats of the corpus: manifests, registers, page and chunk lines, indexes, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvex.functions import classify, rules, text as tx

#: Columns of a manifest row, all read as text.
MANIFEST = (
    "document_id", "source_id", "source_document_id", "document_type", "title", "year", "number", "date", "language", "source_url", "download_url",
    "local_path", "file_hash", "acquisition_status", "extraction_status", "ocr_required", "text_quality_score", "legal_status", "missing_reason", "next_action", "last_checked", "notes",
)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, asked of the file system that it belongs to."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_csv_rows(spark: SparkSession, path: str, columns: tuple[str, ...] = MANIFEST) -> DataFrame:
    """A CSV file with a header, all text; a missing file is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
    return spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")


def typed_manifest(rows: DataFrame) -> DataFrame:
    """Manifest rows with numbers, dates and truth values read leniently; empty text is null."""
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    out = rows.select(*[blank(c).alias(c) for c in rows.columns])
    return out.withColumns(
        {
            "year": classify.lenient_int(F.col("year")),
            "date": classify.lenient_date(F.col("date")),
            "ocr_required": classify.lenient_bool(F.col("ocr_required")),
            "text_quality_score": F.col("text_quality_score").try_cast("double"),
            **({"last_checked": rules.lenient_timestamp(F.regexp_replace(F.col("last_checked"), "Z$", "+00:00"))} if "last_checked" in rows.columns else {}),
            "authority_level": classify.authority_level(F.coalesce("document_type", F.lit("")), F.coalesce("source_id", F.lit(""))),
        }
    )


def register(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The last row of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order.desc()))
    return rows.withColumn("_p", place).where("_p = 1").drop("_p")


def read_pages_jsonl(spark: SparkSession, path: str, method: str = "text", confidence: float | None = None) -> DataFrame:
    """Pages of JSON lines; the number is under page or page_number."""
    rows = spark.read.schema("document_id string, page int, page_number int, text string, error string, confidence double").json(path)
    return rows.select("document_id", F.coalesce("page_number", "page").alias("page_number"), tx.normalize_text(F.col("text")).alias("text"), F.lit(method).alias("extraction_method"), F.coalesce("confidence", F.lit(confidence).cast("double")).alias("ocr_confidence"), F.coalesce("error", F.lit("")).alias("error"))


def note_path(notes: Column) -> Column:
    """The path that a row's notes give for its page text."""
    return F.regexp_extract(F.coalesce(notes, F.lit("")), r"(?:ocr_pages_path|pages_path|ocr_text_path|text_path)=([^;]+)", 1)


def pages_path(manifest: DataFrame, ocr: DataFrame) -> DataFrame:
    """document_id and the path of its pages: the OCR register's if OCR is complete, else the notes'."""
    joined = manifest.join(ocr.select("document_id", "ocr_status", "ocr_pages_path"), "document_id", "left")
    done = F.coalesce(F.col("ocr_status").startswith("ocr_completed"), F.lit(False)) & (F.coalesce("ocr_pages_path", F.lit("")) != "")
    return joined.select("document_id", F.when(done, F.col("ocr_pages_path")).otherwise(note_path(F.col("notes"))).alias("pages_path"), F.when(done, "ocr").otherwise("text").alias("extraction_method"))


def ocr_lines(words: DataFrame) -> DataFrame:
    """Lines of an OCR word table (page, block, par, line, word, conf, text), with the mean of confidences from 0 on."""
    parts = words.where(F.trim("text") != "").groupBy("page", "block", "par", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda x: x["text"]), " ").alias("line_text"), F.avg(F.when(F.col("conf") >= 0, F.col("conf"))).alias("confidence"), F.count("*").alias("n_words"))
    return parts.withColumn("band", tx.ocr_band(F.col("confidence")))


def write_jsonl(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    rows.write.mode("overwrite").json(path)


def write_index(index: DataFrame, path: str, buckets: int = 64) -> None:
    """An inverted index, clustered by term so that a query reads few row groups."""
    index.repartition(buckets, "term").sortWithinPartitions("term").write.mode("overwrite").parquet(path)


def prometheus(metrics: DataFrame) -> DataFrame:
    """Lines of the text exposition format of (name, labels map, value), in order."""
    escape = lambda v: F.regexp_replace(F.regexp_replace(F.regexp_replace(v, r"\\", r"\\\\"), "\n", r"\\n"), '"', r'\\"')
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), escape(e["value"]), F.lit('"')))
    line = F.concat("name", F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(""), F.lit(" "), F.col("value").cast("string"))
    return metrics.select(line.alias("line"))
