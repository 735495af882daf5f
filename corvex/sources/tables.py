"""The driver's tables, and the corpus entities derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Document type by source number modulo 8.
TYPES = ("Act", "Constitution", "Supreme Court Judgment", "Court of Appeal Judgment", "Gazette", "Parliament Paper", "Law Report", "Bill")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of the folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """documents as corpus rows: ids, title (first line, 60 characters), type, year and authority."""
    source = F.substring("source", 4, 9).cast("int")
    kind = F.get(F.array(*map(F.lit, TYPES)), source % 8)
    return table(spark, folder, "documents").select(
        "doc_id",
        F.concat(F.lit("doc_"), "doc_id").alias("document_id"),
        F.col("source").alias("source_id"),
        F.col("lang").alias("language"),
        F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 60).alias("title"),
        (1990 + F.col("doc_id") % 35).cast("int").alias("year"),
        kind.alias("document_type"),
        (source % 9 + 1).alias("authority_level"),
        "text",
    )


CORPUS_SQL = """corpus AS (
  SELECT doc_id, 'doc_' || doc_id AS document_id, source AS source_id, lang AS language,
         substr(split_part(text, chr(10), 1), 1, 60) AS title, (1990 + doc_id % 35)::INTEGER AS year,
         ['Act', 'Constitution', 'Supreme Court Judgment', 'Court of Appeal Judgment', 'Gazette', 'Parliament Paper', 'Law Report', 'Bill'][(substr(source, 4)::INTEGER % 8 + 1)::INTEGER] AS document_type,
         (substr(source, 4)::INTEGER % 9 + 1)::INTEGER AS authority_level, text
  FROM documents)"""


def pages(spark: SparkSession, folder: str, lines: int = 6) -> DataFrame:
    """Pages of the corpus: blocks of lines, with a text-layer row for each and an OCR row for every third document."""
    docs = corpus(spark, folder).select("doc_id", "document_id", F.split("text", "\n").alias("l"))
    page = lambda b: F.struct((b + 1).alias("page_number"), F.array_join(F.slice("l", b * lines + 1, lines), "\n").alias("text"))
    # Cut inside the row: no line is exploded or moved.
    blocks = docs.select("doc_id", "document_id", F.inline(F.transform(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / lines).cast("int")), page)))
    layer = blocks.select("*", F.lit("text_layer").alias("extraction_method"), F.lit(None).cast("double").alias("ocr_confidence"))
    ocr = blocks.where("doc_id % 3 = 0").withColumn("text", F.translate("text", "e", "c")).select("*", F.lit("ocr").alias("extraction_method"), (0.6 + (F.col("doc_id") % 40) / 100).alias("ocr_confidence"))
    return layer.unionByName(ocr)
