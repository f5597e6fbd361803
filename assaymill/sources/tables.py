"""The tables of a scale-factor folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_pages(texts: DataFrame, key: str, text: str) -> DataFrame:
    """One row a page, numbered from 1; pages are parted by blank lines and empty ones are kept."""
    return texts.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n\n")).alias("at", "text")).select(
        key, (F.col("at") + 1).alias("page_number"), "text"
    )


def document_text(pages: DataFrame, key: str) -> DataFrame:
    """Pages put together again in their order, with counts of characters and of empty pages."""
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "text")))
    return pages.groupBy(key).agg(
        F.array_join(F.transform(ordered, lambda p: p["text"]), "\n\n").alias("text"),
        F.sum(F.length("text")).alias("n_chars"),
        F.count_if(F.trim("text") == "").alias("empty_pages"),
    )


def inbox(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """Every file of a folder that fits the pattern, in the order of their names: path, text."""
    files = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", pattern).load(folder)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).orderBy("path")


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document that is an array of records, or one record: ground truth, examples, criteria. Fields that the
    schema doesn't name are left out, and missing ones are null."""
    return spark.read.schema(schema).option("multiLine", True).json(path)
