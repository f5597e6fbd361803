"""From raw documents to packed training sequences, in stages that each read all the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assaymill.llm import mixing, packing, quality, secrets, simhash
from assaymill.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Near copies: sets of shingles of five words with a Jaccard similarity of 0.8 or more.
COPY_WORDS = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or score low are dropped: null, empty and short ones too. Repeated rows are
    judged alike; an empty table gives no rows."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.quality_rules(docs, labels, carry=tuple(COLUMNS)).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays. A text without a word (null,
    empty, blank) is a copy of any other such; a text of fewer than five words is one shingle."""
    return simhash.keep_one_of_each(docs, COLUMNS, words=COPY_WORDS)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are masked. A null text stays null; an empty table gives no rows."""
    return secrets.redact_documents(docs, COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the shares that their sources weigh: some not at all, some twice, shard by shard. A null source is
    one of its own; rows that repeat are drawn alike; an empty table gives no rows."""
    return mixing.deal_documents(docs, COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with their token ids. A null or empty text is its end id alone; an empty table gives
    no rows."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]

#: The first stages hash words with functions that SQL lacks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = written(docs, f"stage-{k}")
    return docs
