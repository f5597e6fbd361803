"""Incremental runs over bounded and unbounded inputs, and windows in event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assaymill.streaming.committed import CommittedTable


def successes(reads: DataFrame) -> DataFrame:
    """Only what was read well is stored: ok, and some text."""
    return reads.where(F.col("ok") & (F.trim(F.coalesce("text", F.lit(""))) != ""))


def cache_misses(wanted: DataFrame, cache: DataFrame, *keys: str) -> DataFrame:
    """What isn't stored yet, failures of earlier runs included."""
    return wanted.join(cache.select(*keys), list(keys), "left_anti")


def through_cache(
    spark: SparkSession, wanted: DataFrame, path: str, keys: list[str], read: Callable[[DataFrame], DataFrame], transaction: str | None = None
) -> DataFrame:
    """Reads what the table at ``path`` lacks, stores successes, and returns all that is stored of ``wanted``.

    A key is stored once, however many runs read it at a time or again. transaction: names the run (a batch's number,
    say); one that was stored before reads nothing.
    """
    table = CommittedTable(spark, path)
    commits = table.commits()
    if transaction is None or all(c["transaction"] != transaction for c in commits):
        cache = table.read()
        misses = wanted if cache is None else cache_misses(wanted, cache, *keys)
        table.append(successes(read(misses)), transaction, keys)
    return table.read().join(wanted.select(*keys).distinct(), keys, "left_semi")


def screen_inbox(spark: SparkSession, source: str, schema: str, screen: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Screens what is new in a folder and ends; each file is taken once, however often this runs."""
    stream = spark.readStream.schema(schema).parquet(source)

    def batch(rows: DataFrame, number: int) -> None:
        # A batch that is run again writes its own folder again.
        screen(rows).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_session(records: DataFrame, path: str, transaction: str | None = None) -> bool:
    """Sessions are appended and never rewritten; a session that is there already is not added again, whoever added it.

    records: doc_id, session and the rest; a session may have any number of records. Says whether records were added.
    """
    return CommittedTable(records.sparkSession, path).append(records, transaction, ["doc_id", "session"], unique=False)


def timed(events: DataFrame, late: str | None) -> DataFrame:
    """A stream's events with a watermark on ts, which must be a timestamp with a zone; a batch stays as it is.

    late: None where the events have a watermark already.
    """
    if not events.isStreaming or late is None:
        return events
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, width: str, late: str | None = "1 hour") -> DataFrame:
    """Events and value by window and type. On a stream, rows later than ``late`` are left out."""
    rows = timed(events, late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(
        F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total")
    )
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", F.col("total").cast("double").alias("total"))


def sliding(events: DataFrame, width: str, step: str, late: str | None = "1 hour") -> DataFrame:
    rows = timed(events, late).groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, late: str | None = "1 hour") -> DataFrame:
    """Sessions of each user: events no further apart than ``gap``."""
    rows = timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return rows.select("user_id", F.col("w.start").alias("start"), "last", "n")


def distinct_events(events: DataFrame, late: str | None = "1 hour") -> DataFrame:
    if events.isStreaming:
        return timed(events, late).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])
