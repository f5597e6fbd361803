"""Invented past acquisitions and target profiles, the same in every run and in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERTICALS = ["healthcare", "logistics", "education", "construction", "finance"]


def uniform(seed: str, key: Column, name: str) -> Column:
    """A number from 0 to below 1, from 32 bits of an md5 of seed, key and name."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), key.cast("string"), F.lit(name)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def dealbook(spark: SparkSession, n: int, seed: str = "book-1") -> DataFrame:
    """``n`` past acquisitions, numbered from 1. See :func:`records`."""
    return records(spark.range(n).withColumnRenamed("id", "i"), n, seed)


def records(rows: DataFrame, n: int, seed: str = "book-1") -> DataFrame:
    """A past acquisition for each of ``rows`` (i, below ``n``): what holds revenue lifts the outcome, concentration
    lowers it, and expectations at the time lay above it, the more the faster the target grew."""
    u = lambda name: uniform(seed, F.col("i"), name)
    rows = rows.select(
        "i", F.get(F.array(*map(F.lit, VERTICALS)), F.floor(u("vertical") * len(VERTICALS)).cast("int")).alias("vertical"),
        F.round(1.5 + 26.5 * u("arr"), 2).alias("arr_m"), F.round(76 + 24 * u("grr"), 1).alias("grr"),
        F.round(65 + 34 * u("recurring"), 1).alias("recurring"), F.round(2 + 40 * u("top1"), 1).alias("top1"),
        F.round(24 * u("growth") - 3, 1).alias("growth"), u("luck").alias("luck"), u("hope").alias("hope"),
    )
    outcome = (
        0.4 * (F.col("grr") - 88) + 0.2 * (F.col("recurring") - 85) - 0.1 * F.greatest(F.lit(0.0), F.col("top1") - 15)
        + 0.1 * F.col("growth") + 8 * (F.col("luck") - 0.5) + 4
    )
    rows = rows.withColumn("outcome", F.round(outcome, 2))
    expected = F.round(F.col("outcome") + 6 * F.col("hope") - 0.5 + 0.1 * F.greatest(F.lit(0.0), F.col("growth")), 2)
    return rows.select(
        F.format_string("D%03d", F.col("i") + 1).alias("deal_id"), (2016 + F.floor(F.col("i") * 10 / n)).cast("long").alias("acquired"),
        "vertical", (F.col("arr_m") * 1e6).alias("arr"), "grr", "recurring", "top1", "growth", expected.alias("underwritten"), "outcome",
    )


def profiles(book: DataFrame, carriers: dict[str, str]) -> DataFrame:
    """Facts of invented targets made of past records: target_id, metric, value, carrier (prose, table or chart)."""
    facts = [("arr_usd", "arr"), ("grr_pct", "grr"), ("recurring_pct", "recurring"), ("top1_customer_pct", "top1"), ("yoy_growth_pct", "growth")]
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).alias("value"), F.lit(carriers.get(m, "prose")).alias("carrier")) for m, c in facts])
    return book.select(F.concat(F.lit("T"), F.substring("deal_id", 2, 9)).alias("target_id"), F.inline(rows))
