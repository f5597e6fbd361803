"""Customer signal: how much revenue hangs on customers in distress. It never feeds a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaymill.config import MATERIAL_SINGLE, MATERIAL_TOTAL


def with_verdicts(roster: DataFrame, research: DataFrame) -> DataFrame:
    """roster: target_id, name, pct_arr. research: target_id, name, distress. Unmatched: not researched (null)."""
    return roster.join(research.select("target_id", "name", "distress"), ["target_id", "name"], "left")


def severity(total: Column, largest: Column) -> Column:
    return (
        F.when(F.coalesce(total, F.lit(0.0)) <= 0, "none")
        .when((total >= MATERIAL_TOTAL) | (largest >= MATERIAL_SINGLE), "material")
        .otherwise("noted")
    )


def customer_signal(roster: DataFrame) -> DataFrame:
    """roster: target_id, name, pct_arr, distress (null: not researched, neither well nor ill)."""
    return customer_details(roster).drop("largest_pct", "distressed")


def customer_details(roster: DataFrame) -> DataFrame:
    """As :func:`customer_signal`, with distressed, how many they are, and largest_pct, the share of the largest of them."""
    ill = F.col("distress") == F.lit(True)
    share = F.when(ill, F.col("pct_arr"))
    largest = F.max_by("name", F.when(ill, F.struct("pct_arr", "name")))
    rows = roster.groupBy("target_id").agg(
        F.round(F.coalesce(F.sum(share), F.lit(0.0)), 2).alias("distressed_pct"),
        F.round(F.coalesce(F.sum(F.when(F.col("distress").isNotNull(), F.col("pct_arr"))), F.lit(0.0)), 2).alias("researched_pct"),
        F.round(F.sum("pct_arr"), 2).alias("roster_pct"),
        F.count_if(F.col("distress").isNotNull()).alias("researched"),
        F.count_if(F.col("distress").isNull()).alias("unresearched"),
        F.max(share).alias("largest_pct"),
        F.count_if(ill).alias("distressed"),
        F.when(F.count_if(ill) > 0, largest).alias("largest"),
        F.array_join(F.sort_array(F.collect_list(F.when(ill, F.col("name")))), ", ").alias("names"),
    )
    return rows.withColumn("severity", severity(F.col("distressed_pct"), F.col("largest_pct")))


def overlap_floor(rows: DataFrame, key: str, a: Column, b: Column) -> DataFrame:
    """At least how many members the two groups must share: |a| + |b| - |all|, not below 0."""
    counts = rows.agg(
        F.countDistinct(F.when(a, F.col(key))).alias("in_a"),
        F.countDistinct(F.when(b, F.col(key))).alias("in_b"),
        F.countDistinct(key).alias("universe"),
    )
    floor = F.greatest(F.lit(0), F.col("in_a") + F.col("in_b") - F.col("universe")).cast("long")
    return counts.withColumns({"floor": floor, "floor_pct": F.round(100.0 * F.try_divide(floor, F.least("in_a", "in_b")), 1)})


def signal_callouts(signals: DataFrame) -> DataFrame:
    """A question for each target whose signal is not ``none``."""
    question = F.concat(
        F.col("distressed_pct").cast("string"), F.lit("% of revenue is with customers in distress ("), "names", F.lit("): what if they leave?")
    )
    return signals.where("severity <> 'none'").select("target_id", F.lit("customer_health").alias("kind"), question.alias("question"))


def headline(signals: DataFrame) -> DataFrame:
    text = F.concat_ws(
        " ", F.lit("customers in distress hold"), F.concat(F.col("distressed_pct").cast("string"), F.lit("%")),
        F.lit("of revenue;"), F.col("researched").cast("string"), F.lit("researched,"), F.col("unresearched").cast("string"), F.lit("not"),
    )
    return signals.select("target_id", "severity", text.alias("headline"))


def full_headline(details: DataFrame) -> DataFrame:
    """details: as of :func:`customer_details`. How many are in distress and what hangs on them, who is the largest, and
    what nobody looked at."""
    shown = lambda name: F.col(name).cast("string")
    well = F.concat(F.lit("no distress among "), shown("researched"), F.lit(" researched customers with "), shown("researched_pct"), F.lit("% of revenue"))
    ill = F.concat(
        shown("distressed"), F.lit(" of "), shown("researched"), F.lit(" researched customers are in distress and hold "), shown("distressed_pct"),
        F.lit("% of revenue, "), "largest", F.lit(" the most of them with "), shown("largest_pct"), F.lit("%"),
    )
    rest = F.concat(F.lit("; the roster covers "), shown("roster_pct"), F.lit("%, "), shown("unresearched"), F.lit(" of it unresearched"))
    return details.select("target_id", "severity", F.concat(F.when(F.col("distressed") > 0, ill).otherwise(well), rest).alias("headline"))
