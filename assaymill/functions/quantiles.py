"""Exact quantiles of groups of any size, without holding a group's values in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Equally wide bins of a group's range; values are ordered within the bins that hold a wanted rank only.
BINS = 1024


def grouped_quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float], bins: int = BINS) -> DataFrame:
    """keys, n (values that aren't null) and q, an array with a quantile for each of ``shares``, by linear interpolation
    between the two values around it.

    Values are counted by bins of their group's range; the bins that hold a wanted rank are counted by value.
    Each count is combined before the shuffle. Groups without a value give no row; keys must not be null.
    """
    rows = rows.select(*keys, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    span = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    bin_ = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("low")) / width))).otherwise(0).cast("int")
    binned = rows.join(span, keys).select(*keys, "n", bin_.alias("bin"), "v")
    by_bin = W.partitionBy(*keys).orderBy("bin")
    counts = binned.groupBy(*keys, "n", "bin").agg(F.count("*").alias("c"))
    counts = counts.withColumn("below", F.sum("c").over(by_bin.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("c"))

    def ranks(n: Column) -> Column:
        """For each share the rank of the value before it (from 0), of the one after, and how far between it lies."""
        at = [(n - 1) * F.lit(float(s)) for s in shares]
        return F.array(*[F.struct(F.lit(i).alias("i"), F.floor(a).alias("a"), F.ceil(a).alias("b"), (a - F.floor(a)).alias("part")) for i, a in enumerate(at)])

    wanted = F.exists(ranks(F.col("n")), lambda r: r["a"].between(F.col("below"), F.col("below") + F.col("c") - 1) | r["b"].between(F.col("below"), F.col("below") + F.col("c") - 1))
    near = binned.join(counts.where(wanted).select(*keys, "bin", "below"), [*keys, "bin"])
    values = near.groupBy(*keys, "n", "bin", "below", "v").agg(F.count("*").alias("c"))
    inside = W.partitionBy(*keys, "bin").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)
    values = values.withColumn("first", F.col("below") + F.sum("c").over(inside) - F.col("c"))
    met = values.select(*keys, "n", "v", F.explode(ranks(F.col("n"))).alias("r"), "first", (F.col("first") + F.col("c") - 1).alias("last"))
    holds = lambda rank: rank.between(F.col("first"), F.col("last"))
    met = met.where(holds(F.col("r.a")) | holds(F.col("r.b")))
    low, high = F.max(F.when(holds(F.col("r.a")), F.col("v"))), F.max(F.when(holds(F.col("r.b")), F.col("v")))
    found = met.groupBy(*keys, "n", F.col("r.i").alias("i"), F.col("r.part").alias("part")).agg(low.alias("a"), high.alias("b"))
    found = found.withColumn("q", F.col("a") + (F.col("b") - F.col("a")) * F.col("part"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "q")))
    return found.groupBy(*keys, "n").agg(F.transform(ordered, lambda x: x["q"]).alias("q"))
