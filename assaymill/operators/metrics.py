"""The metric set of each target, derived from facts; wide and long forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaymill.config import METRICS
from assaymill.functions.numbers import percent


def customer_revenue(orders: DataFrame, year: int = 2000) -> DataFrame:
    """Per customer: r1 in ``year``, r0 in the year before, m in the last month; null where nothing was ordered."""
    price = F.col("o_totalprice").cast("decimal(18,2)")
    span = orders.where(F.col("o_orderdate").between(f"{year - 1}-01-01", f"{year}-12-31 23:59:59.999999"))
    in_year = F.year("o_orderdate") == year
    return span.groupBy(F.col("o_custkey").alias("custkey")).agg(
        F.sum(F.when(in_year, price)).alias("r1"),
        F.sum(F.when(~in_year, price)).alias("r0"),
        F.sum(F.when(in_year & (F.month("o_orderdate") == 12), price)).alias("m"),
    )


def target_customers(customer: DataFrame, orders: DataFrame, year: int = 2000) -> DataFrame:
    """Customers with their target (nation and segment) and revenue."""
    target = F.concat(F.col("c_nationkey").cast("string"), F.lit("-"), F.col("c_mktsegment"))
    cells = customer.select(target.alias("target_id"), F.col("c_custkey").alias("custkey"), "c_name", "c_acctbal")
    return cells.join(customer_revenue(orders, year), "custkey", "left")


def largest_customers(rows: DataFrame, k: int = 5) -> DataFrame:
    """rows: as of :func:`target_customers`. The ``k`` with most revenue of each target, with their place. The limit on
    the place lets Spark keep ``k`` rows a target before it shuffles."""
    order = W.partitionBy("target_id").orderBy(F.desc_nulls_last("r1"), "custkey")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def gross_margins(customer: DataFrame, orders: DataFrame, lineitem: DataFrame, year: int = 2000) -> DataFrame:
    ext = F.col("l_extendedprice").cast("decimal(18,2)")
    off = ext * F.col("l_discount").cast("decimal(4,2)")
    sold = orders.where(F.year("o_orderdate") == year).select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("custkey"))
    lines = lineitem.select("l_orderkey", ext.alias("ext"), off.alias("off"))
    target = F.concat(F.col("c_nationkey").cast("string"), F.lit("-"), F.col("c_mktsegment"))
    # Sums per customer first: fewer rows reach the join with customers.
    sums = lines.join(sold, "l_orderkey").groupBy("custkey").agg(F.sum("ext").alias("ext"), F.sum("off").alias("off"))
    cells = customer.select(target.alias("target_id"), F.col("c_custkey").alias("custkey"))
    return sums.join(cells, "custkey").groupBy("target_id").agg(
        F.round(100.0 * (1.0 - F.try_divide(F.sum("off").cast("double"), F.sum("ext").cast("double"))), 4).alias("gross_margin_pct")
    )


def target_metrics(customer: DataFrame, orders: DataFrame, lineitem: DataFrame, year: int = 2000) -> DataFrame:
    """One row a target with the ten metrics; what can't be derived is null, never 0.

    Retention counts only customers with revenue in the year before.
    """
    rows = target_customers(customer, orders, year)
    had = F.col("r0") > 0
    r1, r0 = F.sum("r1"), F.sum("r0")
    kept = F.sum(F.when(had, F.coalesce("r1", F.lit(0))))
    base = F.sum(F.when(had, F.col("r0")))
    wide = rows.groupBy("target_id").agg(
        r1.cast("double").alias("arr_usd"),
        F.sum("m").cast("double").alias("mrr_usd"),
        F.round(percent(F.sum(F.when(had, F.col("r1"))), r1), 4).alias("recurring_pct"),
        F.round(percent(F.sum(F.when(had, F.least(F.coalesce("r1", F.lit(0)), "r0"))), base), 4).alias("grr_pct"),
        F.round(percent(kept, base), 4).alias("nrr_pct"),
        (r1 - r0).cast("double").alias("ebitda_usd"),
        F.round(100.0 * (F.try_divide(r1.cast("double"), r0.cast("double")) - 1.0), 4).alias("yoy_growth_pct"),
        F.round(percent(F.max("r1"), r1), 4).alias("top1_customer_pct"),
        r1.alias("r1"),
    )
    top = largest_customers(rows).groupBy("target_id").agg(F.sum("r1").alias("top5"))
    wide = wide.join(top, "target_id", "left").withColumn("top5_customer_pct", F.round(percent(F.col("top5"), F.col("r1")), 4))
    margins = gross_margins(customer, orders, lineitem, year)
    return wide.join(margins, "target_id", "left").select("target_id", *METRICS)


def to_long(wide: DataFrame) -> DataFrame:
    """target_id, seq, metric, value: one row a metric, nulls kept."""
    stacked = ", ".join(f"{i}, '{m}', {m}" for i, m in enumerate(METRICS))
    return wide.selectExpr("target_id", f"stack({len(METRICS)}, {stacked}) as (seq, metric, value)")


def to_wide(long: DataFrame) -> DataFrame:
    return long.groupBy("target_id").pivot("metric", METRICS).agg(F.first("value", ignorenulls=True))


def stated_conflicts(stated: DataFrame, derived: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Metrics whose stated value is not the derived one: target_id, metric, stated, derived, never resolved here."""
    both = stated.withColumnRenamed("value", "stated").join(derived.withColumnRenamed("value", "derived"), ["target_id", "metric"])
    return both.where(F.abs(F.col("stated") - F.col("derived")) > tolerance).select("target_id", "metric", "stated", "derived")
