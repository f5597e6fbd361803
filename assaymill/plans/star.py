"""Queries over the star-schema tables themselves: joins, aggregates, windows and set operations at their widest."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaymill.sources.tables import table


def pricing_summary(spark, sf_dir):
    """Sums of line items by flag and status."""
    l = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")  # noqa: E741
    price, off = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_discount").cast("decimal(4,2)")
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("sum_qty"),
        F.sum(price).cast("double").alias("sum_base_price"),
        F.sum(price * (1 - off)).cast("double").alias("sum_disc_price"),
        F.round(F.avg(price.cast("double")), 2).alias("avg_price"),
        F.count("*").alias("n"),
    )


def region_revenue(spark, sf_dir):
    """Discounted revenue of local suppliers by nation: customer and supplier of the same nation."""
    c, o, l = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    value = F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    lines = l.select("l_orderkey", "l_suppkey", value.alias("value"))
    orders = o.where(F.year("o_orderdate") == 1997).select("o_orderkey", "o_custkey")
    joined = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(s.select("s_suppkey", "s_nationkey"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    )
    sums = joined.groupBy("s_nationkey").agg(F.sum("value").alias("revenue"))
    named = sums.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return named.select("r_name", "n_name", F.col("revenue").cast("double").alias("revenue"))


def top_parts_by_brand(spark, sf_dir):
    """The three best-selling parts of each brand."""
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    sold = l.groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("qty"))
    rows = sold.join(p.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    w = W.partitionBy("p_brand").orderBy(F.desc("qty"), "l_partkey")
    top = rows.withColumn("place", F.row_number().over(w)).where("place <= 3")
    return top.select("p_brand", F.col("l_partkey").alias("partkey"), F.col("qty").cast("double").alias("qty"), "place")


def customers_without_urgent_orders(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_orderpriority like '1%'")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def segment_cube(spark, sf_dir):
    """Balances by region and segment, with totals over each and over all."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    cube = rows.cube("n_regionkey", "c_mktsegment").agg(F.count("*").alias("n"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("balance"))
    return cube.select(F.coalesce(F.col("n_regionkey").cast("string"), F.lit("all")).alias("region"), F.coalesce("c_mktsegment", F.lit("all")).alias("segment"), "n", "balance")


def running_balance(spark, sf_dir):
    """Each customer's orders with the running total and the change from the one before."""
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    price = F.col("o_totalprice").cast("decimal(18,2)")
    return table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey",
        F.sum(price).over(w.rowsBetween(W.unboundedPreceding, 0)).cast("double").alias("running"),
        (price - F.lag(price).over(w)).cast("double").alias("change"),
    )


QUERIES = {f.__name__: f for f in (pricing_summary, region_revenue, top_parts_by_brand, customers_without_urgent_orders, segment_cube, running_balance)}

SQL = {
    "pricing_summary": """select l_returnflag, l_linestatus, cast(sum(cast(l_quantity as decimal(18,2))) as double) as sum_qty, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as sum_base_price,
        cast(sum(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(4,2)))) as double) as sum_disc_price, round(avg(cast(cast(l_extendedprice as decimal(18,2)) as double)), 2) as avg_price, count(*) as n
        from lineitem where l_shipdate <= timestamp '1998-09-02 00:00:00' group by 1, 2""",
    "region_revenue": """select r_name, n_name, cast(sum(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(4,2)))) as double) as revenue
        from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey and c_nationkey = s_nationkey
        join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where year(o_orderdate) = 1997 group by 1, 2""",
    "top_parts_by_brand": """with s as (select l_partkey, sum(cast(l_quantity as decimal(18,2))) as qty from lineitem group by 1)
        select p_brand, l_partkey as partkey, cast(qty as double) as qty, row_number() over (partition by p_brand order by qty desc, l_partkey) as place from s join part on l_partkey = p_partkey qualify place <= 3""",
    "customers_without_urgent_orders": "select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderpriority like '1%')",
    "segment_cube": """select coalesce(cast(n_regionkey as varchar), 'all') as region, coalesce(c_mktsegment, 'all') as segment, count(*) as n, cast(sum(cast(c_acctbal as decimal(18,2))) as double) as balance
        from customer join nation on c_nationkey = n_nationkey group by cube (n_regionkey, c_mktsegment)""",
    "running_balance": """select o_custkey, o_orderkey, cast(sum(cast(o_totalprice as decimal(18,2))) over w as double) as running, cast(cast(o_totalprice as decimal(18,2)) - lag(cast(o_totalprice as decimal(18,2))) over w2 as double) as change
        from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding), w2 as (partition by o_custkey order by o_orderdate, o_orderkey)""",
}
