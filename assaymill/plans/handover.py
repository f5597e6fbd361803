"""Queries over what readers hand over, and rendered texts; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaymill.config import CELLS
from assaymill.operators import contracts, fit, render, rules
from assaymill.plans.evidence import PAGES_SQL, composed_pages
from assaymill.plans.screening import FIT_SQL, wide_metrics
from assaymill.sources.tables import table


def _reads(spark, sf_dir):
    """Events stand in for page reads: type as backend, value as seconds."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("pipeline-"), "event_type").alias("backend"), F.when(F.col("event_id") % 3 == 0, "table").otherwise("chart").alias("carrier"),
        (F.col("event_id") % 2 == 0).alias("labelled"), (F.col("event_id") % 5 != 0).alias("attributed"), F.col("value").cast("decimal(18,4)").alias("seconds"),
    )


def axis_read_rate(spark, sf_dir):
    return contracts.axis_read_rate(_reads(spark, sf_dir), "pipeline-p")


def chart_split(spark, sf_dir):
    return contracts.chart_split(_reads(spark, sf_dir))


def reader_seconds(spark, sf_dir):
    rows = contracts.reader_seconds(_reads(spark, sf_dir))
    return rows.select("backend", "pages", F.col("seconds").cast("double").alias("seconds"), F.col("per_page").cast("double").alias("per_page"))


def exhibit_pages(spark, sf_dir):
    """Composed pages announce retention and the largest customer; every fourth was read."""
    pages = composed_pages(spark, sf_dir).select(F.col("page_id").alias("doc_id"), F.lit(3).alias("page_number"), "text")
    missing = pages.select("doc_id", F.explode(F.array(F.lit("grr_pct"), F.lit("top5_customer_pct"), F.lit("top1_customer_pct"))).alias("metric"))
    found = contracts.exhibit_pages(missing, pages, pages.where("doc_id % 4 = 0"))
    return found.select("doc_id", "metric", F.col("page").cast("long").alias("page"))


def label_or_axis(spark, sf_dir):
    """Line items stand in for chart reads: quantity as label, discount-shifted quantity as axis."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    label = F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity"))
    axis = F.when(F.col("l_orderkey") % 5 != 0, F.round(F.col("l_quantity") + 10 * F.col("l_discount"), 2))
    shipped = contracts.ship_label_or_axis(l.select(F.struct("l_orderkey", "l_linenumber").alias("img"), label.alias("label_value"), axis.alias("axis_value")))
    return shipped.groupBy("read", "flagged").agg(F.count("*").alias("n"), F.round(F.sum("value"), 1).alias("total"))


def cache_keys(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    key = contracts.cache_key(F.col("c_name"), F.col("c_custkey"), F.lit("reader:1 b"), F.lit(120))
    return c.select("c_custkey", key.alias("key"))


def scorecard_heads(spark, sf_dir):
    """The first two lines of every scorecard."""
    wide = wide_metrics(spark, sf_dir)
    cards = render.scorecards(wide, fit.fit(wide, CELLS), rules.verdicts(wide, CELLS), rules.findings(wide, CELLS))
    return cards.select("target_id", F.substring_index("text", "\n", 2).alias("head"))


QUERIES = {f.__name__: f for f in (axis_read_rate, chart_split, reader_seconds, exhibit_pages, label_or_axis, cache_keys, scorecard_heads)}

_READS = "reads as (select 'pipeline-' || event_type as backend, case when event_id % 3 = 0 then 'table' else 'chart' end as carrier, event_id % 2 = 0 as labelled, event_id % 5 <> 0 as attributed, cast(value as decimal(18,4)) as seconds from events)"
SQL = {
    "axis_read_rate": f"with {_READS} select count(*) as n, round(100.0::double * avg(attributed::int), 0) as pct from reads where carrier = 'chart' and not labelled and backend like 'pipeline-p%'",
    "chart_split": f"with {_READS} select backend, case when labelled then 'labels' else 'axis' end as kind, count(*) as n, count(*) filter (attributed) as attributed from reads where carrier = 'chart' group by 1, 2",
    "reader_seconds": f"with {_READS} select backend, count(*) as pages, cast(round(sum(seconds), 1) as double) as seconds, round(cast(sum(seconds) as double) / count(*), 1) as per_page from reads group by 1",
    "exhibit_pages": f"""with {PAGES_SQL}, m(metric, hint) as (values ('grr_pct', 'gross\\s+retention|gross\\s+revenue\\s+retention'), ('top1_customer_pct', 'largest\\s+customer|top\\s+customer'), ('top5_customer_pct', 'top\\s+(five|5)\\s+customers'))
        select page_id as doc_id, metric, 3::bigint as page from pages_, m where regexp_matches(text, '(?i)' || hint) and (page_id % 4 = 0 or regexp_matches(text, '(?i)chart|graph|figure|exhibit|axis'))""",
    "label_or_axis": """with r as (select case when l_orderkey % 7 <> 0 then l_quantity end as a, case when l_orderkey % 5 <> 0 then round(l_quantity + 10 * l_discount, 2) end as b from lineitem),
        s as (select case when a is not null and b is not null and abs(a - b) <= 0.5 then 'label' when b is not null then 'axis' when a is not null then 'label' end as read,
          coalesce(a is not null and b is not null and abs(a - b) > 0.5, false) as flagged, a, b from r)
        select read, flagged, count(*) as n, round(sum(case read when 'label' then a when 'axis' then b end), 1) as total from s group by 1, 2""",
    "cache_keys": "select c_custkey, translate(c_name, ':/ ', '--_') || case when c_custkey < 10 then '__p0' else '__p' end || cast(c_custkey as varchar) || '__reader-1_b__dpi120' as key from customer",
    "scorecard_heads": f"""with {FIT_SQL} select target_id, '# ' || target_id || chr(10) || 'Score ' || regexp_replace(cast(cast(score as decimal(10,1)) as varchar), '\\.0$', '') || ' ' || tier as head from fit""",
}
