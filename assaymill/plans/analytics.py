"""Queries over cohorts, signals, routing, series, geometry, feedback and event time; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaymill.operators import asof, cells, chart, cohort, feedback, route, series, signal
from assaymill.operators import metrics as M
from assaymill.plans.screening import METRICS_SQL
from assaymill.sources.tables import table
from assaymill.streaming import incremental

# Bands that split the cells of the star schema; retention as for companies would put all in one band.
SIZES = [("small", 3_000_000.0), ("lower", 4_500_000.0), ("mid", 6_000_000.0), ("large", None)]
RETENTION = [("weak", 40.0), ("solid", 60.0), ("strong", None)]


def seconds(name: str):
    """Whole seconds since 1970 of a timestamp without a zone."""
    return F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col(name))


def cell_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of each cell by year: target_id, segment, y1996, y1997, y2000."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("y"), F.col("o_totalprice").cast("decimal(18,2)").alias("v")
    ).where("y in (1996, 1997, 2000)")
    sums = orders.groupBy("c_custkey").agg(*[F.sum(F.when(F.col("y") == y, F.col("v"))).alias(f"y{y}") for y in (1996, 1997, 2000)])
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    target = F.concat(F.col("c_nationkey").cast("string"), F.lit("-"), F.col("c_mktsegment"))
    return customer.join(sums, "c_custkey").groupBy(target.alias("target_id"), F.col("c_mktsegment").alias("segment")).agg(
        *[F.sum(f"y{y}").cast("double").alias(f"y{y}") for y in (1996, 1997, 2000)]
    )


def book(spark, sf_dir):
    """Past records: cells as bought in 1997, what growth was expected then and what came by 2000."""
    years = cell_years(spark, sf_dir).where("y1996 > 0 and y1997 > 0 and y2000 > 0")
    growth = F.round(100.0 * (F.col("y1997") / F.col("y1996") - 1.0), 4)
    came = F.round(100.0 * (F.pow(F.col("y2000") / F.col("y1997"), 1.0 / 3.0) - 1.0), 4)
    grr = F.round(F.least(100.0 * F.col("y1997") / F.col("y1996"), F.lit(100.0)) * 0.6, 4)
    return years.select(F.col("target_id").alias("deal_id"), F.col("segment").alias("vertical"), F.col("y1997").alias("arr"), grr.alias("grr"), growth.alias("underwritten"), came.alias("outcome"))


def _targets(spark, sf_dir):
    wide = M.target_metrics(*(table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem")))
    return wide.select("target_id", F.substring_index("target_id", "-", -1).alias("vertical"), F.col("arr_usd").alias("arr"), F.col("grr_pct").alias("grr"))


def base_rate_cohort(spark, sf_dir):
    return cohort.base_rates(_targets(spark, sf_dir), book(spark, sf_dir), SIZES, RETENTION)


def underwriting_bias(spark, sf_dir):
    return cohort.underwriting_bias(book(spark, sf_dir), "vertical")


def cohort_records(spark, sf_dir):
    return book(spark, sf_dir)


def published_bands(spark, sf_dir):
    """Retention of each target against bands that two publishers give for some verticals."""
    values = _targets(spark, sf_dir).select("target_id", "vertical", cohort.band(F.col("arr"), SIZES).alias("size"), F.lit("grr_pct").alias("metric"), F.col("grr").alias("value"))
    rows = [("grr_pct", v, s, lo, hi, p) for v, s, lo, hi, p in (("BUILDING", "lower", 40.0, 60.0, "a"), ("BUILDING", "lower", 30.0, 50.0, "b"), ("MACHINERY", "mid", 45.0, 55.0, "a"))]
    return cohort.published_bands(values, spark.createDataFrame(rows, "metric string, vertical string, size string, low double, high double, publisher string"))


def _roster(spark, sf_dir):
    """The five largest customers of each target; distress: a negative balance, known for those who ordered in 2001."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    rows = M.target_customers(customer, orders).where("r1 is not null")
    totals = rows.groupBy("target_id").agg(F.sum("r1").alias("total"))
    share = F.round(100.0 * F.try_divide(F.col("r1").cast("double"), F.col("total").cast("double")), 2)
    rows = M.largest_customers(rows).join(totals, "target_id").withColumn("pct_arr", share)
    active = orders.where(F.year("o_orderdate") == 2001).select(F.col("o_custkey").alias("custkey")).distinct().withColumn("active", F.lit(True))
    found = rows.join(active, "custkey", "left")
    return found.select("target_id", F.col("c_name").alias("name"), "pct_arr", F.when(F.col("active"), F.col("c_acctbal") < 0).alias("distress"))


def customer_signal(spark, sf_dir):
    return signal.customer_signal(_roster(spark, sf_dir))


def signal_callouts(spark, sf_dir):
    rows = signal.signal_callouts(signal.customer_signal(_roster(spark, sf_dir)))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.contains("question", F.lit("%"))).alias("with_share"))


def distress_overlap_floor(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return signal.overlap_floor(c, "c_custkey", F.col("c_acctbal") < 5000, F.col("c_mktsegment") != "BUILDING")


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("page_id"), "embedding")


def _ranked(spark, sf_dir, k=4):
    queries, pages = _vectors(spark, sf_dir)
    return cells.nearest(queries, cells.CellIndex(pages), k, but_itself=True)


def route_topk(spark, sf_dir):
    return _ranked(spark, sf_dir, 3).select("query_id", "page_id", F.round("score", 4).alias("score"), "rank")


def route_recall(spark, sf_dir):
    """Place of the first page with the query's label, by label and over all."""
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    found = _ranked(spark, sf_dir, 4).join(labels.select(F.col("vec_id").alias("page_id"), F.col("label").alias("page_label")), "page_id")
    mine = labels.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label")
    first = mine.join(found, "query_id", "left").groupBy("query_id", "label").agg(F.min(F.when(F.col("label") == F.col("page_label"), F.col("rank"))).alias("rank"))
    return route.recall(first.select("query_id", F.col("label").cast("string").alias("carrier"), "rank"))


def route_pages_saved(spark, sf_dir):
    total = table(spark, sf_dir, "embeddings").count()
    return route.pages_saved(_ranked(spark, sf_dir, 3), total)


def monthly(spark, sf_dir):
    """Five years of monthly revenue of each segment: series_id, t, value."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    orders = table(spark, sf_dir, "orders").where(F.year("o_orderdate").between(1995, 1999))
    t = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1
    rows = orders.select(F.col("o_custkey").alias("c_custkey"), t.alias("t"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    return rows.join(customer, "c_custkey").groupBy(F.col("c_mktsegment").alias("series_id"), "t").agg(F.sum("v").cast("double").alias("value"))


def forecast_baselines(spark, sf_dir):
    return series.forecasts(monthly(spark, sf_dir), 12).withColumn("forecast", F.round("forecast", 2))


def forecast_scores(spark, sf_dir):
    return series.mean_scores(series.scores(monthly(spark, sf_dir), 12))


def forecast_audit(spark, sf_dir):
    rows = monthly(spark, sf_dir)
    model = series.forecasts(rows, 12, methods={"drift": series.FORECASTS["drift"]}).select("series_id", "step", "forecast")
    return series.audit(rows, model, 12).select("series_id", "step", *[F.round(c, 2).alias(c) for c in ("naive", "model", "difference", "actual")])


def history_sweep(spark, sf_dir):
    return series.history_sweep(monthly(spark, sf_dir), [4, 8, 12, 24], 4)


def cohort_covariate(spark, sf_dir):
    return series.cohort_covariates(monthly(spark, sf_dir)).select("series_id", "t_from_end", F.round("others", 4).alias("others"), F.round("z", 4).alias("z"))


def quarter_facts(spark, sf_dir):
    """Spans between a customer's orders that are a quarter long, the first of each."""
    orders = table(spark, sf_dir, "orders")
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = orders.select(
        F.col("o_custkey").alias("entity"), F.to_date(F.lag("o_orderdate").over(w)).alias("start"), F.to_date("o_orderdate").alias("end"),
        F.col("o_totalprice").alias("value"), F.col("o_orderpriority").alias("accession"), F.col("o_orderkey").alias("seq"),
    )
    return series.quarter_facts(rows).select("entity", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), "value", "days")


def tag_fallback(spark, sf_dir):
    """Per customer the facts of the first order priority with eight of them."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity"), F.substring("o_orderpriority", 1, 1).cast("int").alias("tag_priority"), "o_orderkey")
    kept = series.first_long_enough(orders.where("tag_priority is not null"), 4)
    return kept.groupBy("entity", "tag_priority").agg(F.count("*").alias("n"))


def asof_anchor(spark, sf_dir):
    """Each event with the last purchase of its user at or before it."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("anchor"))
    return asof.last_known(e, ["user_id"], ["ts", "event_id"], "anchor", "above").select("event_id", "above")


def asof_asked(spark, sf_dir):
    """Each turn of an assistant with the length of the last question before it, and how many turns ago that was."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.struct("turn", F.length("text").alias("n_chars")).alias("question"))
    said = t.where("role = 'assistant'").select("conv_id", "turn")
    found = asof.asof_join(said, t.where("role = 'user'"), ["conv_id"], ["turn"], "question", "asked")
    return found.select("conv_id", "turn", F.col("asked.n_chars").cast("long").alias("asked_chars"), (F.col("turn") - F.col("asked.turn")).alias("turns_ago"))


def nearest_events(spark, sf_dir):
    """Up to three views of the same user within two hours of each purchase, nearest first."""
    e = table(spark, sf_dir, "events").withColumn("s", seconds("ts"))
    p = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), F.col("s").alias("ps"))
    v = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("seen"), F.col("s").alias("vs"))
    # Both sides are cut into two-hour bins: a purchase meets the views of three bins, not all of its user's.
    width = 7200
    p = p.withColumn("bin", F.explode(F.array(*[F.floor(F.col("ps") / width) + d for d in (-1, 0, 1)])))
    v = v.withColumn("bin", F.floor(F.col("vs") / width))
    near = p.join(v, ["user_id", "bin"]).withColumn("far", F.abs(F.col("ps") - F.col("vs"))).where(F.col("far") <= width)
    w = W.partitionBy("purchase").orderBy("far", "seen")
    return near.withColumn("place", F.row_number().over(w)).where("place <= 3").select("purchase", "seen", "far", "place")


def gap_islands(spark, sf_dir):
    """Runs of a user's events no more than six hours apart."""
    e = table(spark, sf_dir, "events").select("user_id", seconds("ts").alias("s"))
    rows = chart.islands(e, ["user_id"], "s", 6 * 3600)
    return rows.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("s").alias("first"), F.max("s").alias("last"))


def _ladder(spark, sf_dir):
    """Ticks at 0, 10 ... 100 on lines 1000 to 0, and points at each customer's balance modulo 1200."""
    c = table(spark, sf_dir, "customer")
    points = c.select(F.lit(1).alias("img"), F.col("c_custkey").alias("series"), F.pmod("c_custkey", F.lit(1200)).cast("double").alias("py"))
    lines = spark.range(11).select(F.lit(1).alias("img"), F.col("id").cast("int").alias("k"))
    lines = lines.select("img", (F.col("k") + 1).alias("line"), (100.0 * F.col("k")).alias("y"))
    ticks = spark.range(11).select(F.lit(1).alias("img"), (10.0 * F.col("id")).alias("value"))
    return points, chart.ticked(lines, ticks)


def interval_interpolate(spark, sf_dir):
    points, marks = _ladder(spark, sf_dir)
    return chart.interpolate(points, marks).select("series", "value")


def line_fit_trimmed(spark, sf_dir):
    """Order totals by the day of the year, for each priority."""
    o = table(spark, sf_dir, "orders")
    points = o.select(F.col("o_orderpriority").alias("priority"), F.dayofyear("o_orderdate").cast("double").alias("x"), F.col("o_totalprice").alias("y"))
    return chart.trimmed_fit(points, "priority").select("priority", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"))


def _pixels(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select((k % 3).alias("img"), F.floor(k / 60).cast("int").alias("y"), (k % 60).cast("int").alias("x"), (k * 7 % 256).cast("int").alias("r"), (k * 13 % 256).cast("int").alias("g"), (k * 29 % 256).cast("int").alias("b"))


def colour_bins(spark, sf_dir):
    return chart.largest_colours(chart.colour_bins(_pixels(spark, sf_dir)), 4).select("img", "r_bin", "g_bin", "b_bin", "pixels", "r", "g", "b", "place")






def changed_texts(spark, sf_dir):
    """Conversation turns whose stored text isn't the one made anew: every seventh was altered, one side lacks some."""
    t = table(spark, sf_dir, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("k"), "conv_id", "text")
    t = t.groupBy("k").agg(F.min("conv_id").alias("conv_id"), F.min("text").alias("text"))
    stored = t.where("conv_id % 11 <> 0").select("k", "text")
    made = t.select("k", F.when(F.col("conv_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return feedback.changed(stored, made, "k", "text")


def _memos(spark, sf_dir):
    """A memo for each customer and its edited form, by the key modulo 6: as it is, a number changed, a line struck, two
    put in, one replaced by two, a plain line struck. Two call-outs stand in each."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    key = k.cast("string")
    anchor = lambda kind: F.concat(F.lit(" <!--co-"), key, F.lit(f"-{kind}-001-->"))
    head, rate, name = F.concat(F.lit("# Memo  "), key), F.concat(F.lit("Retention is "), F.pmod(k, F.lit(97)).cast("string"), F.lit("%")), F.concat(F.lit("Name "), "c_name")
    view, end = F.concat(F.lit("The founder holds "), "c_mktsegment"), F.concat(F.lit("End of "), key)
    case = k % 6
    draft = F.concat_ws("\n", head, F.concat(rate, anchor("axis_read")), name, F.concat(view, anchor("judgement")), end)
    edited = F.concat_ws(
        "\n", head, F.when(case == 1, F.concat(F.lit("Retention is "), (F.pmod(k, F.lit(97)) + 1).cast("string"), F.lit("%"))).otherwise(rate),
        F.when(case != 5, name), F.when(case == 3, F.concat(F.lit("A new  line of "), key)), F.when(case == 3, F.lit("and more")),
        F.when(case == 4, F.concat(F.lit("A board holds "), "c_mktsegment")).when(case != 2, view), F.when(case == 4, F.lit("since last year")), end,
    )
    pairs = c.select(key.alias("doc_id"), draft.alias("draft"), edited.alias("edited"))
    kinds = F.array(F.struct(F.lit("axis_read").alias("kind"), F.lit("grr_pct").alias("metric")), F.struct(F.lit("judgement").alias("kind"), F.lit(None).cast("string").alias("metric")))
    callouts = c.select(key.alias("doc_id"), F.inline(kinds)).withColumn("id", F.concat(F.lit("co-"), "doc_id", F.lit("-"), "kind", F.lit("-001")))
    return pairs, callouts


def memo_diff(spark, sf_dir):
    """Correction records of edited memos."""
    pairs, callouts = _memos(spark, sf_dir)
    return feedback.attributed_edits(feedback.diff_memos(pairs), callouts).select("doc_id", "idx", "callout_id", "blind_spot", "before", "after", "field", "kind", "reason")


def correction_sessions(spark, sf_dir):
    """Records by document and session; every fourth customer's memo was reviewed before."""
    pairs, callouts = _memos(spark, sf_dir)
    before = table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").cast("string").alias("doc_id"), (F.col("c_custkey") % 3 + 1).alias("session"))
    records = feedback.corrections(feedback.diff_memos(pairs), callouts, before)
    sessions = records.select("doc_id", F.col("session").cast("long").alias("session")).distinct()
    return feedback.correction_counts(records).join(sessions, "doc_id")


def event_windows(spark, sf_dir):
    rows = incremental.tumbling(incremental.distinct_events(table(spark, sf_dir, "events")), "1 day")
    return rows.select(seconds("start").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def event_sliding(spark, sf_dir):
    return incremental.sliding(table(spark, sf_dir, "events"), "2 days", "1 day").select(seconds("start").alias("start"), "n")


def event_sessions(spark, sf_dir):
    rows = incremental.sessions(table(spark, sf_dir, "events"), "6 hours")
    return rows.select("user_id", seconds("start").alias("start"), seconds("last").alias("last"), "n")


QUERIES = {
    f.__name__: f
    for f in (
        base_rate_cohort, underwriting_bias, cohort_records, published_bands, customer_signal, signal_callouts, distress_overlap_floor,
        route_topk, route_recall, route_pages_saved, forecast_baselines, forecast_scores, forecast_audit, history_sweep, cohort_covariate,
        quarter_facts, tag_fallback, asof_anchor, asof_asked, nearest_events, gap_islands, interval_interpolate, line_fit_trimmed, colour_bins,
        changed_texts, memo_diff, correction_sessions,
        event_windows, event_sliding, event_sessions,
    )
}


def _band_sql(value, bands):
    return f"case when {value} is null then null " + " ".join(f"when {value} < {b} then '{n}'" for n, b in bands[:-1]) + f" else '{bands[-1][0]}' end"


_YEARS = """years as (
  select cast(c_nationkey as varchar) || '-' || c_mktsegment as target_id, c_mktsegment as segment,
    cast(sum(case when year(o_orderdate) = 1996 then cast(o_totalprice as decimal(18,2)) end) as double) as y1996,
    cast(sum(case when year(o_orderdate) = 1997 then cast(o_totalprice as decimal(18,2)) end) as double) as y1997,
    cast(sum(case when year(o_orderdate) = 2000 then cast(o_totalprice as decimal(18,2)) end) as double) as y2000
  from customer join orders on o_custkey = c_custkey group by 1, 2
), book as (
  select target_id as deal_id, segment as vertical, y1997 as arr, round(least(100.0::double * y1997 / y1996, 100.0::double) * 0.6::double, 4) as grr,
    round(100.0::double * (y1997 / y1996 - 1.0::double), 4) as underwritten,
    round(100.0::double * (pow(y2000 / y1997, 1.0::double / 3.0::double) - 1.0::double), 4) as outcome
  from years where y1996 > 0 and y1997 > 0 and y2000 > 0
)"""
_TARGETS = f"targets as (select target_id, split_part(target_id, '-', 2) as vertical, arr_usd as arr, grr_pct as grr, {_band_sql('arr_usd', SIZES)} as size, {_band_sql('grr_pct', RETENTION)} as retention from wide)"
_STATS = """count(*) as n, round(quantile_cont(outcome, 0.1), 2) as p10, round(quantile_cont(outcome, 0.5), 2) as median, round(quantile_cont(outcome, 0.9), 2) as p90,
  round(100.0::double * avg((outcome < 0)::int), 1) as shrank_pct, round(100.0::double * avg((underwritten > outcome)::int), 1) as optimistic_pct, string_agg(deal_id, ',' order by deal_id) as deal_ids"""
_ROSTER = """pct as (select target_id, c_name as name, custkey, c_acctbal, place, round(100.0::double * (cast(r1 as double) / cast(sum(r1) over (partition by target_id) as double)), 2) as pct_arr from cells where r1 is not null),
roster as (select target_id, name, pct_arr, case when custkey in (select o_custkey from orders where year(o_orderdate) = 2001) then c_acctbal < 0 end as distress from pct where place <= 5),
signals as (select target_id, round(coalesce(sum(case when distress then pct_arr end), 0.0), 2) as distressed_pct, round(coalesce(sum(case when distress is not null then pct_arr end), 0.0), 2) as researched_pct,
  round(sum(pct_arr), 2) as roster_pct, count(*) filter (distress is not null) as researched, count(*) filter (distress is null) as unresearched, max(case when distress then pct_arr end) as top,
  arg_max(name, (pct_arr, name)) filter (distress) as largest, coalesce(string_agg(name, ', ' order by name) filter (distress), '') as names from roster group by 1)"""
_SEVERITY = "case when distressed_pct <= 0 then 'none' when distressed_pct >= 15.0 or top >= 10.0 then 'material' else 'noted' end"
_DOT = "list_dot_product(cast(a.embedding as double[]), cast(b.embedding as double[])) / (sqrt(list_dot_product(cast(a.embedding as double[]), cast(a.embedding as double[]))) * sqrt(list_dot_product(cast(b.embedding as double[]), cast(b.embedding as double[]))))"
_ROUTE = f"""scores as (select a.vec_id as query_id, a.label, b.vec_id as page_id, b.label as page_label, round({_DOT}, 6) as score from embeddings a, embeddings b where a.vec_id % 20 = 0 and a.vec_id <> b.vec_id),
ranked as (select *, row_number() over (partition by query_id order by score desc, page_id) as rank from scores)"""
_MONTHLY = """monthly as (select c_mktsegment as series_id, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 as t, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as value
  from orders join customer on o_custkey = c_custkey where year(o_orderdate) between 1995 and 1999 group by 1, 2)"""
_FORECAST = """ends as (select *, row_number() over (partition by series_id order by t desc) - 1 as from_end, row_number() over (partition by series_id order by t) - 1 as pos from monthly),
past as (select series_id, count(*) as n, regr_slope(value, pos) as slope, regr_intercept(value, pos) as intercept, arg_min(value, t) as first, arg_max(value, t) as last,
  list(value order by t) filter (from_end < 24) as season from ends where from_end >= 12 group by 1),
steps as (select *, unnest(range(1, 13)) as step from past),
forecasts as (
  select series_id, 'seasonal_naive' as method, step, season[((step - 1) % len(season)) + 1] as forecast from steps
  union all select series_id, 'linear_fit', step, intercept + slope * (n - 1 + step) from steps
  union all select series_id, 'drift', step, last + step * ((last - first) / (n - 1)) from steps
  union all select series_id, 'last_value', step, last from steps),
truth as (select series_id, 12 - from_end as step, value as actual from ends where from_end < 12),
scale as (select series_id, avg(abs(value - far)) as scale from (select *, lag(value, 12) over (partition by series_id order by t) as far from ends where from_end >= 12) group by 1)"""
_SWEEP = " union all ".join(
    f"select {n} as length, *, row_number() over (partition by series_id order by t) - 1 as pos from tail where from_end < {4 + n} qualify count(*) over (partition by series_id) = {4 + n}" for n in (4, 8, 12, 24)
)

_EDITS = """with c as (select c_custkey as k, cast(c_custkey as varchar) as doc_id, 'Retention is ' || (c_custkey % 97) || '%' as rate, 'The founder holds ' || c_mktsegment as view,
  c_mktsegment as segment, c_name as name, 'co-' || c_custkey || '-axis_read-001' as a, 'co-' || c_custkey || '-judgement-001' as j from customer),
edits as (
  select doc_id, 0 as idx, a as callout_id, false as blind_spot, rate as before, 'Retention is ' || (k % 97 + 1) || '%' as after, 'grr_pct' as field, 'axis_read' as kind, 'factual_error' as reason from c where k % 6 = 1
  union all select doc_id, 0, j, false, view, null, null, 'judgement', 'needs_triage' from c where k % 6 = 2
  union all select doc_id, 0, null, true, null, 'A new line of ' || k || ' and more', null, null, 'new_information' from c where k % 6 = 3
  union all select doc_id, 0, j, false, view, 'A board holds ' || segment, null, 'judgement', 'judgement_call' from c where k % 6 = 4
  union all select doc_id, 1, null, true, null, 'since last year', null, null, 'new_information' from c where k % 6 = 4
  union all select doc_id, 0, a, false, 'Name ' || name, null, 'grr_pct', 'axis_read', 'factual_error' from c where k % 6 = 5)"""

SQL = {
    "cohort_records": f"with {_YEARS} select * from book",
    "base_rate_cohort": f"""with {METRICS_SQL}, {_YEARS}, {_TARGETS},
        deals as (select *, {_band_sql('arr', SIZES)} as size, {_band_sql('grr', RETENTION)} as retention from book),
        lim as (select min(arr) as low, max(arr) as high, count(*) as records from book),
        mine as (select *, case when arr is null or grr is null then 'missing input' when records = 0 then 'empty book' when arr > 1.5 * high or arr < low / 1.5 then 'out of range' end as refusal from targets, lim),
        rungs(rung, uv, us, ur) as (values (0, true, true, true), (1, false, true, true), (2, false, false, true), (3, false, true, false), (4, false, false, false)),
        matched as (select m.target_id, rung, {_STATS} from mine m join rungs on refusal is null join deals d
          on (not uv or d.vertical = m.vertical) and (not us or d.size = m.size) and (not ur or d.retention = m.retention) group by 1, 2 having count(*) >= 8),
        best as (select * from matched qualify row_number() over (partition by target_id order by rung) = 1)
        select m.target_id, coalesce(refusal, case when b.n is null then 'thin book' end, 'matched') as status, rung, n, p10, median, p90, shrank_pct, optimistic_pct, deal_ids from mine m left join best b using (target_id)""",
    "underwriting_bias": f"""with {_YEARS}, g as (select vertical, underwritten - outcome as gap from book where underwritten - outcome is not null)
        select vertical, count(*) as n, round(quantile_cont(gap, 0.1), 2) as p10, round(quantile_cont(gap, 0.5), 2) as median, round(quantile_cont(gap, 0.9), 2) as p90, round(100.0::double * avg((gap > 0)::int), 1) as optimistic_pct from g group by 1""",
    "published_bands": f"""with {METRICS_SQL}, {_TARGETS}, bands(vertical, size, low, high, publisher) as (values ('BUILDING', 'lower', 40.0::double, 60.0::double, 'a'), ('BUILDING', 'lower', 30.0, 50.0, 'b'), ('MACHINERY', 'mid', 45.0, 55.0, 'a'))
        select target_id, 'grr_pct' as metric, grr as value, publisher, low, high, grr between low and high as inside from targets left join bands using (vertical, size)""",
    "customer_signal": f"with {METRICS_SQL}, {_ROSTER} select target_id, distressed_pct, researched_pct, roster_pct, researched, unresearched, largest, names, {_SEVERITY} as severity from signals",
    "signal_callouts": f"with {METRICS_SQL}, {_ROSTER}, s as (select {_SEVERITY} as severity from signals) select 'customer_health' as kind, count(*) as n, count(*) as with_share from s where severity <> 'none'",
    "distress_overlap_floor": """with c as (select count(distinct c_custkey) filter (c_acctbal < 5000) as in_a, count(distinct c_custkey) filter (c_mktsegment <> 'BUILDING') as in_b, count(distinct c_custkey) as universe from customer)
        select *, greatest(0, in_a + in_b - universe) as floor, round(100.0::double * greatest(0, in_a + in_b - universe) / nullif(least(in_a, in_b), 0), 1) as floor_pct from c""",
    "route_topk": f"with {_ROUTE} select query_id, page_id, round(score, 4) as score, rank from ranked where rank <= 3",
    "route_recall": f"""with {_ROUTE}, f as (select query_id, label, min(case when rank <= 4 and label = page_label then rank end) as rank from ranked group by 1, 2)
        select coalesce(cast(label as varchar), 'all') as carrier, count(*) as n, {", ".join(f"round(100.0::double * count(*) filter (rank <= {k}) / count(*), 1) as recall_{k}" for k in (1, 2, 3))} from f group by rollup(label)""",
    "route_pages_saved": f"with {_ROUTE} " + " union all ".join(f"select {k} as k, count(distinct page_id) as selected, round(100.0::double * (1 - count(distinct page_id) / (select count(*) from embeddings)::double), 1) as saved_pct from ranked where rank <= {k}" for k in (1, 2, 3)),
    "forecast_baselines": f"with {_MONTHLY}, {_FORECAST} select series_id, method, step, round(forecast, 2) as forecast from forecasts",
    "forecast_scores": f"""with {_MONTHLY}, {_FORECAST}, s as (select series_id, method, avg(abs(actual - forecast)) / max(scale) as mase, 100.0::double * avg(abs(actual - forecast) / abs(actual)) as mape
        from forecasts join truth using (series_id, step) join scale using (series_id) group by 1, 2) select method, count(*) as n, round(avg(mase), 4) as mase, round(avg(mape), 4) as mape from s group by 1""",
    "forecast_audit": f"""with {_MONTHLY}, {_FORECAST} select a.series_id, a.step, round(a.forecast, 2) as naive, round(b.forecast, 2) as model, round(b.forecast - a.forecast, 2) as difference, round(actual, 2) as actual
        from forecasts a join forecasts b on a.series_id = b.series_id and a.step = b.step and a.method = 'seasonal_naive' and b.method = 'drift' join truth t on t.series_id = a.series_id and t.step = a.step""",
    "history_sweep": f"""with {_MONTHLY}, tail as (select *, row_number() over (partition by series_id order by t desc) - 1 as from_end from monthly), cut as ({_SWEEP}),
        past as (select length, series_id, count(*) as n, regr_slope(value, pos) as slope, regr_intercept(value, pos) as intercept, arg_min(value, t) as first, arg_max(value, t) as last,
          list(value order by t) filter (from_end < 8) as season from cut where from_end >= 4 group by 1, 2),
        steps as (select *, unnest(range(1, 5)) as step from past),
        f as (select length, series_id, 'seasonal_naive' as method, step, season[((step - 1) % len(season)) + 1] as forecast from steps
          union all select length, series_id, 'linear_fit', step, intercept + slope * (n - 1 + step) from steps
          union all select length, series_id, 'drift', step, last + step * ((last - first) / (n - 1)) from steps
          union all select length, series_id, 'last_value', step, last from steps),
        lagged as (select *, lag(value, 4) over w as far, lag(value, 1) over w as near from cut where from_end >= 4 window w as (partition by length, series_id order by t)),
        scale as (select length, series_id, coalesce(avg(abs(value - far)), avg(abs(value - near))) as scale from lagged group by 1, 2),
        s as (select length, series_id, method, avg(abs(value - forecast)) / max(scale) as mase from f join (select distinct series_id, 4 - from_end as step, value from tail where from_end < 4) using (series_id, step) join scale using (length, series_id) group by 1, 2, 3)
        select length, method, count(*) as n, round(avg(mase), 4) as mase from s group by 1, 2""",
    "cohort_covariate": f"""with {_MONTHLY}, e as (select *, row_number() over (partition by series_id order by t desc) - 1 as t_from_end from monthly),
        k as (select min(c) as common from (select count(*) as c from monthly group by series_id)),
        o as (select series_id, t_from_end, (sum(value) over (partition by t_from_end) - value) / nullif(count(*) over (partition by t_from_end) - 1, 0) as others from e, k where t_from_end < common)
        select series_id, t_from_end, round(others, 4) as others, round((others - avg(others) over (partition by series_id)) / coalesce(nullif(stddev_pop(others) over (partition by series_id), 0), 1), 4) as z from o""",
    "quarter_facts": """with f as (select o_custkey as entity, cast(lag(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) as date) as s, cast(o_orderdate as date) as e, o_totalprice as value, o_orderkey as seq from orders),
        q as (select *, date_diff('day', s, e) as days from f where s is not null)
        select entity, cast(s as varchar) as start, cast(e as varchar) as "end", value, days from q where days between 80 and 100 qualify row_number() over (partition by entity, s, e order by seq) = 1""",
    "tag_fallback": """with c as (select o_custkey as entity, cast(substr(o_orderpriority, 1, 1) as int) as tag_priority, count(*) as n from orders group by 1, 2 having count(*) >= 4)
        select * from c qualify row_number() over (partition by entity order by tag_priority) = 1""",
    "asof_asked": """with asked as (
        select a.conv_id, a.turn, u.turn as asked_turn, length(u.text) as n, row_number() over (partition by a.conv_id, a.turn order by u.turn desc) as k
        from conversations a left join conversations u on u.conv_id = a.conv_id and u.role = 'user' and u.turn <= a.turn where a.role = 'assistant'
      ) select conv_id, turn, n as asked_chars, turn - asked_turn as turns_ago from asked where k = 1""",
    "asof_anchor": "select event_id, last_value(case when event_type = 'purchase' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as above from events",
    "nearest_events": """with e as (select *, cast(floor(epoch(ts)) as bigint) as s from events), n as (select p.event_id as purchase, v.event_id as seen, abs(p.s - v.s) as far from e p join e v on p.user_id = v.user_id and p.event_type = 'purchase' and v.event_type = 'view' and abs(p.s - v.s) <= 7200)
        select purchase, seen, far, row_number() over (partition by purchase order by far, seen) as place from n qualify place <= 3""",
    "gap_islands": """with e as (select user_id, cast(floor(epoch(ts)) as bigint) as s from events), g as (select *, coalesce((s - lag(s) over (partition by user_id order by s) > 21600)::int, 0) as b from e),
        i as (select *, sum(b) over (partition by user_id order by s rows unbounded preceding) as island from g) select user_id, cast(island as bigint) as island, count(*) as n, min(s) as first, max(s) as last from i group by 1, 2""",
    "interval_interpolate": "select c_custkey as series, round(100.0::double - cast(c_custkey % 1200 as double) / 10.0::double, 1) as value from customer",
    "line_fit_trimmed": """with p as (select o_orderpriority as priority, cast(dayofyear(o_orderdate) as double) as x, o_totalprice as y from orders),
        f as (select priority, regr_slope(y, x) as s, regr_intercept(y, x) as i, count(*) as n from p group by 1), r as (select priority, x, y, abs(y - (i + s * x)) as off from p join f using (priority)),
        m as (select priority, greatest(0.8::double, 3.0::double * quantile_cont(off, 0.5)) as most from r group by 1),
        a as (select priority, count(*) as n, regr_slope(y, x) as s, regr_intercept(y, x) as i from r join m using (priority) where off <= most group by 1)
        select f.priority, case when a.n >= 0.7 * f.n and a.n >= 2 then a.n else f.n end as n, round(case when a.n >= 0.7 * f.n and a.n >= 2 then a.s else f.s end, 4) as slope,
          round(case when a.n >= 0.7 * f.n and a.n >= 2 then a.i else f.i end, 2) as intercept from f left join a using (priority)""",
    "colour_bins": """with p as (select p_partkey % 3 as img, p_partkey * 7 % 256 as r, p_partkey * 13 % 256 as g, p_partkey * 29 % 256 as b from part),
        area as (select img, count(*) as area from p group by 1),
        bins as (select img, r // 24 as r_bin, g // 24 as g_bin, b // 24 as b_bin, count(*) as pixels, cast(floor(avg(r)) as bigint) as r, cast(floor(avg(g)) as bigint) as g, cast(floor(avg(b)) as bigint) as b
          from p where greatest(r, g, b) - least(r, g, b) > 30 and (r + g + b) / 3.0 < 240 group by 1, 2, 3, 4),
        c as materialized (select bins.* from bins join area using (img) where pixels >= 0.003 * area),
        """ + ", ".join(
        f"""k{n} as materialized (select * from c where """ + " and ".join(["true", *[f"not exists (select 1 from k{m} where k{m}.img = c.img and greatest(abs(k{m}.r - c.r), abs(k{m}.g - c.g), abs(k{m}.b - c.b)) <= 35)" for m in range(1, n)]])
        + " qualify row_number() over (partition by img order by pixels desc, r_bin, g_bin, b_bin) = 1)" for n in range(1, 5)
    ) + " select *, 1 as place from k1 union all select *, 2 from k2 union all select *, 3 from k3 union all select *, 4 from k4",
    "changed_texts": """select cast(conv_id as varchar) || ':' || cast(turn as varchar) as k from (select distinct conv_id, turn from conversations) where conv_id % 11 = 0 or conv_id % 7 = 0""",
    "memo_diff": f"{_EDITS} select * from edits",
    "correction_sessions": f"""{_EDITS} select doc_id, case when max(k) % 4 = 0 then max(k) % 3 + 2 else 1 end as session, count(*) as n, count(*) filter (blind_spot) as blind_spots,
        count(*) filter (reason = 'needs_triage') as untriaged from (select *, cast(doc_id as bigint) as k from edits) group by 1""",
    "event_windows": """with e as (select * from events qualify row_number() over (partition by event_id) = 1)
        select cast(epoch(date_trunc('day', ts)) as bigint) as start, event_type, count(*) as n, round(cast(sum(cast(value as decimal(18,4))) as double), 2) as total from e group by 1, 2""",
    "event_sliding": """with w as (select unnest([date_trunc('day', ts), date_trunc('day', ts) - interval 1 day]) as start from events) select cast(epoch(start) as bigint) as start, count(*) as n from w group by 1""",
    "event_sessions": """with g as (select *, coalesce((ts >= lag(ts) over (partition by user_id order by ts) + interval 6 hours)::int, 0) as b from events),
        i as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) as island from g) select user_id, cast(floor(epoch(min(ts))) as bigint) as start, cast(floor(epoch(max(ts))) as bigint) as last, count(*) as n from i group by user_id, island""",
}
