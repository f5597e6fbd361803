"""Simple forecasts of evenly spaced series, their errors, and facts by quarter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def split_holdout(series: DataFrame, horizon: int, history: int | None = None) -> DataFrame:
    """series: series_id, t, value. Adds from_end (0 the last), holdout, and pos: place in the history from 0.

    Only the last ``history`` points before the holdout are kept, if that is given.
    """
    order = W.partitionBy("series_id").orderBy(F.desc("t"))
    rows = series.withColumn("from_end", F.row_number().over(order) - 1)
    if history is not None:
        rows = rows.where(F.col("from_end") < horizon + history)
    rows = rows.withColumn("holdout", F.col("from_end") < horizon)
    return rows.withColumn("pos", F.row_number().over(W.partitionBy("series_id").orderBy("t")) - 1)


def _history(rows: DataFrame, horizon: int, season: int) -> DataFrame:
    """What the forecasts need of each series' history."""
    past = rows.where(~F.col("holdout"))
    recent = F.array_sort(F.collect_list(F.when(F.col("from_end") < horizon + season, F.struct("t", "value"))))
    return past.groupBy("series_id").agg(
        F.count("*").alias("n"),
        F.regr_slope("value", F.col("pos").cast("double")).alias("slope"),
        F.regr_intercept("value", F.col("pos").cast("double")).alias("intercept"),
        F.min_by("value", "t").alias("first"),
        F.max_by("value", "t").alias("last"),
        F.max("t").alias("last_t"),
        F.transform(recent, lambda x: x["value"]).alias("season"),
    )


#: A forecast is a column over a series' history and the step ahead, from 1. Others can be added.
FORECASTS = {
    "seasonal_naive": lambda step: F.get(F.col("season"), F.pmod(step - 1, F.size("season"))),
    "linear_fit": lambda step: F.col("intercept") + F.col("slope") * (F.col("n") - 1 + step),
    "drift": lambda step: F.col("last") + step * F.try_divide(F.col("last") - F.col("first"), F.col("n") - 1),
    "last_value": lambda step: F.col("last"),
}


def forecasts(series: DataFrame, horizon: int, season: int = 12, history: int | None = None, methods: dict | None = None) -> DataFrame:
    """series_id, method, step (from 1), forecast."""
    methods = methods or FORECASTS
    past = _history(split_holdout(series, horizon, history), horizon, season)
    steps = past.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    rows = F.array(*[F.struct(F.lit(m).alias("method"), f(F.col("step")).cast("double").alias("forecast")) for m, f in methods.items()])
    return steps.select("series_id", "step", F.inline(rows)).select("series_id", "method", "step", "forecast")


def truth(series: DataFrame, horizon: int) -> DataFrame:
    rows = split_holdout(series, horizon).where("holdout")
    return rows.select("series_id", (F.lit(horizon) - F.col("from_end")).alias("step"), F.col("value").alias("actual"))


def seasonal_scale(series: DataFrame, horizon: int, season: int = 12, history: int | None = None) -> DataFrame:
    """Mean absolute change over a season in the history; over one step where the history is no longer than a season."""
    past = split_holdout(series, horizon, history).where(~F.col("holdout"))
    order = W.partitionBy("series_id").orderBy("t")
    past = past.withColumns({"far": F.lag("value", season).over(order), "near": F.lag("value", 1).over(order)})
    return past.groupBy("series_id").agg(
        F.coalesce(F.avg(F.abs(F.col("value") - F.col("far"))), F.avg(F.abs(F.col("value") - F.col("near")))).alias("scale")
    )


def scores(series: DataFrame, horizon: int, season: int = 12, history: int | None = None, methods: dict | None = None) -> DataFrame:
    """series_id, method, mase, mape (percent): null where the scale or an actual value is 0."""
    both = forecasts(series, horizon, season, history, methods).join(truth(series, horizon), ["series_id", "step"])
    both = both.join(seasonal_scale(series, horizon, season, history), "series_id")
    off = F.abs(F.col("actual") - F.col("forecast"))
    return both.groupBy("series_id", "method").agg(
        F.try_divide(F.avg(off), F.first("scale")).alias("mase"),
        (100.0 * F.avg(F.try_divide(off, F.abs("actual")))).alias("mape"),
    )


def mean_scores(scored: DataFrame) -> DataFrame:
    """Methods with the best mean MASE first."""
    means = scored.groupBy("method").agg(
        F.count("*").alias("n"), F.round(F.avg("mase"), 4).alias("mase"), F.round(F.avg("mape"), 4).alias("mape")
    )
    return means.orderBy("mase", "method")


def history_sweep(series: DataFrame, lengths: list[int], horizon: int, season: int = 4, methods: dict | None = None) -> DataFrame:
    """Mean MASE by length of the history and method; one pass over the series for all lengths.

    Each length is a copy of the trailing points it needs, under a series of its own.
    """
    longest = max(lengths)
    trailing = split_holdout(series, horizon, longest).select("series_id", "t", "value", "from_end")
    copies = trailing.withColumn("length", F.explode(F.array(*map(F.lit, lengths)))).where(
        F.col("from_end") < horizon + F.col("length")
    )
    whole = copies.withColumn("have", F.count("*").over(W.partitionBy("series_id", "length"))).where(
        F.col("have") == horizon + F.col("length")
    )
    named = whole.select(F.concat_ws("|", F.col("length").cast("string"), "series_id").alias("series_id"), "t", "value")
    scored = scores(named, horizon, season, methods=methods)
    length = F.split_part("series_id", F.lit("|"), F.lit(1)).cast("int")
    return scored.groupBy(length.alias("length"), "method").agg(
        F.count("*").alias("n"), F.round(F.avg("mase"), 4).alias("mase")
    )


def audit(series: DataFrame, model: DataFrame, horizon: int, season: int = 12) -> DataFrame:
    """model: series_id, step, forecast. Naive, model, their difference, and the actual value, for each step."""
    naive = forecasts(series, horizon, season, methods={"seasonal_naive": FORECASTS["seasonal_naive"]})
    joined = naive.select("series_id", "step", F.col("forecast").alias("naive")).join(model, ["series_id", "step"])
    joined = joined.join(truth(series, horizon), ["series_id", "step"])
    return joined.select("series_id", "step", "naive", F.col("forecast").alias("model"), (F.col("forecast") - F.col("naive")).alias("difference"), "actual")


def cohort_covariates(series: DataFrame) -> DataFrame:
    """The mean of all other series at each of the last points that every series has, standardised per series.

    series_id, t_from_end, value, others, z (population deviation; 1 where that is 0). Window sums over
    a time step stand in for the join of every series with every other.
    """
    from_end = F.row_number().over(W.partitionBy("series_id").orderBy(F.desc("t"))) - 1
    rows = series.withColumn("t_from_end", from_end)
    shortest = rows.groupBy("series_id").count().agg(F.min("count").alias("common"))
    rows = rows.join(F.broadcast(shortest)).where(F.col("t_from_end") < F.col("common"))
    totals = rows.groupBy("t_from_end").agg(F.sum("value").alias("total"), F.count("*").alias("n"))
    rows = rows.join(totals, "t_from_end").withColumn("others", F.try_divide(F.col("total") - F.col("value"), F.col("n") - 1))
    own = W.partitionBy("series_id")
    spread = F.coalesce(F.nullif(F.stddev_pop("others").over(own), F.lit(0.0)), F.lit(1.0))
    return rows.select("series_id", "t_from_end", "value", "others", ((F.col("others") - F.avg("others").over(own)) / spread).alias("z"))


def covariate_windows(covariates: DataFrame, horizon: int) -> DataFrame:
    """covariates: series_id, t_from_end, z. Of each series what a model may see of the others: ``past``, up to the
    holdout, and ``future``, over it, both in the order of time."""
    inside = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct((-F.col("t_from_end")).alias("t"), "z")))), lambda x: x["z"])
    held = F.col("t_from_end") < horizon
    return covariates.groupBy("series_id").agg(inside(~held).alias("past"), inside(held).alias("future"))


def quarter_facts(facts: DataFrame, shortest: int = 80, longest: int = 100) -> DataFrame:
    """facts: entity, start, end, value, accession, seq. Facts over one quarter, the first of each (start, end).

    A fact needs start, end and accession; longer spans are dropped, never divided.
    """
    days = F.datediff("end", "start")
    whole = facts.where(F.col("start").isNotNull() & F.col("end").isNotNull() & (F.coalesce("accession", F.lit("")) != ""))
    whole = whole.withColumn("days", days).where(F.col("days").between(shortest, longest))
    first = F.row_number().over(W.partitionBy("entity", "start", "end").orderBy("seq"))
    return whole.withColumn("copy", first).where("copy = 1").drop("copy")


def first_long_enough(facts: DataFrame, least: int = 24) -> DataFrame:
    """facts: entity, tag_priority and more. All facts of the first tag that has ``least`` of them."""
    counts = facts.groupBy("entity", "tag_priority").count().where(F.col("count") >= least)
    chosen = counts.groupBy("entity").agg(F.min("tag_priority").alias("tag_priority"))
    return facts.join(chosen, ["entity", "tag_priority"], "left_semi")


def synthetic_monthly(base: Column, growth: Column, amplitude: Column, months: int = 60, anchor: int = 47) -> Column:
    """An array of (t, value): exponential growth through ``base`` at month ``anchor``, with a yearly wave."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(months - 1)),
        lambda i: F.struct(
            i.alias("t"),
            (base * F.pow(growth, i - anchor) * (1 + amplitude * F.sin(2 * F.lit(3.141592653589793) * i / 12))).alias("value"),
        ),
    )


def provenance(points: DataFrame, horizon: int, least: int = 12) -> DataFrame:
    """points: entity, end, accession, value. Of each series with ``least`` points before the holdout: how many it was
    trained on, its first and last end, where the holdout starts, and the holdout's filings (end, accession, value)."""
    order = W.partitionBy("entity").orderBy(F.desc("end"))
    rows = points.withColumns({"from_end": F.row_number().over(order) - 1})
    held = F.col("from_end") < horizon
    filings = F.array_sort(F.collect_list(F.when(held, F.struct("end", "accession", "value"))))
    found = rows.groupBy("entity").agg(
        F.count_if(~held).alias("trained_on"), F.min("end").alias("first"), F.max(F.when(~held, F.col("end"))).alias("last_trained"),
        F.min(F.when(held, F.col("end"))).alias("holdout_from"), filings.alias("filings"),
    )
    return found.where(F.col("trained_on") >= least)


def revenue_artifact(points: DataFrame) -> DataFrame:
    """points: entity, tag, start, end, value, accession. One row an entity with its points, oldest first: what is stored
    so that forecasts can be run again without the source."""
    rows = F.array_sort(F.collect_list(F.struct("end", "start", "value", "accession")))
    return points.groupBy("entity", "tag").agg(F.count("*").alias("quarters"), rows.alias("points"))
